import json
import shutil
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators import graph_write
from loomgraph.operators.jobs import replay_events
from loomgraph.operators.vocabulary import to_type_defs
from loomgraph.plans import knowledge, rules
from loomgraph.schemas import ENTITY, JOB, MENTION, RELATED, SOURCE
from loomgraph.sources.files import stream_drop_directory
from loomgraph.streaming import flows
from loomgraph.streaming.item_states import ItemStates, item_status_stream, reported
from loomgraph.streaming.job_states import EMPTY, absorb, job_state_stream, outcome
from loomgraph.streaming.store import TableStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drop_job(folder, name, **job):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps({"metadata": "{}", "created_at": "2024-01-01T00:00:00Z", **job}))


def test_queue_is_drained_once_per_arrival(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), buckets=4)
    config = spark.range(1).select(
        F.lit("kb").alias("kb_id"), F.lit("").alias("interests"), F.lit(False).alias("discover_types"),
        to_type_defs(F.array(F.lit("Person"))).alias("entity_types"), to_type_defs(F.array(F.lit("Near"))).alias("relationship_types"),
    )
    empty = {n: spark.createDataFrame([], s) for n, s in (("jobs", JOB), ("entities", ENTITY), ("related", RELATED), ("sources", SOURCE), ("mentions", MENTION))}
    store.write({**empty, "configs": config})
    assert store.version() == 0
    models = knowledge.Models(rules.relevant_by_length, rules.capitalised_words, rules.same_name)
    queue, check = tmp_path / "queue", str(tmp_path / "check")

    def run():
        flows.drain_stream(flows.queue_stream(spark, str(queue)), store, models, check).awaitTermination()

    drop_job(queue, "a", job_id="1", kb_id="kb", content="Alice meets Robert.")
    run()
    drop_job(queue, "b", job_id="2", kb_id="kb", content="Robert left Charles ok")
    run()
    run()
    names = {r["name"]: r["id"] for r in store.read("entities").collect()}
    assert set(names) == {"Alice", "Robert", "Charles"}
    edges = {(r["source_id"], r["target_id"]) for r in store.read("related").collect()}
    assert edges == {(names["Alice"], names["Robert"]), (names["Robert"], names["Charles"])}
    assert {r["status"] for r in store.read("jobs").collect()} == {"done"}
    assert store.read("mentions").where(F.col("entity_id") == names["Robert"]).count() == 2
    # A lost checkpoint starts the stream anew: nothing stored is lost or doubled, and what arrives is merged.
    shutil.rmtree(check)
    drop_job(queue, "c", job_id="3", kb_id="kb", content="Charles meets Dorothy.")
    run()
    assert {r["name"] for r in store.read("entities").collect()} == {"Alice", "Robert", "Charles", "Dorothy"}
    assert sorted(r["job_id"] for r in store.read("jobs").collect()) == ["1", "2", "3"]


def written_at(store, table):
    files = (store / table).glob("v=*/_bucket=*/*.parquet")
    return {(int(f.parent.parent.name[2:]), int(f.parent.name.split("=")[1])) for f in files}


def test_a_version_writes_the_touched_buckets_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), buckets=16, keep=2, keys={"sources": ["kb_id", "job_id"], "jobs": ["job_id"]})
    schema = "kb_id string, job_id string, label string"

    def rows(*ids, label="x"):
        return spark.createDataFrame([("kb", str(i), label) for i in ids], schema)

    store.write({"sources": rows(*range(200)), "jobs": rows().select("job_id")}, "s", 0)
    assert store.read("jobs").columns == ["job_id"] and store.read("jobs").isEmpty()
    change = {"sources": rows(3, 5, 300, label="y"), "jobs": rows(1).select("job_id")}
    touched = store.touched(change)
    assert 1 <= len(touched["sources"]) <= 3 and len(touched["jobs"]) == 1
    store.write(change, "s", 1)
    assert {b for v, b in written_at(tmp_path / "store", "sources") if v == 1} == set(touched["sources"])
    got = {r["job_id"]: r["label"] for r in store.read("sources").collect()}
    assert len(got) == store.read("sources").count() == 201 and {k for k, v in got.items() if v == "y"} == {"3", "5", "300"}
    assert store.holds("s", 1) and not store.holds("s", 2) and not store.holds("other", 0)
    # What a batch touches is read from its buckets: the scan names them as a partition filter.
    stored = store.read("sources", buckets=True)
    near = graph_write._near(stored, change["sources"], ["kb_id", "job_id"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    # Superseded buckets go once no kept version names them; an empty change writes none.
    store.write({"sources": rows(3, label="z"), "jobs": rows().select("job_id")}, "s", 2)
    store.write({"sources": rows(3, label="w"), "jobs": rows().select("job_id")}, "s", 3)
    place = store.touched({"sources": rows(3)})["sources"][0]
    assert {v for v, b in written_at(tmp_path / "store", "sources") if b == place} == {2, 3}
    assert {r["label"] for r in store.read("sources").where("job_id = '3'").collect()} == {"w"}
    assert store.version() == 3 and store.read("sources").count() == 201


def test_items_are_inserted_once(spark, tmp_path):
    source, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    schema = "source_id string, dedup_key string, pos int, text string"

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        flows.insert_new_items(spark.readStream.schema(schema).json(str(source)), table, check).awaitTermination()

    arrive("a", [("s", "k1", 0, "first"), ("s", "k1", 1, "again"), ("s", "k2", 2, "x")])
    arrive("b", [("s", "k2", 0, "y"), ("s", "k3", 1, "z"), ("t", "k1", 2, "other source")])
    got = {(r["source_id"], r["dedup_key"]): r["text"] for r in spark.read.parquet(table).collect()}
    assert got == {("s", "k1"): "first", ("s", "k2"): "x", ("s", "k3"): "z", ("t", "k1"): "other source"}
    shutil.rmtree(check)
    arrive("c", [("s", "k4", 0, "new")])
    got = {(r["source_id"], r["dedup_key"]): r["text"] for r in spark.read.parquet(table).collect()}
    assert len(got) == 5 and got["s", "k1"] == "first" and got["s", "k4"] == "new" and spark.read.parquet(table).count() == 5
    stream = flows.first_sightings(spark.readStream.schema(schema).json(str(source)))
    q = stream.writeStream.format("memory").queryName("sightings").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sightings").count() == 5


EVENTS = [
    ("a", 1, "submitted"), ("a", 2, "processing"), ("a", 3, "failed_attempt"), ("a", 4, "failed_attempt"), ("a", 5, "failed_attempt"), ("a", 6, "done"),
    ("b", 1, "submitted"), ("b", 2, "failed_attempt"), ("b", 3, "done"), ("b", 4, "failed_attempt"), ("c", 1, "submitted"), ("c", 2, "processing"), ("d", 1, "failed_attempt"),
]
WANT = {"a": ("failed", 3), "b": ("done", 1), "c": ("processing", 0), "d": ("pending", 1)}


def event_rows():
    return [(j, datetime(2024, 1, 1, 0, n), n, e) for j, n, e in EVENTS]


def test_event_replay(spark):
    log = spark.createDataFrame(event_rows(), "job_id string, ts timestamp, event_id long, event string")
    assert {r["job_id"]: (r["status"], r["attempts"]) for r in replay_events(log).collect()} == WANT
    for order in (EVENTS, EVENTS[::-1]):
        state = {}
        for job, at, event in order:
            state[job] = absorb(state.get(job, EMPTY), (at, at, event))
        assert {job: outcome(seen) for job, seen in state.items()} == WANT


def test_event_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "job_id string, ts timestamp, event_id long, event string"
    source, rows = str(tmp_path / "in"), event_rows()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        latest = {}
        for part in (rows[2:4] + rows[6:8], rows[:2] + rows[4:6] + rows[8:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

            def keep(batch, _):
                latest.update({r["job_id"]: (r["status"], r["attempts"]) for r in batch.collect()})

            stream = job_state_stream(spark.readStream.schema(schema).parquet(source))
            q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep).trigger(availableNow=True).start()
            q.awaitTermination()
        assert latest == WANT
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_drop_directory_stream(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "one.txt").write_text("first")
    check = str(tmp_path / "check")

    def run():
        seen = []
        q = flows.sweep(stream_drop_directory(spark, str(folder)), lambda b, _: seen.extend(r["title"] for r in b.collect()), check)
        q.awaitTermination()
        return seen

    assert run() == ["one.txt"]
    (folder / "two.md").write_text("second")
    (folder / "skip.bin").write_bytes(b"\x00")
    assert run() == ["two.md"]


def test_dropped_documents_are_listed_by_few_tasks_in_bounded_batches(spark, tmp_path, monkeypatch):
    from loomgraph.plans import stream_queries
    from loomgraph.sources.tables import Tables

    rows = [(i, f"text {i % 90}\r\n", f"s{i % 3}") for i in range(150)] + [(None, None, "s"), (None, "nameless", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sweep, started = flows.sweep, []

    def observed(*args):
        started.append(sweep(*args))
        return started[-1]

    monkeypatch.setattr(flows, "sweep", observed)
    monkeypatch.setattr(stream_queries, "FILES_PER_BATCH", 100, raising=False)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = entry.queries()["drop_directory_stream"](spark, str(tmp_path)).first()
    # Line ends count as one; a row without text is an empty line.
    chars = sum(len(text.replace("\r\n", "\n")) + 1 if text else 1 for _, text, _ in rows)
    assert (found.files, found.chars, found.texts) == (152, chars, 92)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(started[0].runId)) for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= 64
    assert sorted(p["numInputRows"] for p in started[0].recentProgress if p["numInputRows"]) == [52, 100]


def test_daily_windows_and_boundaries(spark, tmp_path):
    rows = [("kb", datetime(2024, 1, d, h)) for d, h in ((1, 1), (1, 23), (2, 5), (9, 0))]
    path = str(tmp_path / "s")
    table = spark.createDataFrame(rows, "kb_id string, ingested_at timestamp")
    table.coalesce(1).write.parquet(path)
    stream = flows.daily_sources(spark.readStream.schema(table.schema).parquet(path))
    q = stream.writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["day"].day: r["sources"] for r in spark.table("days").collect()}
    assert got == {1: 2, 2: 1}
    edge = datetime(2024, 1, 2, 5)
    assert flows.sources_of_window(table, edge).count() == 2
    assert flows.sources_of_window(table, edge, half_open=True).count() == 1


@pytest.mark.parametrize("known", [True, False])
def test_status_join_of_a_stream(spark, tmp_path, known):
    path = str(tmp_path / "items")
    items = spark.createDataFrame([("i1", "j1", "pending"), ("i2", "j2", "pending")], "item_id string, job_id string, job_status string")
    items.write.parquet(path)
    jobs = spark.createDataFrame([("j1", "done")] if known else [], "job_id string, status string")
    out = flows.live_status(spark.readStream.schema(items.schema).parquet(path), jobs)
    got = {}
    flows.sweep(out, lambda b, _: got.update({r["item_id"]: (r["job_status"], r["resolved"]) for r in b.collect()}), str(tmp_path / "c")).awaitTermination()
    assert got == {"i1": ("done", True) if known else ("pending", False), "i2": ("pending", False)}


def test_the_first_end_of_a_job_holds():
    assert reported(None, []) is None and reported("processing", []) == "processing"
    assert reported(None, [(2, "processing"), (1, "pending")]) == "processing"
    assert reported("processing", [(5, "processing"), (4, "failed"), (3, "done")]) == "done"
    assert reported("skipped", [(9, "done")]) == "skipped"


def test_items_wait_until_their_job_ends_or_time_is_up(spark, tmp_path):
    """Three micro-batches: an item may come before or after the reports on its job."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "item_id string, job_id string, status string, ts timestamp"

    def day(d, h=0):
        return datetime(2024, 1, d, h)

    batches = [
        [("i1", "j1", None, day(1)), ("i2", "j2", None, day(1)), ("i3", "j3", None, day(1)), ("i0", None, None, day(1)), (None, "j1", "processing", day(1, 2)), (None, "j4", "done", day(1, 3)), (None, "j2", "", day(1, 4))],
        [(None, "j1", "done", day(2)), (None, "j2", "processing", day(2)), ("i4", "j4", None, day(2)), ("i2", "j2", None, day(2)), ("i5", "j2", None, day(2, 1)), (None, None, "done", day(2))],
        [(None, "j1", "failed", day(4)), (None, "j2", "skipped", day(4)), (None, "j9", "done", day(9))],
    ]
    told = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            seen = []
            told.append(seen)
            stream = spark.readStream.schema(schema).parquet(source)
            out = item_status_stream(stream, stream, patience_seconds=5 * 86400)
            q = out.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(lambda b, _, seen=seen: seen.extend(map(tuple, b.collect())))
            q.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(told[0]) == [("i1", "j1", "processing", False, False), ("i2", "j2", "pending", False, False), ("i3", "j3", "pending", False, False)]
    assert sorted(told[1]) == [("i1", "j1", "done", True, False), ("i2", "j2", "processing", False, False), ("i4", "j4", "done", True, False), ("i5", "j2", "processing", False, False)]
    # The job that ended stays as it ended; the one that nobody reported on is given up when the clock passes its time.
    assert sorted(told[2]) == [("i2", "j2", "skipped", True, False), ("i3", "j3", "pending", False, True), ("i5", "j2", "skipped", True, False)]


def test_a_new_job_asks_the_state_for_nothing_but_itself():
    """Every call to the state is a message: a job heard of for the first time has no timers to list and no items to read."""
    calls = []

    class Stub:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, method):
            def call(*args):
                calls.append(f"{self.name}.{method}")
                return Stub(args[0]) if method in ("getValueState", "getListState") else False if method == "exists" else 0

            return call

    states = ItemStates(1000)
    states.init(Stub("handle"))
    calls.clear()
    rows = [Row(item_id="i", status=None, at_ms=5)]
    told = list(states.handleInputRows(("j",), iter(rows), Stub("clock")))
    assert [tuple(r) for r in told] == [("i", "j", "pending", False, False)]
    assert calls == ["heard.exists", "waiting.appendList", "clock.getCurrentWatermarkInMs", "handle.registerTimer", "heard.update"]
