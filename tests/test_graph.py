"""Graph reads and writes: tenancy, ordering, upsert rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators import graph_read, graph_write

ENTITY = "kb_id string, id string, type string, name string, name_normalized string, summary string, article string, aliases array<string>, created_at timestamp, updated_at timestamp"
RELATED = "kb_id string, source_id string, target_id string, type string, source_job_id string, created_at timestamp"
SOURCE = "kb_id string, job_id string, label string, published_at timestamp, ingested_at timestamp"


def at(day):
    return datetime(2024, 1, day)


def entity(kb, id_, name, type_="Person", day=1, article=None, summary=None, aliases=()):
    return (kb, id_, type_, name, name.lower(), summary, article, list(aliases), at(1), at(day))


@pytest.fixture(scope="module")
def graph(spark):
    entities = spark.createDataFrame(
        [entity("a", "ada", "Ada", day=1), entity("a", "eng", "Engine", "Machine", 2), entity("a", "cam", "Cam", day=3), entity("b", "sec", "Secret"), entity("b", "ada2", "Ada")],
        ENTITY,
    )
    related = spark.createDataFrame(
        [("a", "ada", "eng", "Made", "1", at(1)), ("a", "eng", "cam", "Owned by", "1", at(1)), ("a", "ada", "sec", "Leak", "1", at(1)), ("b", "ada", "eng", "Leak", "1", at(1)), ("b", "sec", "eng", "Leak", "1", at(1))],
        RELATED,
    )
    sources = spark.createDataFrame(
        [("a", "1", "L1", at(1), at(1)), ("a", "2", None, None, at(2)), ("a", "3", "L3", at(3), None), ("b", "4", "L4", at(4), at(4))], SOURCE
    )
    mentions = spark.createDataFrame(
        [("a", "ada", "1"), ("a", "ada", "2"), ("a", "ada", "4"), ("b", "ada", "1"), ("a", "sec", "1")], "kb_id string, entity_id string, job_id string"
    )
    return entities, related, sources, mentions


def test_nodes(graph):
    entities = graph[0]
    assert [r["id"] for r in graph_read.nodes(entities, "a").collect()] == ["ada", "cam", "eng"]
    assert [r["id"] for r in graph_read.nodes(entities, "a", since=at(2)).collect()] == ["cam", "eng"]
    assert [r["id"] for r in graph_read.nodes(entities, "a", type_="Machine").collect()] == ["eng"]
    assert graph_read.nodes(entities, "a", limit=0).count() == 1
    assert (graph_read.page_size(500), graph_read.page_size(-3), graph_read.page_size(None)) == (500, 1, graph_read.UNLIMITED)
    with pytest.raises(ValueError, match="limit 501"):
        graph_read.page_size(501)


def test_lookup_of_a_foreign_node_finds_nothing(spark, graph):
    asked = spark.createDataFrame([("a", "ada"), ("a", "sec"), ("b", "ada"), ("a", "none")], "kb_id string, id string")
    found = {(r["kb_id"], r["id"]): r["name"] for r in graph_read.node_lookup(asked, graph[0]).collect()}
    assert found == {("a", "ada"): "Ada", ("a", "sec"): None, ("b", "ada"): None, ("a", "none"): None}


def test_edges_and_references_never_cross_tenants(graph):
    entities, related, sources, mentions = graph
    got = {(r["source_id"], r["type"], r["target_id"]) for r in graph_read.edges(related, entities).collect()}
    assert got == {("ada", "Made", "eng"), ("eng", "Owned by", "cam")}
    assert graph_read.edges(related, entities, type_="Made").count() == 1
    refs = graph_read.references(mentions, sources, entities).orderBy(F.col("published_at").asc_nulls_last()).collect()
    assert [(r["entity_id"], r["label"], r["published_at"]) for r in refs] == [("ada", "L1", at(1)), ("ada", "", None)]


def test_related_nodes(spark, graph):
    entities, related, *_ = graph
    asked = spark.createDataFrame([("a", "ada"), ("a", "cam"), ("b", "ada")], "kb_id string, id string")
    got = {(r["id"], r["related_id"]) for r in graph_read.related_nodes(asked, related, entities).collect()}
    assert got == {("ada", "cam"), ("cam", "ada")}
    # A direct edge hides the pair even when it carries another tenant's id.
    direct = related.unionByName(spark.createDataFrame([("b", "ada", "cam", "X", "1", at(1))], RELATED))
    assert graph_read.related_nodes(asked, direct, entities).count() == 0


def test_related_nodes_around_a_hub(spark):
    """A hub on a third of all edges, edges repeated under several types, and a plan that shuffles none of them for few requests."""
    edges = [("a", "hub", f"n{i}", t) for i in range(300) for t in ("x", "y")] + [("a", f"n{i}", f"n{i + 1}", "x") for i in range(0, 600, 2)]
    edges += [("b", "hub", "n5", "x"), ("a", "n7", "n7", "x"), ("a", "n8", "gone", "x")]
    related = spark.createDataFrame([(*e, "j", at(1)) for e in edges], RELATED)
    entities = spark.createDataFrame([("a", n) for n in ["hub", *(f"n{i}" for i in range(601))]], "kb_id string, id string")
    entities = entities.selectExpr("*", "'T' AS type", "id AS name", "'' AS summary")
    asked = ["hub", "n3", "n7", "n400"]
    found = graph_read.related_nodes(spark.createDataFrame([("a", n) for n in asked], "kb_id string, id string"), related, entities)
    pairs = {p for kb, s, t, _ in edges if kb == "a" for p in ((s, t), (t, s))}
    known = {"hub", *(f"n{i}" for i in range(601))}
    direct = pairs | {p for _, s, t, _ in edges for p in ((s, t), (t, s))}
    want = {(i, r) for i in asked for a, m in pairs if a == i for b, r in pairs if b == m and r != i and r in known and (i, r) not in direct}
    assert {(r["id"], r["related_id"]) for r in found.collect()} == want and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(kb_id#" in plan and "middle" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning" in line
    )


def test_recent_sources(graph):
    _, _, sources, _ = graph
    mine = sources.where("kb_id = 'a'")
    assert [r["job_id"] for r in graph_read.recent_sources(mine).orderBy("rank").collect()] == ["3", "2", "1"]
    assert [r["job_id"] for r in graph_read.recent_sources(mine, since=at(2)).collect()] == ["2"]
    assert [r["job_id"] for r in graph_read.recent_sources(mine, limit=1).collect()] == ["3"]


def test_sources_keep_a_row_without_entities(graph):
    entities, _, sources, mentions = graph
    found = graph_read.sources_with_entities(graph_read.recent_sources(sources), mentions, entities)
    assert {(r["kb_id"], r["job_id"], r["entity_id"]) for r in found.collect()} == {("a", "1", "ada"), ("a", "2", "ada"), ("a", "3", None), ("b", "4", None)}


def test_since_argument(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "2024-01-02")], "i int, s string")
    got = df.orderBy("i").select(graph_read.since_or_error(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in got] == [None, None, at(2)]
    with pytest.raises(Exception, match="invalid `since`"):
        spark.createDataFrame([("soon",)], "s string").select(graph_read.since_or_error(F.col("s"))).collect()


def test_search_by_token(spark):
    entities = spark.createDataFrame(
        [entity("a", "1", "Barack Obama"), entity("a", "2", "President Obama", aliases=["potus"]), entity("b", "3", "Obama Fried Chicken"), entity("a", "4", "Other")], ENTITY
    )
    asked = spark.createDataFrame([("a", "Obama"), ("a", "POTUS"), ("a", "?"), ("b", "potus")], "kb_id string, text string")
    got = {}
    for r in graph_read.nodes_search(entities, asked).collect():
        got.setdefault((r["kb_id"], r["text"]), set()).add(r["id"])
    assert got == {("a", "Obama"): {"1", "2"}, ("a", "POTUS"): {"2"}}
    newest = graph_read.nodes_search(entities.withColumn("updated_at", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,int(id))")), asked, since=at(2))
    assert [r["id"] for r in newest.where("text = 'Obama'").orderBy("rank").collect()] == ["2", "1"]


# --- writes -------------------------------------------------------------------------


def batch(spark, rows):
    return spark.createDataFrame(rows, "kb_id string, entity_id string, batch_pos int, type string, name string, summary string, article string, aliases array<string>")


def test_entity_upsert_overwrites_all_but_the_first_facts(spark):
    stored = spark.createDataFrame([entity("a", "1", "Old", "Person", 1, "art", "sum", ["x"]), entity("a", "2", "Kept")], ENTITY)
    new = batch(spark, [("a", "1", 1, "Thing", "First", "s1", "a1", ["A  B"]), ("a", "1", 2, "Thing", "Last  Name", "s2", "a2", ["C"]), ("a", "9", 3, "Thing", "Nine", "s", "a", None)])
    got = {r["id"]: r for r in graph_write.upsert_entities(stored, new, F.lit(at(9))).collect()}
    one = got["1"]
    assert (one["type"], one["name"], one["name_normalized"], one["summary"], one["article"], one["aliases"], one["created_at"], one["updated_at"]) == (
        "Person", "Last  Name", "last name", "s2", "a2", ["c"], at(1), at(9),
    )
    assert got["2"]["updated_at"] == at(1)
    assert (got["9"]["type"], got["9"]["aliases"], got["9"]["created_at"]) == ("Thing", [], at(9))


def test_upserts_are_idempotent(spark):
    stored = spark.createDataFrame([entity("a", "1", "Old")], ENTITY)
    new = batch(spark, [("a", "1", 1, "T", "N", "s", "a", ["b"]), ("a", "2", 2, "T", "M", "s", "a", [])])
    once = graph_write.upsert_entities(stored, new, F.lit(at(9)))
    twice = graph_write.upsert_entities(once, new, F.lit(at(9)))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_relationships_need_both_ends_and_keep_the_first_job(spark, graph):
    entities, related, *_ = graph
    rows = [("a", "ada", "eng", "Made", "7", 1), ("a", "ada", "cam", "Knows", "7", 2), ("a", "ada", "cam", "Knows", "8", 1), ("a", "ada", "sec", "X", "7", 3), ("a", "ada", "ada", "Self", "7", 4)]
    new = spark.createDataFrame(rows, "kb_id string, source_id string, target_id string, type string, job_id string, batch_pos int")
    stored = related.where("kb_id = 'a' AND target_id <> 'sec'")
    after = graph_write.upsert_relationships(stored, new, entities, F.lit(at(9)))
    got = {(r["source_id"], r["target_id"], r["type"]): r["source_job_id"] for r in after.collect()}
    assert got == {("ada", "eng", "Made"): "1", ("eng", "cam", "Owned by"): "1", ("ada", "cam", "Knows"): "8", ("ada", "ada", "Self"): "7"}
    assert sorted(graph_write.upsert_relationships(after, new, entities, F.lit(at(9))).collect()) == sorted(after.collect())


def test_provenance(spark, graph):
    entities, _, sources, mentions = graph
    rows = [("a", "1", 1, "old", "2024-01-05", "bad"), ("a", "1", 2, "new", "", "2024-01-06T01:00:00+01:00"), ("a", "5", 3, "five", "2024-01-05", "2024-01-06")]
    new = spark.createDataFrame(rows, "kb_id string, job_id string, batch_pos int, label string, published_at string, ingested_at string")
    got = {r["job_id"]: (r["label"], r["published_at"], r["ingested_at"]) for r in graph_write.upsert_sources(sources, new).collect()}
    assert got["1"] == ("new", None, at(6)) and got["5"] == ("five", at(5), at(6)) and got["3"] == ("L3", at(3), None)
    links = spark.createDataFrame([("a", "ada", "1"), ("a", "eng", "5"), ("a", "eng", "5"), ("a", "sec", "5")], "kb_id string, entity_id string, job_id string")
    after = graph_write.upsert_mentions(mentions, links, entities)
    assert after.count() == mentions.count() + 1


def test_purge_and_backfill(spark, graph):
    entities, _, sources, _ = graph
    gone = spark.createDataFrame([("a",), ("zzz",)], "kb_id string")
    assert {r["kb_id"] for r in graph_write.purge_tenants(entities, gone).collect()} == {"b"}
    assert {r["kb_id"]: r["deleted"] for r in graph_write.purge_counts(gone, entities, sources).collect()} == {"a": 6, "zzz": 0}
    rows = spark.createDataFrame([entity("a", "1", "n", summary="One. Two."), entity("a", "2", "n", article="x", summary="One. Two."), entity("a", "3", "n")], ENTITY)
    got = {r["id"]: (r["article"], r["summary"]) for r in graph_write.backfill_articles(rows).collect()}
    assert got == {"1": ("One. Two.", "One."), "2": ("x", "One. Two."), "3": (None, None)}


def test_dates_of_a_source_are_read_once(spark, monkeypatch):
    """Not for every row of the batch that names the source: the aggregate carries the texts."""
    monkeypatch.setattr(graph_write.durable, "cut", lambda df: df)
    batch = spark.createDataFrame([], "kb_id string, job_id string, batch_pos int, label string, published_at string, ingested_at string")
    plan = graph_write.source_changes(batch)._jdf.queryExecution().analyzed().toString()
    aggregate = next(line for line in plan.split("\n") if "Aggregate" in line)
    assert "regexp" not in aggregate and "max_by" in aggregate


def test_batches_are_written_down_packed(spark):
    """Hashed ids are most of what a merge writes: they are stored as zstd, which takes little more than half of their digits."""
    import glob

    import pyarrow.parquet as pq

    from loomgraph import durable

    rows = spark.range(2000).select(F.lit("kb").alias("kb_id"), F.sha2(F.col("id").cast("string"), 256).alias("entity_id"))
    place = durable.packed(rows)._stored_at.removeprefix("file:").removeprefix("//")
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{place}/*.parquet")]
    columns = [m.row_group(g).column(c) for m in metas for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert columns and {c.compression for c in columns} == {"ZSTD"}
    assert sum(c.total_compressed_size for c in columns if c.path_in_schema == "entity_id") < 0.7 * 64 * 2000


def test_edges_between_entities_in_several_tables(spark):
    """Without broadcasts, entities and edges out of several tables meet in shuffles that are coalesced while the job runs."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "12"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        name = lambda n: F.concat(F.lit("e"), n)
        first, changed, added = (durable.cut(spark.range(*x).select(F.lit("kb").alias("kb_id"), name(F.col("id")).alias("id"))) for x in ((0, 120), (100, 160), (160, 200)))
        now = graph_write.replaced(first, changed, ["id"])
        edges = spark.range(200).select(
            F.lit("kb").alias("kb_id"), name(F.col("id")).alias("source_id"), name(F.col("id") + 1).alias("target_id"), F.lit("t").alias("type"),
            F.col("id").cast("string").alias("job_id"), F.col("id").alias("batch_pos"),
        )
        edges, run = durable.cut(edges), F.lit("2020-01-01").cast("timestamp")
        none = spark.createDataFrame([], RELATED)
        stored = durable.cut(graph_write.relationship_changes(none, edges, now, run))
        state = graph_write.replaced(durable.cut(stored.limit(0)), stored, graph_write.EDGE_KEY)
        fresh = durable.cut(graph_write.relationship_changes(state, edges, now.unionByName(added), run))
        assert stored.count() == 159
        assert sorted(int(r.source_job_id) for r in fresh.collect()) == list(range(159, 199))
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
