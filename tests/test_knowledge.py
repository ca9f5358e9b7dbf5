"""A batch of jobs merged end to end, with scripted models."""

import json
import re
import time
from dataclasses import fields, replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators.articles import fold_articles, latest_articles
from loomgraph.plans import knowledge, rules
from loomgraph.schemas import CONFIG, ENTITY, JOB, MENTION, RELATED, SOURCE

NOW = datetime(2024, 6, 1)


def job(i, content, kb="kb", **over):
    base = dict(job_id=str(i), kb_id=kb, content=content, metadata='{"source":"S","published_at":"2024-01-05"}', status="pending", relevance_reason=None, error=None, attempts=0,
                created_at=datetime(2024, 1, i), processed_at=None)
    return tuple({**base, **over}.values())


def types(*names):
    return [(n.strip("!+"), "", "+" in n, "!" in n) for n in names]


def state(spark, *rows, entities=(), discover=True):
    make = spark.createDataFrame
    configs = [("kb", "lens", discover, types("Person", "Banned!"), types("Knows"))]
    return knowledge.State(
        make(list(rows), JOB), make(configs, CONFIG), make(list(entities), ENTITY), make([], RELATED), make([], SOURCE), make([], MENTION)
    )


def scripted(answers):
    """The content is the name of the script to answer with."""

    def factory():
        return lambda asked: [answers[r["user"]] for r in asked]

    return factory


def extraction(entities, relations=()):
    return json.dumps({
        "entities": [{"name": n, "type": t, "description": f"{n} is {t}.", "aliases": [n[:3]]} for n, t in entities],
        "relationships": [{"source_name": a, "target_name": b, "type": t} for a, b, t in relations],
    })


def yes():
    return lambda asked: [json.dumps({"relevant": "spam" not in r["user"], "reason": "why"}) for r in asked]


def type_rules():
    def one(r):
        out = []
        for line in r["user"].split("\n")[1:]:
            name = line[2:].split(" (e.g.")[0]
            decision = {"Human": ("existing", "person", ""), "Town": ("new", "", "Place"), "Village": ("existing", "place", ""), "Mood": ("drop", "", ""), "Likes": ("existing", "KNOWS", "")}[name]
            out.append({"candidate": line[2:], "decision": decision[0], "canonical": decision[1], "name": decision[2], "description": "d"})
        return json.dumps({"decisions": out})

    return lambda asked: [one(r) for r in asked]


def no_types():
    return lambda asked: [TimeoutError("down") for _ in asked]


def models(answers, **over):
    return replace(knowledge.Models(yes, scripted(answers), rules.same_name, type_rules), **over)


def run(spark, st, ms, n=5):
    return knowledge.drain(st, ms, F.lit(NOW), "b1", n)


def test_types_identities_and_relationships(spark):
    answers = {
        "one": extraction([("Ada", "PERSON"), ("Kelso", "Village"), ("Ada ", "Human"), ("Kelso", "Town"), ("Kelso", "Village"), ("Glum", "Mood"), ("No", "banned")], [("ada", "Kelso", "Likes"), ("Ada", "Kelso", "knows"), ("Ada", "Glum", "Knows")]),
        "two": extraction([("Ada", "Person"), ("Ada", "Person")]),
    }
    st = state(spark, job(1, "one"), job(2, "two"), job(3, "spam"))
    merged = run(spark, st, models(answers))
    after = merged.state
    ents = {(r["name"].strip(), r["type"]): r for r in after.entities.collect()}
    # The village was named before the place type was minted, so only later mentions count.
    assert set(ents) == {("Ada", "Person"), ("Kelso", "Place")}
    assert ents["Ada", "Person"]["aliases"] == ["ada"]
    edges = after.related.collect()
    assert [(r["type"], r["source_job_id"]) for r in edges] == [("Knows", "1")]
    counts = {r["job_id"]: (r["entities_created"], r["entities_merged"], r["relationships_created"]) for r in merged.counts.collect()}
    assert counts == {"1": (2, 2, 2), "2": (1, 1, 0)}
    config = after.configs.first()
    assert [t["name"] for t in config["entity_types"]] == ["Person", "Banned", "Place"] and config["entity_types"][2]["description"] == "d"
    status = {r["job_id"]: r["status"] for r in after.jobs.collect()}
    assert status == {"1": "done", "2": "done", "3": "skipped"}
    src = after.sources.orderBy("job_id").first()
    assert (src["label"], src["published_at"], src["ingested_at"]) == ("S", datetime(2024, 1, 5), datetime(2024, 1, 1))
    assert after.mentions.count() == 3


def shared_word():
    """A mention is the candidate with a word in common, first by name, so entities change their names from job to job."""

    def one(r):
        chosen, place, own = {}, None, set()
        for line in r["user"].split("\n"):
            head, option = re.match(r"\[(\d+)\] (.*) \(", line), re.match(r"    - id=(.*?): (.*) — ", line)
            if head:
                place, own = int(head.group(1)), set(head.group(2).lower().split())
            elif option and own & set(option.group(2).lower().split()):
                chosen[place] = min(chosen.get(place, ("~", "")), (option.group(2), option.group(1)))
        return json.dumps({"resolutions": [{"index": i, "id": c[1]} for i, c in chosen.items()]})

    return lambda asked: [one(r) for r in asked]


def test_jobs_of_a_batch_see_each_other(spark):
    """Any size of batch gives what one job after the other gives: identities, latest names, counts and found types."""
    names = [["Ada Byron", "Cam"], ["Byron King", "Eve"], ["Ada", "King Noel", "Cam"]]
    kinds = ["Town", "Person", "Village"]
    answers = {f"text{i}": extraction([(n, kinds[i] if n == "Cam" else "Person") for n in ns]) for i, ns in enumerate(names)}
    rows = [job(i + 1, f"text{i}") for i in range(3)] + [job(1, "text2", kb="other", job_id="o")]

    def after(n):
        st = state(spark, *rows)
        st = replace(st, configs=st.configs.unionByName(st.configs.withColumn("kb_id", F.lit("other"))))
        counts = []
        for turn in range(-(-len(rows) // n)):
            merged = knowledge.drain(st, models(answers, resolution=shared_word), F.lit(NOW), f"b{turn}", n)
            counts += [tuple(r) for r in merged.counts.collect()]
            st = knowledge.State(*(durable.cut(getattr(merged.state, f.name)) for f in fields(knowledge.State)))
        named = {r["id"]: (r["kb_id"], r["type"], r["name"], tuple(r["aliases"])) for r in st.entities.collect()}
        links = sorted((named[r["entity_id"]], r["job_id"]) for r in st.mentions.collect())
        types_ = sorted((r["kb_id"], [t["name"] for t in r["entity_types"]]) for r in st.configs.collect())
        return links, sorted(named.values()), sorted(counts), types_

    want = after(1)
    assert after(4) == want
    # Byron King is Ada Byron under her next name, and the third job's King Noel is the same again.
    assert [n for kb, _, n, _ in want[1] if kb == "kb"] == ["Ada", "Eve", "King Noel", "Cam"]


def test_failing_calls_cost_attempts_and_leave_no_trace(spark):
    answers = {"one": "not json", "two": extraction([("Ada", "Person")]), "three": TimeoutError("slow")}
    st = state(spark, job(1, "one"), job(2, "two"), job(3, "three", attempts=2))
    after = run(spark, st, models(answers)).state
    rows = {r["job_id"]: (r["status"], r["attempts"], r["error"]) for r in after.jobs.collect()}
    assert rows == {"1": ("pending", 1, "unparseable response"), "2": ("done", 0, None), "3": ("failed", 3, "slow")}
    assert after.sources.count() == 1 and after.entities.count() == 1


def test_type_gate_failure_keeps_known_types(spark):
    answers = {"one": extraction([("Ada", "Person"), ("Kelso", "Town")])}
    after = run(spark, state(spark, job(1, "one")), models(answers, types=no_types)).state
    assert [r["name"] for r in after.entities.collect()] == ["Ada"]
    assert after.jobs.first()["status"] == "done"


def test_no_discovery_asks_nothing(spark):
    answers = {"one": extraction([("Ada", "Person"), ("Kelso", "Town")])}

    def never():
        def ask(asked):
            raise AssertionError("asked")

        return ask

    after = run(spark, state(spark, job(1, "one"), discover=False), models(answers, types=never)).state
    assert after.entities.count() == 1


def test_known_entities_are_merged_and_articles_grow(spark):
    old = ("kb", "e1", "Person", "Ada", "ada", "s", "start", [], datetime(2024, 1, 1), datetime(2024, 1, 1))
    foreign = ("other", "e2", "Person", "Bob", "bob", "s", "x", [], datetime(2024, 1, 1), datetime(2024, 1, 1))
    answers = {"one": extraction([("Ada", "Person"), ("Bob", "Person")]), "two": extraction([("ADA", "Person")])}
    st = state(spark, job(1, "one"), job(2, "two"), entities=[old, foreign])
    after = run(spark, st, models(answers, article=rules.append_article)).state
    rows = {r["id"]: r for r in after.entities.collect()}
    assert rows["e1"]["article"] == "start|Ada is Person.|ADA is Person." and rows["e1"]["name"] == "ADA"
    assert rows["e2"]["updated_at"] == datetime(2024, 1, 1)
    assert len(rows) == 3


def test_a_batch_takes_the_oldest_jobs(spark):
    answers = {"one": extraction([])}
    st = state(spark, *(job(i, "one") for i in (3, 1, 2)))
    after = run(spark, st, models(answers), n=2).state
    assert {r["job_id"]: r["status"] for r in after.jobs.collect()} == {"1": "done", "2": "done", "3": "pending"}


MENTION_COLUMNS = "kb_id string, entity_id string, batch_pos int, name string, type string, description string, existing_article string"


def test_article_fold_over_batch_borders(spark):
    rows = [("kb", f"e{i % 3}", i, "n", "t", f"d{i}", "old" if i % 3 == 0 else None) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["entity_id"]: r["article"] for r in fold_articles(spark.createDataFrame(rows, MENTION_COLUMNS), rules.append_article).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {f"e{k}": "|".join((["old"] if k == 0 else []) + [f"d{i}" for i in range(50) if i % 3 == k]) for k in range(3)}
    assert got == want


@pytest.mark.parametrize("answer", [None, "", "nonsense", '{"abstract": "x"}'])
def test_failed_article_falls_back(spark, answer):
    rows = [("kb", "new", 0, "n", "t", "First. More.", None), ("kb", "old", 0, "n", "t", "First. More.", "Kept. Text.")]
    df = spark.createDataFrame(rows, MENTION_COLUMNS)
    got = {r["entity_id"]: (r["summary"], r["article"]) for r in fold_articles(df, lambda: lambda asked: [answer for _ in asked]).collect()}
    assert got == {"new": ("First.", "First. More."), "old": ("Kept.", "Kept. Text.")}
    assert {r["entity_id"]: (r["summary"], r["article"]) for r in latest_articles(df).collect()} == got


def test_article_of_a_hub_entity_takes_time_by_its_mentions(spark):
    """Nine thousand mentions of one entity in one batch: looking through the whole batch for each took over ten seconds."""
    columns = ["'kb' AS kb_id", "'hub' AS entity_id", "id AS batch_pos", "'n' AS name", "'t' AS type", "'d' AS description", "CAST(NULL AS string) AS existing_article"]
    few, many = (spark.range(n).selectExpr(*columns) for n in (10, 9000))
    assert fold_articles(few, rules.counting_article).first()["article"] == "10"
    start = time.monotonic()
    assert fold_articles(many, rules.counting_article).first()["article"] == "9000"
    assert time.monotonic() - start < 5
