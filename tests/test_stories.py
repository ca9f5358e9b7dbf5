"""Clusters, issues and the newsroom run."""

import json
import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import clustering, pages_text
from loomgraph.plans import newsroom

SOURCE = "kb_id string, job_id string, label string, published_at timestamp, ingested_at timestamp"
MENTION = "kb_id string, entity_id string, job_id string"


def at(day):
    return datetime(2024, 1, day)


def frames(spark, named, days=None):
    """Sources 1..n in tenant kb with the given entities."""
    days = days or {}
    sources = [("kb", j, f"L{j}", at(days.get(j, 1)), at(days.get(j, 1))) for j in named]
    mentions = [("kb", e, j) for j, es in named.items() for e in es]
    return spark.createDataFrame(sources, SOURCE), spark.createDataFrame(mentions, MENTION)


def clusters(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["cluster_id"], []).append((r["rank"], r["job_id"]))
    return {c: [j for _, j in sorted(v)] for c, v in groups.items()}


def test_sharing_is_transitive_and_strangers_stay_alone(spark):
    s, m = frames(spark, {"1": ["x"], "2": ["x", "y"], "3": ["y"], "4": ["z"], "5": []})
    assert clusters(clustering.story_clusters(s, m)) == {"1": ["1", "2", "3"], "4": ["4"], "5": ["5"]}


def test_cap_keeps_the_newest(spark):
    s, m = frames(spark, {str(i): ["hub"] for i in range(1, 7)}, {str(i): i for i in range(1, 7)})
    found = clustering.story_clusters(s, m, max_sources=3)
    assert clusters(found) == {"1": ["6", "5", "4"]}
    row = found.first()
    assert (row["size"], row["newest"]) == (3, at(6))


def test_ties_keep_source_order_and_entities_first_seen(spark):
    s, m = frames(spark, {"1": ["b", "a"], "2": ["a", "c"]})
    kept = clustering.newest_sources(clustering.assign_clusters(s, m))
    assert clusters(kept) == {"1": ["1", "2"]}
    found = {r["entity_id"]: r["first_rank"] for r in clustering.cluster_entities(kept, m).collect()}
    assert found == {"a": 1, "b": 1, "c": 2}


def test_empty_window(spark):
    s, m = frames(spark, {"1": ["x"]})
    assert clustering.story_clusters(s.where("false"), m).count() == 0


def test_tenants_never_share_a_story(spark):
    s, m = frames(spark, {"1": ["x"], "2": ["x"]})
    other = s.where("job_id = '1'").withColumns({"kb_id": F.lit("kb2"), "job_id": F.lit("9")})
    m2 = m.unionByName(spark.createDataFrame([("kb2", "x", "9")], MENTION))
    assert clusters(clustering.story_clusters(s.unionByName(other), m2)) == {"1": ["1", "2"], "9": ["9"]}


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_components_follow_union_find(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([20, 200])
    chain = [(i, i + 1) for i in range(1000, 1000 + rng.choice([5, 60]))]
    pairs = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n)) if a != b] + chain
    links = spark.createDataFrame([("kb", max(p), min(p)) for p in pairs], "kb_id string, a long, b long").distinct()
    got = {r["job_id"]: r["cluster_id"] for r in clustering.connected_components(links).collect()}
    assert got == union_find(pairs)


def test_hub_entity_gives_the_same_stories_when_its_partition_is_split(spark):
    """A third of all mentions name one entity; splitting its partition at run time changes nothing."""
    rows = [("kb", "hub", f"{i:04d}") for i in range(300)] + [("kb", f"e{i % 150}", f"{i:04d}") for i in range(300, 900)]
    sources = [("kb", f"{i:04d}", "", at(1), at(1)) for i in range(900)]
    s, m = spark.createDataFrame(sources, SOURCE), spark.createDataFrame(rows, MENTION)
    plain = {r["job_id"]: r["cluster_id"] for r in clustering.assign_clusters(s, m).collect()}
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        split = {r["job_id"]: r["cluster_id"] for r in clustering.assign_clusters(s, m).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert split == plain
    assert sum(c == "0000" for c in split.values()) == 300


# --- issues ---------------------------------------------------------------------------


def issue(spark, stories):
    issues = spark.createDataFrame([("i", at(2), at(1))], "issue_id string, generated_at timestamp, covers_since timestamp")
    rows = spark.createDataFrame(stories, "issue_id string, kb_id string, cluster_id string, story_order string, headline string, body string")
    cited = spark.createDataFrame(
        [("kb", "c1", 1, "A", at(1), None), ("kb", "c1", 2, None, None, None)],
        "kb_id string, cluster_id string, rank int, label string, published_at timestamp, ingested_at timestamp",
    )
    return pages_text.bodies(pages_text.issue_lines(issues, rows, cited), "issue_id")


def test_issue_text(spark):
    body = issue(spark, [("i", "kb", "c1", "0", "Head", "Body")]).first()["body"]
    assert body == (
        "# Issue — 2024-01-02\n\n*Covering 2024-01-01 to 2024-01-02.*\n\n## Head\n\nBody\n\n**Sources:**\n- A — 2024-01-01\n- untitled\n\n"
    )


def test_issue_without_stories(spark):
    body = issue(spark, []).first()["body"]
    assert body == "# Issue — 2024-01-02\n\n*Covering 2024-01-01 to 2024-01-02.*\n\nNo new stories in this window.\n"


def test_long_documents_come_in_parts(spark):
    df = spark.createDataFrame([("i", "kb", "c1", str(n), f"H{n}", "B") for n in range(5)], "issue_id string, kb_id string, cluster_id string, story_order string, headline string, body string")
    issues = spark.createDataFrame([("i", at(2), at(1))], "issue_id string, generated_at timestamp, covers_since timestamp")
    cited = spark.createDataFrame([], "kb_id string, cluster_id string, rank int, label string, published_at timestamp, ingested_at timestamp")
    lines = pages_text.issue_lines(issues, df, cited)
    whole = pages_text.bodies(lines, "issue_id").collect()
    parts = pages_text.bodies(lines, "issue_id", part_lines=3).orderBy("part").collect()
    assert len(whole) == 1 and [p["part"] for p in parts] == list(range(len(parts))) and len(parts) > 10
    assert all(p["body"].count("\n") == 3 for p in parts[:-1])
    assert "".join(p["body"] for p in parts) == whole[0]["body"]


def graph(spark, n=3):
    s, m = frames(spark, {str(i): [f"e{i}"] for i in range(1, n + 1)}, {str(i): i for i in range(1, n + 1)})
    rows = [("kb", f"e{i}", "Person", f"N{i}", None, f"about {i}") for i in range(1, n + 1)]
    return s, m, spark.createDataFrame(rows, "kb_id string, id string, type string, name string, summary string, article string")


def writer(fail=lambda prompt: False):
    def factory():
        return lambda asked: [
            ValueError("no") if fail(r["user"]) else json.dumps({"headline": r["user"].split("\n")[0], "body": "b"}) for r in asked
        ]

    return factory


def marks(spark, ran=None):
    return spark.createDataFrame([("draft_issue", ran)] if ran else [], "key string, ran_at timestamp")


def test_newsroom_run(spark):
    s, m, e = graph(spark)
    draft = newsroom.draft_issue("kb", s, m, e, marks(spark, at(2)), datetime(2024, 1, 5), writer(), limit=2)
    assert draft.report == {"clusters": 2, "stories": 2, "since": at(2), "truncated": True}
    body = pages_text.bodies(draft.lines, "issue_id").first()["body"]
    assert [line for line in body.split("\n") if line.startswith("## ")] == ["## ### N3 (Person)", "## ### N2 (Person)"]
    assert draft.watermarks.first()["ran_at"] == datetime(2024, 1, 5)


def test_issue_is_published_as_markdown(spark, tmp_path):
    s, m, e = graph(spark, 1)
    draft = newsroom.draft_issue("kb", s, m, e, marks(spark, at(1)), datetime(2024, 1, 5, 7, 30), writer(), beat="For {{ issue.date }}")
    row = newsroom.publish(draft, str(tmp_path / "out")).first()
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "slug=2024-01-05-0730").glob("part-*")))
    assert row["story_count"] == 1 and written == row["body"]


def test_failed_stories_are_dropped_and_total_failure_stops(spark):
    s, m, e = graph(spark)
    draft = newsroom.draft_issue("kb", s, m, e, marks(spark, at(1)), datetime(2024, 1, 5), writer(lambda p: "N2" in p))
    assert draft.report["stories"] == 2 and draft.report["clusters"] == 3
    with pytest.raises(RuntimeError, match="watermark is left"):
        newsroom.draft_issue("kb", s, m, e, marks(spark, at(1)), datetime(2024, 1, 5), writer(lambda p: True))


def test_empty_window_still_advances_and_default_is_a_day(spark):
    s, m, e = graph(spark)
    draft = newsroom.draft_issue("kb", s, m, e, marks(spark), datetime(2024, 3, 5), writer())
    assert draft.report == {"clusters": 0, "stories": 0, "since": datetime(2024, 3, 4), "truncated": False}
    assert "No new stories" in pages_text.bodies(draft.lines, "issue_id").first()["body"]
    assert draft.watermarks.count() == 1


def test_every_tenant_has_its_issue_since_its_own_watermark(spark, tmp_path):
    """All tenants at once give what each gives alone; one whose stories all fail keeps its watermark."""
    one, told, named = graph(spark)
    tenants = ["kb", "two", "bad", "idle"]
    split = F.explode(F.array(*map(F.lit, tenants[:3]))).alias("kb_id")
    s, m, e = (df.select(split, *[c for c in df.columns if c != "kb_id"]) for df in (one, told, named))
    e = e.withColumn("name", F.when(F.col("kb_id") == "bad", F.concat(F.lit("bad "), "name")).otherwise(F.col("name")))
    since = {"kb": at(2), "two": at(1), "bad": at(1)}
    before = spark.createDataFrame([(k, "draft_issue", v) for k, v in since.items()] + [("two", "poll", at(3))], "kb_id string, key string, ran_at timestamp")
    now, model = datetime(2024, 1, 5), writer(lambda p: "bad" in p)
    asked = spark.createDataFrame([(k,) for k in [*tenants, "two", None]], "kb_id string")
    drafts = newsroom.draft_issues(asked, s, m, e, before, now, model, beat="For {{ issue.date }} from {{ issue.since }}")
    reports = {r["kb_id"]: (r["clusters"], r["stories"], r["failed"], r["covers_since"]) for r in drafts.reports.collect()}
    assert reports == {"kb": (2, 2, False, at(2)), "two": (3, 3, False, at(1)), "bad": (3, 0, True, at(1)), "idle": (0, 0, False, datetime(2024, 1, 4))}
    bodies = {r["kb_id"]: r["body"] for r in newsroom.publish_all(drafts, str(tmp_path / "out")).collect()}
    assert set(bodies) == {"kb", "two", "idle"}
    for kb in ("kb", "two"):
        alone = newsroom.draft_issue(kb, s, m, e, marks(spark, since[kb]), now, model)
        assert pages_text.bodies(alone.lines, "issue_id").first()["body"] == bodies[kb]
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "slug=2024-01-05-0000-two").glob("part-*")))
    assert written == bodies["two"]
    after = {(r["kb_id"], r["key"]): r["ran_at"] for r in drafts.watermarks.collect()}
    assert after == {("kb", "draft_issue"): now, ("two", "draft_issue"): now, ("idle", "draft_issue"): now, ("bad", "draft_issue"): at(1), ("two", "poll"): at(3)}


def test_issue_reads(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 0, 1), "# T\n\n## One  \n"), (2, datetime(2024, 1, 1, 0, 0, 9), "### deep"), (3, datetime(2024, 1, 2), None)]
    issues = spark.createDataFrame(rows, "issue_id int, generated_at timestamp, body string")
    listed = {r["issue_id"]: (r["slug"], r["headline"]) for r in pages_text.list_issues(issues).collect()}
    assert listed == {1: ("2024-01-01-0000", "One"), 2: ("2024-01-01-0000", "Untitled issue")}
    assert [r["issue_id"] for r in pages_text.issues_by_slug(issues).collect()] == [2]


def test_rounds_run_over_one_link_of_each_source(spark, monkeypatch):
    """The many links of sources that share many entities do not go through the rounds."""
    rng = random.Random(5)
    named = {f"{i:03d}": [f"e{rng.randrange(60)}" for _ in range(6)] for i in range(150)}
    named |= {f"{i:03d}": [f"f{i // 2}", f"f{(i + 1) // 2}"] for i in range(400, 430)}
    named |= {"900": ["p"], "901": ["p", "q"], "800": ["q"], "902": ["q", "r"], "700": ["r", "s"], "903": ["s"], "600": []}
    s, m = frames(spark, named)
    sizes, step = [], clustering.connected_components

    def counting(links, *a, **b):
        sizes.append(links.count())
        return step(links, *a, **b)

    monkeypatch.setattr(clustering, "connected_components", counting)
    got = {r["job_id"]: r["cluster_id"] for r in clustering.assign_clusters(s, m).collect()}
    least = {}
    for j, es in sorted(named.items()):
        for e in es:
            least.setdefault(e, j)
    found = union_find([(j, least[e]) for j, es in named.items() for e in es])
    assert got == {j: found.get(j, j) for j in named}
    assert sum(sizes) <= len(named) < clustering.source_links(m).count()
