"""Candidates, resolution, identities and vocabulary."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import type_key
from loomgraph.operators import prompts, resolution, vocabulary
from loomgraph.operators.search import search
from loomgraph.operators.skew import gathered, running_last
from loomgraph.schemas import TYPE_DEF


def brute_force(entities, queries, k):
    """BM25 by the book, pair by pair."""
    out = {}
    for kb, text in queries:
        docs = {i: n.lower().split() for b, i, n in entities if b == kb}
        average = sum(map(len, docs.values())) / max(len(docs), 1)
        df = Counter(t for tokens in docs.values() for t in set(tokens))
        scores = {}
        for i, tokens in docs.items():
            for t in sorted(set(text.lower().split())):
                tf = tokens.count(t)
                if tf:
                    idf = math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                    scores[i] = scores.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / average))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
        out[kb, text] = best
    return out


def test_search_is_exact_with_hot_tokens(spark):
    """A token in most names, equal names, and every split between rare and frequent tokens."""
    rng = random.Random(7)
    words = ["smith"] * 12 + ["ann", "bob", "cy", "dee", "eve", "flo", "gus"] + [f"w{i}" for i in range(40)]
    entities = [(kb, f"{kb}{i:03d}", " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4])))) for kb in "ab" for i in range(150)]
    queries = sorted({(kb, " ".join(rng.choices(words, k=rng.choice([1, 2, 3])))) for kb in "ab" for _ in range(60)})
    e = spark.createDataFrame(entities, "kb_id string, id string, name string").withColumn("aliases", F.array().cast("array<string>"))
    q = spark.createDataFrame(queries, "kb_id string, text string")
    want = {k: v for k, v in brute_force(entities, queries, 5).items() if v}
    for rare, block in ((0, 20_000), (0, 7), (3, 20), (1000, 20_000)):
        got = {}
        for r in search(q, e, ["kb_id"], 5, rare, block).orderBy("rank").collect():
            got.setdefault((r["kb_id"], r["text"]), []).append(r["id"])
        assert got == want, rare


def test_blocks_out_of_reach_are_not_opened(spark):
    """Long names with frequent tokens cannot reach the threshold that short ones set."""
    rng = random.Random(5)
    entities = [("a", f"{i:04d}", " ".join(rng.sample(["red", "green", "blue"], 2) + ["x"] * (0 if i < 40 else 30 + i % 3))) for i in range(600)]
    e = spark.createDataFrame(entities, "kb_id string, id string, name string").withColumn("aliases", F.array().cast("array<string>"))
    q = spark.createDataFrame([("a", "red green"), ("a", "blue"), ("a", "red green blue")], "kb_id string, text string")
    found = search(q, e, ["kb_id"], 5, 0)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r["kb_id"], r["text"]), []).append(r["id"])
    assert got == brute_force(entities, [("a", "red green"), ("a", "blue"), ("a", "red green blue")], 5)


def test_exact_candidates_are_capped_per_name(spark):
    rows = [("a", "T", f"{i:02d}", "Same  Name" if i % 2 else "x", ["same name"] if i % 2 == 0 else []) for i in range(20)] + [("a", "U", "zz", "same name", []), ("b", "T", "yy", "same name", [])]
    entities = spark.createDataFrame(rows, "kb_id string, type string, id string, name string, aliases array<string>")
    names = spark.createDataFrame([("a", "T", "SAME name")] * 5, "kb_id string, type string, name string")
    got = resolution.exact_candidates(names, entities).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["00", "01", "02", "03", "04"]


MENTION = "kb_id string, job_id string, pos int, name string, type string, description string"


def test_only_offered_ids_are_accepted_and_the_last_answer_wins(spark):
    mentions = spark.createDataFrame([("a", "j", i, f"n{i}", "T", "") for i in range(4)], MENTION)
    offered = spark.createDataFrame([("j", 0, "x"), ("j", 0, "y"), ("j", 1, "x")], "job_id string, pos int, id string")
    rows = [("j", 0, "x", 0), ("j", 0, "y", 1), ("j", 0, "NEW", 2), ("j", 1, "y", 3), ("j", 2, "x", 4)]
    answers = spark.createDataFrame(rows, "job_id string, index int, id string, answer_pos int")
    got = {r["pos"]: r["existing_id"] for r in resolution.resolve(mentions, offered, answers).collect()}
    assert got == {0: "y", 1: None, 2: None, 3: None}


def test_candidates_and_answers_move_once(spark):
    """One row for each mention is shuffled on either side, and the join needs no further one; repeats and nulls count as before."""
    offered = [("j", i % 3, f"e{i}") for i in range(9)] * 3 + [(None, 0, "e0"), ("j", None, "e0"), ("j", 0, None)]
    given = [("j", i % 3, f"e{i}", i) for i in (8, 0, 4, 7, 3)] * 2 + [("j", 0, "e3", 1), (None, 0, "e0", 50), ("j", None, "e0", 50), ("j", 0, None, 50), ("j", 1, "e1", None)]
    offered = spark.createDataFrame(offered, "job_id string, pos int, id string")
    answers = spark.createDataFrame(given, "job_id string, index int, id string, answer_pos int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = resolution.accepted(offered, answers)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, found.collect())) == [("j", 0, "e3"), ("j", 1, "e7"), ("j", 2, "e8")]
    finally:
        spark.conf.set(key, before)


def test_repeats_share_an_identity(spark):
    rows = [("a", "j", 0, "Atmos Embassy", "Org", None), ("a", "j", 1, "atmos  embassy", "Org", None), ("a", "j", 2, "Atmos embassy", "Product", None),
            ("a", "j", 3, "ATMOS embassy", "Org", "X"), ("a", "j", 4, "atmos embassy", "Org", None), ("a", "k", 0, "Atmos Embassy", "Org", None)]
    mentions = spark.createDataFrame(rows, "kb_id string, job_id string, pos int, name string, type string, existing_id string")
    found = resolution.batch_identity(mentions)
    ids = {(r["job_id"], r["pos"]): r["entity_id"] for r in found.collect()}
    assert ids["j", 0] == ids["j", 1] and ids["j", 3] == ids["j", 4] == "X"
    assert len({ids["j", 0], ids["j", 2], ids["k", 0], "X"}) == 4
    counts = {r["job_id"]: (r["entities_created"], r["entities_merged"]) for r in resolution.merge_counts(found).collect()}
    assert counts == {"j": (2, 3), "k": (1, 0)}
    shared = {(r["job_id"], r["pos"]): r["entity_id"] for r in resolution.batch_identity(mentions, "b").collect()}
    assert shared["j", 0] == shared["k", 0]
    assert resolution.name_ids(found).where("job_id = 'j'").first()["entity_id"] == "X"


def test_running_last_over_chunk_borders(spark):
    rng = random.Random(3)
    rows = [(k, p, rng.choice([None, None, f"v{p}"])) for k in "ab" for p in rng.sample(range(300), 200)]
    df = spark.createDataFrame(rows, "k string, p int, v string")
    got = {(r["k"], r["p"]): r["last"] for r in running_last(df, ["k"], "p", "v", "last", chunk=7).collect()}
    want = {}
    for k in "ab":
        last = None
        for _, p, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = v or last
            want[k, p] = last
    assert got == want


@pytest.mark.parametrize("n", [3, 1000, 5000])
def test_lists_are_whole_and_in_order(spark, n):
    df = spark.range(2 * n).select((F.col("id") % 2).alias("k"), (-F.col("id")).alias("o"), "id")
    got = {r["k"]: (r["items"], r["n"]) for r in gathered(df, ["k"], ["o"], F.col("id")).collect()}
    assert got == {k: (list(range(2 * n - 2 + k, -1, -2)), n) for k in (0, 1)}


@pytest.mark.parametrize("n", [1000, 5000])
def test_jobs_of_any_size_mint_their_types_and_are_asked_about(spark, n):
    def name(i):
        return "".join("ABCDEFGHIJ"[int(d)] for d in str(10_000 + i))

    mentions = spark.createDataFrame([("a", "j", i, f"m{i}", name(i)) for i in range(n)], "kb_id string, job_id string, pos int, name string, type string")
    known = spark.createDataFrame([("a", 0, "Known", "", False, False)], "kb_id string, ord int, name string, description string, pinned boolean, banned boolean")
    types = known.withColumn("key", type_key(F.col("name")))
    novel = vocabulary.unmatched(mentions, types)
    decided = novel.select("job_id", "key", F.lit("new").alias("decision"), F.lit("").alias("canonical"), F.lower("type").alias("name"), F.lit("d").alias("description"))
    minted = vocabulary.minted_types(mentions, types, decided)
    assert minted.count() == n and vocabulary.resolve_types(mentions, types, decided, minted).count() == n
    listed = novel.join(vocabulary.type_examples(mentions, F.col("name")), ["kb_id", "job_id", "type"])
    batch = spark.createDataFrame([("a", "j", "words", [])], f"kb_id string, job_id string, interests string, entity_types array<{TYPE_DEF.simpleString()}>")
    assert prompts.consolidation("entity", listed, batch, "entity_types").first()["user"].count("\n") == n
    offered = mentions.select("*", F.lit("").alias("description"), F.lit(1).alias("rank"), F.lit("x").alias("id"), F.lit("c").alias("candidate_name"), F.lit("s").alias("candidate_summary"))
    assert prompts.resolution(offered).first()["user"].count("id=x") == n
    claims = spark.createDataFrame([("c",)], "claim_id string")
    evidence = spark.range(n).select(F.lit("c").alias("claim_id"), F.lit(0).alias("call"), F.col("id").alias("pos"), *(F.lit("v").alias(c) for c in ("stance", "title", "url", "snippet")), F.lit(None).cast("string").alias("published_at"))
    assert prompts.evidence_text(claims, evidence).first()["evidence_text"].count("\n\n") == n - 1


def test_identities_are_given_in_one_pass(spark):
    """Mentions move once, by their job at most; later ones take the latest id known, and rows without place drop out."""
    rows = [("a", "j", 0, "T", "Ada", None), ("a", "j", 1, "T", "ada ", "1"), ("a", "j", 2, "T", "ADA", None), ("a", "k", 0, "T", "Ada", None), (None, "k", 1, "T", "Ada", "9"), ("a", "k", None, "T", "Ada", "9")]
    m = spark.createDataFrame(rows, "kb_id string, job_id string, pos int, type string, name string, existing_id string")
    found = resolution.batch_identity(m, "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    got = {(r["job_id"], r["pos"]): r["entity_id"] for r in found.collect()}
    assert set(got) == {("j", 0), ("j", 1), ("j", 2), ("k", 0)}
    assert got["j", 1] == got["j", 2] == "1" and got["j", 0] == got["k", 0] != "1"


def test_relationship_ends(spark):
    ids = spark.createDataFrame([("a", "j", "ada", "1"), ("a", "j", "engine", "2")], "kb_id string, job_id string, name_normalized string, entity_id string")
    rows = [("a", "j", 0, " ADA", "Engine", "t"), ("a", "j", 1, "Ada", "Nobody", "t"), ("a", "j", 2, "ada", "Ada", "t"), ("b", "j", 3, "Ada", "Engine", "t")]
    rel = spark.createDataFrame(rows, "kb_id string, job_id string, pos int, source_name string, target_name string, type string")
    got = {r["pos"]: (r["source_id"], r["target_id"]) for r in resolution.relationship_endpoints(rel, ids).collect()}
    assert got == {0: ("1", "2"), 2: ("1", "1")}


# --- vocabulary ---------------------------------------------------------------------


def fold(name):
    return "".join(ch for ch in name.upper() if ch.isalnum())


def sequential(mentions, types, decided):
    """The definition, one mention after the other."""
    known = {fold(n): n for n, banned in types if not banned}
    banned = {fold(n) for n, b in types if b}
    out, added = [], []
    for t in mentions:
        key, d = fold(t), decided.get(fold(t))
        if key in known:
            out.append(known[key])
        elif key in banned or not d or d[0] == "drop":
            out.append(None)
        elif d[0] == "existing":
            out.append(known.get(fold(d[1])))
        elif fold(d[1]) in banned:
            out.append(None)
        else:
            if fold(d[1]) not in known:
                known[fold(d[1])] = d[1]
                added.append(d[1])
            out.append(known[fold(d[1])])
    return out, added


def test_type_resolution_follows_the_order_of_mentions(spark):
    rng = random.Random(11)
    pool = [f"T{c}" for c in "abcdefgh"] + ["t-a", "TB "]
    jobs, types = {}, [("Ta", False), ("Tb", True), ("t c", False)]
    decided = {}
    for j in range(60):
        jobs[f"j{j}"] = rng.choices(pool, k=rng.choice([1, 4, 9]))
        decided[f"j{j}"] = {fold(n): (rng.choice(["existing", "new", "drop"]), rng.choice(pool)) for n in pool if rng.random() < 0.8}
    m = spark.createDataFrame([("a", j, p, t) for j, ts in jobs.items() for p, t in enumerate(ts)], "kb_id string, job_id string, pos int, type string")
    v = spark.createDataFrame([("a", i, n, "", False, b) for i, (n, b) in enumerate(types)], "kb_id string, ord int, name string, description string, pinned boolean, banned boolean").withColumn("key", type_key(F.col("name")))
    d = spark.createDataFrame([(j, k, x, n, n, "d") for j, ds in decided.items() for k, (x, n) in ds.items()], "job_id string, key string, decision string, canonical string, name string, description string")
    minted = vocabulary.minted_types(m, v, d)
    got = {(r["job_id"], r["pos"]): r["type"] for r in vocabulary.resolve_types(m, v, d, minted).collect()}
    added = {}
    for r in minted.orderBy("mint_pos").collect():
        added.setdefault(r["job_id"], []).append(r["name"])
    for j, ts in jobs.items():
        want, new = sequential(ts, types, decided[j])
        assert [got.get((j, p)) for p in range(len(ts))] == want, j
        assert added.get(j, []) == new, j


def test_type_resolution_moves_texts_once(spark):
    """Types are looked up without the texts of their mentions, and what has no goal does not meet in one task."""
    m = spark.createDataFrame([("a", j, p, t, "text") for j in ("1", "2", None) for p, t in enumerate(["Ta", "Xy", "Tb", "New"])], "kb_id string, job_id string, pos int, type string, told string")
    v = spark.createDataFrame([("a", i, n, "", False, b) for i, (n, b) in enumerate([("Ta", False), ("Tb", True)])], "kb_id string, ord int, name string, description string, pinned boolean, banned boolean").withColumn("key", type_key(F.col("name")))
    d = spark.createDataFrame([("1", "XY", "existing", "ta", None, None), ("1", "NEW", "new", None, "Place", "d"), ("2", "NEW", "drop", None, None, None)], "job_id string, key string, decision string, canonical string, name string, description string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vocabulary.resolve_types(m, v, d, vocabulary.minted_types(m, v, d))
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = sorted((r["job_id"] or "", r["pos"], r["type"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("", 0, "Ta"), ("1", 0, "Ta"), ("1", 1, "Ta"), ("1", 3, "Place"), ("2", 0, "Ta")]
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part.partition("\n")[0] and "told#" in part]
    assert len(moved) == 1


def test_echo_with_example_suffix(spark):
    c = spark.createDataFrame([("j", "Time Window"), ("j", "Time"), ("j", "Law")], "job_id string, type string")
    rows = [("j", 'Time Window (e.g. "x")', 0), ("j", "time", 1), ("j", "Lawsuit", 2), ("j", "Unknown", 3)]
    got = {r["candidate"]: r["key"] for r in vocabulary.match_echoes(c, spark.createDataFrame(rows, "job_id string, candidate string, answer_pos int")).collect()}
    assert got == {'Time Window (e.g. "x")': "TIMEWINDOW", "time": "TIME", "Lawsuit": "LAW", "Unknown": "UNKNOWN"}


def test_appended_types_lose_flags_and_repeats(spark):
    old = spark.createDataFrame([("a", 0, "Person", "d", True, False), ("a", 1, "person", "twice", False, True)], "kb_id string, ord int, name string, description string, pinned boolean, banned boolean").withColumn("key", type_key(F.col("name")))
    new = spark.createDataFrame([("a", 0, "PERSON", "x"), ("a", 1, "Place", None), ("a", 2, "place", "later")], "kb_id string, add_pos int, name string, description string")
    got = [(r["name"], r["description"], r["pinned"], r["banned"]) for r in vocabulary.append_types(old, new).orderBy("ord").collect()]
    assert got == [("Person", "d", True, False), ("person", "twice", False, True), ("Place", "", False, False)]
