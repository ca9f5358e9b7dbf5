"""Claim gate, evidence, verdicts, reports, and the claim desk end to end."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import markdown as md
from loomgraph.operators import claims, infer, pages_text
from loomgraph.plans import claimdesk
from loomgraph.schemas import JUDGMENT

NOW = datetime(2024, 6, 1)


def gate(spark, rows):
    df = spark.createDataFrame([("d", i, t, s) for i, (t, s) in enumerate(rows)], "document_id string, pos int, claim_type string, checkworthiness double")
    return [r["selected"] for r in claims.select_for_verification(df).orderBy("pos").collect()]


def test_gate(spark):
    assert gate(spark, [("empirical", 0.9), ("opinion", 0.99), ("empirical", 0.39), ("empirical", 0.4), ("predictive", 0.9)]) == [True, False, False, True, False]
    many = [("empirical", 0.5 + i / 1000) for i in range(11)]
    assert gate(spark, many) == [False] * 3 + [True] * 8
    assert gate(spark, [("empirical", 0.5)] * 9) == [True] * 8 + [False]
    assert gate(spark, [("empirical", 0.1)] * 3) == [False] * 3


def test_citations(spark):
    notes = [
        '[{"type":"url_citation","url_citation":{"url":"https://a.org"}},{"type":"url_citation","url_citation":{"url":""}},{"type":"url_citation","url_citation":{"url":"https://a.org"}}]',
        '[{"type":"file","url_citation":{"url":"https://a.org"}}]', "[]", None, '{"type":"url_citation"}',
    ]
    df = spark.createDataFrame(list(enumerate(notes)), "i int, n string")
    urls, had = claims.citations(F.col("n"))
    got = [(r["u"], r["h"]) for r in df.orderBy("i").select(urls.alias("u"), had.alias("h")).collect()]
    assert got == [(["https://a.org"], True), ([], True), ([], False), ([], False), ([], False)]


def evidence(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, call int, pos int, url string, stance string")


def test_each_call_is_grounded_on_its_own_citations(spark):
    items = evidence(spark, [
        ("c", 0, 0, "https://real.org/a?utm_source=x", "supports"), ("c", 0, 1, "https://invented.org", "supports"), ("c", 1, 0, "https://real.org/a", "contradicts"),
        ("d", 0, 0, "https://anything.org", "supports"), ("e", 0, 0, "https://x.org", "supports"),
    ])
    calls = spark.createDataFrame(
        [("c", 0, ["https://real.org/a/"], True), ("c", 1, ["https://other.org"], True), ("d", 0, [], False), ("e", 0, [], True)],
        "claim_id string, call int, citation_urls array<string>, had_annotations boolean",
    )
    got = {(r["claim_id"], r["call"], r["pos"]) for r in claims.ground(items, calls).collect()}
    assert got == {("c", 0, 0), ("d", 0, 0)}


def test_evidence_collapses_by_page_and_stance(spark):
    items = evidence(spark, [
        ("c", 1, 0, "https://a.org/p/", "supports"), ("c", 0, 0, "https://a.org/p", "supports"), ("c", 0, 1, "https://a.org/p#x", "contradicts"), ("c", 0, 2, "https://a.org/p", "odd"), ("c", 1, 1, "https://a.org/p", "context"),
    ])
    calls = spark.createDataFrame([("c", 0, [], False), ("c", 1, [], False)], "claim_id string, call int, citation_urls array<string>, had_annotations boolean")
    got = [(r["call"], r["pos"], r["stance"]) for r in claims.pool_evidence(items, calls).orderBy("call", "pos").collect()]
    assert got == [(0, 0, "supports"), (0, 1, "contradicts"), (0, 2, "context")]


CLAIM = (
    "document_id string, claim_id string, text string, claim_type string, checkworthiness double, selected boolean, attempts int, error string, verdict string, "
    "confidence double, rationale string, attributed_to string, attribution_type string, cited_source string, cited_source_url string, verified_at timestamp"
)


def claim(i, **over):
    base = dict(document_id="d", claim_id=f"c{i}", text=f"T{i}", claim_type="empirical", checkworthiness=0.9 - i / 100, selected=True, attempts=0, error=None, verdict=None,
                confidence=None, rationale=None, attributed_to=None, attribution_type=None, cited_source=None, cited_source_url=None, verified_at=None)
    return tuple({**base, **over}.values())


def document(spark, *ids, **over):
    rows = [(i, over.get("title"), f"https://e.org/{i}", over.get("author"), over.get("published_at"), NOW, None) for i in ids]
    return spark.createDataFrame(rows, "document_id string, title string, canonical_url string, author string, published_at timestamp, extracted_at timestamp, reported_at timestamp")


def test_report(spark):
    rows = [
        claim(1, verdict="refuted", confidence=0.875, rationale="R", attributed_to="Ann", attribution_type="quoted_person", cited_source="Study", cited_source_url="https://s.org"),
        claim(2, attempts=3, error="timeout"), claim(3, attempts=3), claim(4, claim_type="opinion", selected=False),
        claim(5, checkworthiness=0.39, selected=False), claim(6, selected=False),
    ]
    found = spark.createDataFrame([("c1", "1", "contradicts", "P", "https://p.org", "said"), ("c1", "2", "odd", None, "https://q.org", None)], "claim_id string, evidence_order string, stance string, title string, url string, snippet string")
    lines = pages_text.report_lines(document(spark, "d", title="My: Doc", author="Bo", published_at=datetime(2024, 1, 2)), spark.createDataFrame(rows, CLAIM), found, F.lit(NOW))
    assert pages_text.bodies(lines, "document_id").first()["body"] == (
        "# Claim check — My: Doc\n\nhttps://e.org/d · Bo · published 2024-01-02 · checked 2024-06-01\n\n*6 claims extracted · 1 checked · 1 refuted.*\n\n"
        '## "T1"\n\nAttributed to Ann (quoted person) · citing [Study](https://s.org)\n\n**Refuted** · confidence 0.88\n\nR\n\n'
        '- **Contradicting:** [P](https://p.org) — "said"\n- **odd:** [https://q.org](https://q.org)\n\n## Not checked\n\n'
        '- "T2" — could not be checked: timeout\n- "T3" — could not be checked: unknown error\n- "T4" — opinion\n- "T6" — not among the 8 most checkworthy claims\n'
        '- "T5" — below the checkworthiness floor (0.39)\n\n'
    )


def test_report_without_claims(spark):
    lines = pages_text.report_lines(document(spark, "d"), spark.createDataFrame([], CLAIM), spark.createDataFrame([], "claim_id string, evidence_order string, stance string, title string, url string, snippet string"), F.lit(NOW))
    body = pages_text.bodies(lines, "document_id").first()["body"]
    assert body == "# Claim check — https://e.org/d\n\nhttps://e.org/d · checked 2024-06-01\n\n*0 claims extracted · 0 checked · none checked.*\n\n"


def test_two_decimals_follow_the_binary_value(spark):
    values = [0.125, 0.015, 0.375, 0.005, 0.5, 1.0, 0.999]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(md.two_decimals(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]


def test_reportable_documents(spark):
    rows = [claim(1, document_id="a"), claim(2, document_id="b", attempts=3), claim(3, document_id="c", verdict="refuted")]
    docs = document(spark, "a", "b", "c", "none")
    assert {r["document_id"] for r in claims.reportable(docs, spark.createDataFrame(rows, CLAIM)).collect()} == {"b", "c", "none"}
    # The batch is cut first: blocked documents take places.
    assert claims.reportable(docs, spark.createDataFrame(rows, CLAIM), n=1).count() == 0


def test_verdict_writes(spark):
    table = spark.createDataFrame([claim(1, error="old"), claim(2), claim(3, attempts=2), claim(4)], CLAIM)
    rows = [("c1", "supported", 0.5, "r", None), ("c2", "maybe", 0.5, "r", None), ("c3", None, None, None, "x" * 2000)]
    out = spark.createDataFrame(rows, "claim_id string, new_verdict string, new_confidence double, new_rationale string, message string")
    got = {r["claim_id"]: r for r in claims.apply_verdicts(table, out, F.lit(NOW)).collect()}
    assert (got["c1"]["verdict"], got["c1"]["error"], got["c1"]["verified_at"]) == ("supported", None, NOW)
    assert (got["c2"]["verdict"], got["c2"]["attempts"]) == (None, 1) and "not a verdict: 'maybe'" in got["c2"]["error"]
    assert (got["c3"]["verdict"], got["c3"]["attempts"], len(got["c3"]["error"])) == (None, 3, 1000)
    assert got["c4"]["attempts"] == 0


@pytest.mark.parametrize(
    ("raw", "ok"),
    [('{"verdict":"x","confidence":0.5,"rationale":"r"}', True), ('{"verdict":"x","confidence":1.5,"rationale":"r"}', False), ('{"verdict":"x","confidence":0.5}', False), ("not json", False), ("", False), (None, False)],
)
def test_answers_are_validated(spark, raw, ok):
    value, error = infer.parsed(F.col("a"), JUDGMENT, infer.valid_judgment)
    row = spark.createDataFrame([(raw,)], "a string").select(value.alias("v"), error.alias("e")).first()
    assert (row["v"] is not None, row["e"] is None) == (ok, ok)


def test_response_checks(spark):
    raws = ['{"choices":[]}', '{"choices":[{"finish_reason":"length","message":{"content":"x"}}]}', '{"choices":[{"finish_reason":"stop","message":{"content":"  "}}]}',
            '{"choices":[{"finish_reason":"stop","message":{"content":"hi","annotations":[{"type":"url_citation"}]}}]}', "oops"]
    content, notes, error = infer.response_content(F.col("r"))
    df = spark.createDataFrame(list(enumerate(raws)), "i int, r string").orderBy("i")
    got = [tuple(r) for r in df.select(content, notes, error).collect()]
    assert [g[0] for g in got] == [None, None, None, "hi", None]
    assert "no choice" in got[0][2] and "length limit" in got[1][2] and "blank" in got[2][2] and got[3][2] is None and got[4][2]
    assert "url_citation" in got[3][1]


def chat(content, *urls):
    notes = [{"type": "url_citation", "url_citation": {"url": u}} for u in urls]
    return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(content), "annotations": notes}}]})


def test_claim_desk(spark):
    docs = spark.createDataFrame(
        [("d1", "T", "Water is wet. " * 50, 0, None, None), ("d2", None, "bad", 2, "e", None)],
        "document_id string, title string, full_text string, attempts int, error string, extracted_at timestamp",
    )

    def extractor():
        def one(r):
            if r["user"] == "bad":
                return json.dumps({"claims": [{"text": "t", "claim_type": "rumour", "checkworthiness": 0.5}]})
            assert r["user"].startswith("# T\n\nWater")
            return json.dumps({"claims": [{"text": "wet", "claim_type": "empirical", "checkworthiness": 0.9, "quote": "Water is wet."}, {"text": "nice", "claim_type": "opinion", "checkworthiness": 1.0}]})

        return lambda asked: [one(r) for r in asked]

    made, stamped = claimdesk.extract(docs, extractor, F.lit(NOW))
    assert {(r["pos"], r["selected"]) for r in made.collect()} == {(0, True), (1, False)}
    state = {r["document_id"]: r for r in stamped.collect()}
    assert state["d1"]["extracted_at"] == NOW and state["d2"]["extracted_at"] is None and state["d2"]["attempts"] == 3

    def support():
        item = {"url": "https://a.org/?utm_source=x", "stance": "supports", "snippet": "s"}
        return lambda asked: [chat({"evidence": [item, {**item, "url": "https://fake.org"}]}, "https://a.org/") for _ in asked]

    def oppose():
        return lambda asked: [chat({"evidence": []}) for _ in asked]

    def judge():
        def one(r):
            assert "[supports] untitled — https://a.org/?utm_source=x\ns" in r["user"] and "fake" not in r["user"]
            return json.dumps({"verdict": "supported", "confidence": 0.7, "rationale": "because"})

        return lambda asked: [one(r) for r in asked]

    def broken():
        return lambda asked: [TimeoutError("slow") for _ in asked]

    due = claims.claims_to_verify(made)
    found, outcomes = claimdesk.verify(due, docs, support, oppose, judge)
    after = {r["pos"]: r for r in claims.apply_verdicts(made, outcomes, F.lit(NOW)).collect()}
    assert after[0]["verdict"] == "supported" and after[1]["verdict"] is None
    assert [r["url"] for r in found.collect()] == ["https://a.org/?utm_source=x"]
    found, outcomes = claimdesk.verify(due, docs, support, broken, judge)
    after = {r["pos"]: r for r in claims.apply_verdicts(made, outcomes, F.lit(NOW)).collect()}
    assert (after[0]["verdict"], after[0]["attempts"], after[0]["error"]) == (None, 1, "slow")
    assert found.count() == 0


def test_report_sweep(spark, tmp_path):
    docs = document(spark, "a", "b", title="My Doc!")
    rows = [claim(1, document_id="a", verdict="refuted", confidence=0.5, rationale="R"), claim(2, document_id="b")]
    found = spark.createDataFrame([("c1", 0, 1, "u2", None, None, "context"), ("c1", 0, 0, "u1", None, None, "context")], "claim_id string, call int, pos int, url string, title string, snippet string, stance string")
    reports, stamped = claimdesk.report(docs, spark.createDataFrame(rows, CLAIM), found, F.lit(NOW), str(tmp_path / "out"))
    row = reports.collect()
    assert [(r["document_id"], r["slug"], r["claim_count"], r["verified_count"], r["part"]) for r in row] == [("a", "my-doc-2024-06-01-000000-ca978112ca", 1, 1, 0)]
    assert row[0]["body"].index("(u1)") < row[0]["body"].index("(u2)")
    assert {r["document_id"]: r["reported_at"] for r in stamped.collect()} == {"a": NOW, "b": None}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["slug=my-doc-2024-06-01-000000-ca978112ca"]
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "slug=my-doc-2024-06-01-000000-ca978112ca").glob("part-*")))
    assert written == row[0]["body"]
