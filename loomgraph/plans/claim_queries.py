"""Claim checking: claims = document lines, evidence = pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions import markdown as md
from loomgraph.operators import claims, infer, pages_text, prompts
from loomgraph.operators.news import counters
from loomgraph.plans import claimdesk, rules
from loomgraph.plans.oracle_views import CLAIMS
from loomgraph.plans.registry import query
from loomgraph.plans.text_queries import CANONICAL
from loomgraph.sources.tables import Tables

RUN = "2024-06-01"


def _stamp() -> F.Column:
    return F.lit(RUN).cast("timestamp")


def _text(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _big(name: str) -> F.Column:
    return F.col(name).cast("bigint").alias(name)


def _claims(t: Tables) -> DataFrame:
    return t.claims().withColumnRenamed("doc_id", "document_id")


def _claim_id() -> F.Column:
    return F.concat(F.lpad(F.col("document_id").cast("string"), 9, "0"), F.lit("/"), F.lpad(F.col("pos").cast("string"), 6, "0"))


_CLAIM_ID = "concat(lpad(document_id::VARCHAR, 9, '0'), '/', lpad(pos::VARCHAR, 6, '0'))"

_GATED = f"""{CLAIMS},
gated AS (
  SELECT c.*, {_CLAIM_ID} AS claim_id, coalesce(r <= 8, false) AS selected FROM claims c LEFT JOIN (
    SELECT document_id, pos, row_number() OVER (PARTITION BY document_id ORDER BY checkworthiness DESC, pos) AS r
    FROM claims WHERE claim_type = 'empirical' AND checkworthiness >= 0.4) g USING (document_id, pos))"""


@query(f"WITH {_GATED} SELECT document_id, pos, selected FROM gated")
def claim_gate(t: Tables) -> DataFrame:
    return claims.select_for_verification(_claims(t)).select("document_id", "pos", "selected")


# --- verdict states ------------------------------------------------------------------


def _checked(t: Tables) -> DataFrame:
    """Gated claims in all states: judged, failed, waiting, never selected."""
    gated = claims.select_for_verification(_claims(t))
    doc, pos = F.col("document_id"), F.col("pos")
    kind = (doc + pos) % 7
    verdicts = F.array(*(F.lit(v) for v in ("supported", "disputed", "refuted", "unverifiable")))
    judged = F.col("selected") & (kind < 4)
    return gated.select(
        "document_id", _claim_id().alias("claim_id"), "text", "claim_type", "checkworthiness", "selected",
        F.when(judged, F.element_at(verdicts, (kind + 1).cast("int"))).alias("verdict"),
        F.when(judged & (kind > 0), (pos % 90 + 10) / 100.0).alias("confidence"),
        F.when(judged, F.concat(F.lit("because of "), kind)).alias("rationale"),
        F.when(kind == 4, 3).when(kind == 5, doc % 3).otherwise(3).cast("int").alias("attempts"),
        F.when(kind == 4, "the call failed").alias("error"), F.lit(None).cast("timestamp").alias("verified_at"),
        F.when(pos % 3 == 0, F.concat(F.lit("Speaker "), doc)).alias("attributed_to"),
        F.when(pos % 3 == 0, "quoted_person").alias("attribution_type"),
        F.when(pos % 2 == 0, "The Study").alias("cited_source"), F.when(pos % 4 == 0, "https://study.example.org").alias("cited_source_url"),
    )


_CHECKED = f"""{_GATED},
checked AS (
  SELECT document_id, pos, claim_id, text, claim_type, checkworthiness, selected,
    CASE WHEN selected AND k < 4 THEN ['supported', 'disputed', 'refuted', 'unverifiable'][(k + 1)::INTEGER] END AS verdict,
    CASE WHEN selected AND k BETWEEN 1 AND 3 THEN (pos % 90 + 10) / 100.0 END AS confidence,
    CASE WHEN selected AND k < 4 THEN concat('because of ', k) END AS rationale,
    CASE WHEN k = 5 THEN document_id % 3 ELSE 3 END AS attempts, CASE WHEN k = 4 THEN 'the call failed' END AS error,
    CASE WHEN pos % 3 = 0 THEN concat('Speaker ', document_id) END AS attributed_to, CASE WHEN pos % 3 = 0 THEN 'quoted_person' END AS attribution_type,
    CASE WHEN pos % 2 = 0 THEN 'The Study' END AS cited_source, CASE WHEN pos % 4 = 0 THEN 'https://study.example.org' END AS cited_source_url
  FROM (SELECT *, (document_id + pos) % 7 AS k FROM gated))"""


@query(
    f"""WITH {_CHECKED}, per AS (SELECT document_id, verdict, count(*) AS n FROM checked GROUP BY 1, 2)
SELECT document_id, sum(n)::BIGINT AS claim_count, coalesce(sum(n) FILTER (verdict IS NOT NULL), 0)::BIGINT AS verified_count,
  coalesce(string_agg(concat(n, ' ', verdict), ', ' ORDER BY verdict) FILTER (verdict IS NOT NULL), 'none checked') AS summary FROM per GROUP BY 1"""
)
def verdict_tally(t: Tables) -> DataFrame:
    return claims.tally(_checked(t)).select("document_id", "claim_count", "verified_count", "summary")


_REASON = """CASE WHEN selected THEN concat('could not be checked: ', coalesce(nullif(error, ''), 'unknown error')) WHEN claim_type <> 'empirical' THEN claim_type
    WHEN checkworthiness < 0.4 THEN printf('below the checkworthiness floor (%.2f)', checkworthiness) ELSE 'not among the 8 most checkworthy claims' END"""


@query(f"WITH {_CHECKED} SELECT claim_id, {_REASON} AS reason FROM checked WHERE verdict IS NULL")
def unchecked_reasons(t: Tables) -> DataFrame:
    reason = md.unchecked_reason(F.col("selected"), F.col("claim_type"), F.col("checkworthiness"), F.col("error"))
    return _checked(t).where("verdict IS NULL").select("claim_id", reason.alias("reason"))


@query(f"WITH {_CHECKED} SELECT claim_id FROM checked WHERE selected AND verdict IS NULL AND attempts < 3 ORDER BY checkworthiness DESC, claim_id LIMIT 25")
def claims_to_verify(t: Tables) -> DataFrame:
    return claims.claims_to_verify(_checked(t)).select("claim_id")


@query(
    f"""WITH {_CHECKED}
SELECT count(*) AS claims, count(*) FILTER (selected) AS selected, count(*) FILTER (verdict IS NOT NULL) AS verified,
  count(*) FILTER (selected AND verdict IS NULL AND attempts < 3) AS pending, count(*) FILTER (selected AND verdict IS NULL AND attempts >= 3) AS dead FROM checked"""
)
def claim_counters(t: Tables) -> DataFrame:
    open_ = F.col("selected") & F.col("verdict").isNull()
    return counters(
        _checked(t), claims=F.lit(True), selected=F.col("selected"), verified=F.col("verdict").isNotNull(), pending=claims.pending(), dead=open_ & (F.col("attempts") >= 3)
    )


def _documents(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    return t.documents().select(
        doc.alias("document_id"), F.when(doc % 3 > 0, F.concat(F.lit("Title "), doc)).alias("title"), F.concat(F.lit("https://e.org/"), doc).alias("canonical_url"),
        F.when(doc % 2 == 0, F.col("source")).alias("author"), F.when(doc % 5 > 0, F.timestamp_seconds(doc * 86400)).alias("published_at"),
        F.timestamp_seconds(F.lit(10**7) - doc).alias("created_at"), F.when(doc % 4 > 0, F.timestamp_seconds(doc * 7)).alias("extracted_at"),
        F.when(doc % 6 == 0, F.timestamp_seconds(doc)).alias("reported_at"), (doc % 4).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"),
        F.when(doc % 2 == 0, F.col("text")).alias("full_text"), F.lit(None).cast("timestamp").alias("fetched_at"), "text",
    )


_REPORTABLE = f"""{_CHECKED},
batch AS (SELECT doc_id AS document_id FROM documents WHERE doc_id % 4 > 0 AND doc_id % 6 > 0 ORDER BY doc_id * 7, doc_id LIMIT 25)"""


@query(
    f"""WITH {_REPORTABLE}
SELECT document_id FROM batch WHERE document_id NOT IN (SELECT document_id FROM checked WHERE selected AND verdict IS NULL AND attempts < 3)"""
)
def reportable_documents(t: Tables) -> DataFrame:
    return claims.reportable(_documents(t), _checked(t)).select("document_id")


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 4 < 3 ORDER BY 10000000 - doc_id, doc_id LIMIT 10")
def documents_to_extract(t: Tables) -> DataFrame:
    return claims.documents_to_extract(_documents(t)).select("document_id")


@query(
    f"""WITH f AS (
  SELECT doc_id, text, source, doc_id % 4 AS attempts, doc_id % 2 = 0 AS has_text,
    CASE doc_id % 7 WHEN 1 THEN 'BlockedURLError' WHEN 2 THEN 'TimeoutError' WHEN 3 THEN 'NoReadableTextError' END AS e,
    CASE WHEN doc_id % 7 IN (1, 2) THEN concat('cannot read ', text) WHEN doc_id % 7 = 3 THEN '' END AS message
  FROM documents)
SELECT doc_id AS document_id, (CASE WHEN has_text OR e IS NULL THEN attempts WHEN e = 'TimeoutError' THEN attempts + 1 ELSE 3 END)::BIGINT AS attempts,
  CASE WHEN has_text OR e IS NULL THEN '' WHEN e = 'TimeoutError' THEN substring(message, 1, 1000) ELSE substring(concat(e, ': ', message), 1, 1000) END AS error,
  md5(CASE WHEN has_text THEN text WHEN e IS NULL THEN substring(trim(text), 1, 60000) ELSE '' END) AS full_text,
  CASE WHEN NOT has_text AND e IS NULL THEN '{RUN}' ELSE '' END AS fetched_at,
  CASE WHEN NOT has_text AND e IS NULL THEN source ELSE coalesce(CASE WHEN doc_id % 3 > 0 THEN concat('Title ', doc_id) END, '') END AS title
FROM f"""
)
def document_fetch(t: Tables) -> DataFrame:
    """Every document was fetched; some fetches were blocked, timed out, or found no text."""
    doc = F.col("doc_id")
    error = F.when(doc % 7 == 1, "BlockedURLError").when(doc % 7 == 2, "TimeoutError")
    fetched = t.documents().select(
        doc.alias("document_id"), F.col("source").alias("page_title"), F.lit(None).cast("string").alias("page_author"), F.lit("2024-01-01").alias("page_date"),
        F.when(doc % 7 != 3, F.col("text")).otherwise(" \n ").alias("page_text"), error.alias("error_class"),
        F.when(error.isNotNull(), F.concat(F.lit("cannot read "), "text")).alias("message"),
    )
    after = claims.apply_fetches(_documents(t).drop("text"), fetched, _stamp())
    return after.select(
        "document_id", _big("attempts"), _text("error"), F.md5(F.coalesce("full_text", F.lit(""))).alias("full_text"),
        F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("")).alias("fetched_at"), _text("title"),
    )


@query(
    f"""WITH {CLAIMS},
placed AS (
  SELECT document_id, pos, d.text, CASE WHEN pos % 10 = 9 THEN 0 ELSE strpos(d.text, c.text) END AS place FROM claims c JOIN documents d ON d.doc_id = document_id)
SELECT document_id, pos, md5(CASE WHEN place = 0 THEN substring(text, 1, 2000) ELSE substring(text, greatest(place - 1001, 0)::INTEGER + 1, (place + 999 - greatest(place - 1001, 0))::INTEGER) END) AS context FROM placed"""
)
def claim_context(t: Tables) -> DataFrame:
    """The text around each claim's quote; every tenth claim carries none."""
    quoted = _claims(t).select("document_id", "pos", F.when(F.col("pos") % 10 != 9, F.col("text")).alias("quote"))
    documents = t.documents().select(F.col("doc_id").alias("document_id"), F.col("text").alias("full_text"))
    return claims.with_context(quoted, documents).select("document_id", "pos", F.md5("context").alias("context"))


# --- evidence ---------------------------------------------------------------------------


def _evidence(t: Tables) -> DataFrame:
    """Three quotes per claim: the supporting call gave the first and third, the opposing one the second,
    which repeats a page of the other call."""
    pages = t.pages().select("page_id", "url")
    n = t.pages().count()
    doc, pos = F.col("document_id"), F.col("pos")
    asked = _claims(t).select("document_id", "pos", _claim_id().alias("claim_id"), F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("i"))
    stance = F.element_at(F.array(*(F.lit(s) for s in ("supports", "contradicts", "context", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    step = F.when((F.col("i") == 0) | ((F.col("i") == 1) & (pos % 4 == 0)), 0).otherwise(1)
    return asked.withColumn("page_id", (doc * 7 + pos + step) % n).join(pages, "page_id").select(
        "document_id", "claim_id", (F.col("i") % 2).alias("call"), F.col("i").alias("pos"), "page_id", stance.alias("stance"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.split("url", "#")[0], F.lit("#quoted"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("Page "), "page_id")).alias("title"), F.when(F.col("page_id") % 3 > 0, "said").alias("snippet"),
        F.when(F.col("page_id") % 2 == 0, "2024-01-01").alias("published_at"), (pos % 5 > 0).alias("annotated"), F.col("url").alias("visited"),
    )


def _calls(evidence: DataFrame) -> DataFrame:
    """One response per claim and call; annotated ones list the pages visited and another entry.

    A call gave at most two quotes here, so its list is short."""
    note = F.when(F.col("page_id") % 3 > 0, F.struct(F.lit("url_citation").alias("type"), F.struct(F.col("visited").alias("url")).alias("url_citation")))
    junk = F.array(F.struct(F.lit("file").alias("type"), F.struct(F.lit("x").alias("url")).alias("url_citation")))
    listed = evidence.groupBy("claim_id", "call").agg(F.collect_list(note).alias("notes"), F.bool_and("annotated").alias("annotated"))
    raw = listed.withColumn("raw", F.when(F.col("annotated"), F.to_json(F.concat("notes", junk))))
    urls, had = claims.citations(F.col("raw"))
    return raw.select("claim_id", "call", urls.alias("citation_urls"), had.alias("had_annotations"))


_EVIDENCE = f"""{_GATED}, {CANONICAL},
evidence AS (
  SELECT document_id, claim_id, i % 2 AS call, i AS pos, p.page_id, p.canonical_url,
    ['supports', 'contradicts', 'context', 'other'][(p.page_id % 4 + 1)::INTEGER] AS raw_stance, g.pos % 5 > 0 AS annotated,
    CASE WHEN p.page_id % 2 = 0 THEN concat(string_split(url, '#')[1], '#quoted') ELSE url END AS url,
    CASE WHEN p.page_id % 5 > 0 THEN concat('Page ', p.page_id) END AS title, CASE WHEN p.page_id % 3 > 0 THEN 'said' END AS snippet,
    CASE WHEN p.page_id % 2 = 0 THEN '2024-01-01' END AS published_at
  FROM gated g CROSS JOIN (VALUES (0), (1), (2)) v(i) JOIN canonical p ON p.page_id = (document_id * 7 + g.pos + CASE WHEN i = 0 OR (i = 1 AND g.pos % 4 = 0) THEN 0 ELSE 1 END) % (SELECT count(*) FROM pages)),
cited AS (SELECT DISTINCT claim_id, call, canonical_url FROM evidence WHERE page_id % 3 > 0),
grounded AS (
  SELECT e.*, CASE raw_stance WHEN 'other' THEN 'context' ELSE raw_stance END AS stance FROM evidence e LEFT JOIN cited c
  ON c.claim_id = e.claim_id AND c.call = e.call AND c.canonical_url = e.canonical_url WHERE NOT annotated OR c.claim_id IS NOT NULL),
pooled AS (SELECT * FROM grounded QUALIFY row_number() OVER (PARTITION BY claim_id, canonical_url, stance ORDER BY call, pos) = 1)"""


@query(f"WITH {_EVIDENCE} SELECT claim_id, call::BIGINT AS call, pos::BIGINT AS pos, canonical_url FROM grounded")
def evidence_grounding(t: Tables) -> DataFrame:
    evidence = _evidence(t)
    return claims.ground(evidence, _calls(evidence)).select("claim_id", _big("call"), _big("pos"), "canonical_url")


@query(f"WITH {_EVIDENCE} SELECT claim_id, call::BIGINT AS call, pos::BIGINT AS pos, stance, canonical_url FROM pooled")
def evidence_dedupe(t: Tables) -> DataFrame:
    evidence = _evidence(t)
    return claims.pool_evidence(evidence, _calls(evidence)).select("claim_id", _big("call"), _big("pos"), "stance", "canonical_url")


@query(
    f"""WITH {_EVIDENCE},
shown AS (
  SELECT claim_id, string_agg(concat('[', stance, '] ', coalesce(title, 'untitled'), ' — ', url, CASE WHEN published_at IS NULL THEN '' ELSE concat(' (', published_at, ')') END, chr(10), coalesce(snippet, '')),
    chr(10) || chr(10) ORDER BY call, pos) AS block FROM pooled GROUP BY 1)
SELECT claim_id, concat('Statement: ', text, chr(10), 'Said by: the article', chr(10), chr(10), 'What was found:', chr(10), coalesce(block, '(no evidence was found)')) AS user FROM gated LEFT JOIN shown USING (claim_id)"""
)
def judge_prompts(t: Tables) -> DataFrame:
    """What the judge reads about each claim: the claim and its pooled evidence."""
    evidence = _evidence(t)
    asked = _claims(t).select(_claim_id().alias("claim_id"), "text")
    read = prompts.evidence_text(asked, claims.pool_evidence(evidence, _calls(evidence)))
    built = prompts.judgment(F.col("text"), F.lit(None).cast("string"), F.col("evidence_text"))
    return asked.join(read, "claim_id").select("claim_id", built["user"].alias("user"))


@query(
    f"""WITH {_CHECKED},
outcome AS (
  SELECT claim_id, CASE WHEN pos % 11 = 0 THEN 'maybe' WHEN pos % 13 > 0 THEN 'refuted' END AS v, CASE WHEN pos % 13 = 0 THEN concat('no answer about ', text) END AS m
  FROM checked WHERE selected AND verdict IS NULL AND attempts < 3)
SELECT c.claim_id, coalesce(CASE WHEN v = 'refuted' AND m IS NULL THEN v ELSE verdict END, '') AS verdict,
  (attempts + CASE WHEN o.claim_id IS NOT NULL AND NOT coalesce(v = 'refuted' AND m IS NULL, false) THEN 1 ELSE 0 END)::BIGINT AS attempts,
  coalesce(CASE WHEN o.claim_id IS NULL THEN error WHEN v = 'refuted' AND m IS NULL THEN NULL WHEN m IS NOT NULL THEN substring(m, 1, 1000) ELSE concat('not a verdict: ''', v, '''') END, '') AS error
FROM checked c LEFT JOIN outcome o USING (claim_id)"""
)
def verdict_write(t: Tables) -> DataFrame:
    checked = _checked(t)
    pos = F.substring_index("claim_id", "/", -1).cast("int")
    outcomes = checked.where(claims.pending()).select(
        "claim_id", F.when(pos % 11 == 0, "maybe").when(pos % 13 > 0, "refuted").alias("new_verdict"), F.lit(0.5).alias("new_confidence"), F.lit("r").alias("new_rationale"),
        F.when(pos % 13 == 0, F.concat(F.lit("no answer about "), "text")).alias("message"),
    )
    return claims.apply_verdicts(checked, outcomes, _stamp()).select("claim_id", _text("verdict"), _big("attempts"), _text("error"))


_REPORT = f"""{_CHECKED}, {CANONICAL},
backed AS (
  SELECT {_CLAIM_ID} AS claim_id, i, p.page_id, CASE WHEN p.page_id % 2 = 0 THEN concat(string_split(p.url, '#')[1], '#quoted') ELSE p.url END AS url, ['Supporting', 'Contradicting', 'Context', 'other'][(p.page_id % 4 + 1)::INTEGER] AS label,
    CASE WHEN p.page_id % 5 > 0 THEN concat('Page ', p.page_id) END AS title, CASE WHEN p.page_id % 3 > 0 THEN 'said' END AS snippet
  FROM claims c CROSS JOIN (VALUES (0), (1), (2)) v(i) JOIN canonical p ON p.page_id = (document_id * 7 + c.pos + CASE WHEN i = 0 OR (i = 1 AND c.pos % 4 = 0) THEN 0 ELSE 1 END) % (SELECT count(*) FROM pages)),
per AS (SELECT document_id, verdict, count(*) AS n FROM checked GROUP BY 1, 2),
sums AS (
  SELECT document_id, sum(n) AS claims, coalesce(sum(n) FILTER (verdict IS NOT NULL), 0) AS judged,
    coalesce(string_agg(concat(n, ' ', verdict), ', ' ORDER BY verdict) FILTER (verdict IS NOT NULL), 'none checked') AS summary FROM per GROUP BY 1),
docs AS (
  SELECT doc_id AS document_id, concat('https://e.org/', doc_id) AS u, CASE WHEN doc_id % 3 > 0 THEN concat('Title ', doc_id) END AS title,
    concat_ws(' · ', concat('https://e.org/', doc_id), CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END,
      CASE WHEN doc_id % 5 > 0 THEN strftime(make_timestamp(doc_id * 86400000000), 'published %Y-%m-%d') END, 'checked {RUN}') AS byline FROM documents),
said AS (
  SELECT *, concat_ws(' · ', concat('Attributed to ', coalesce(attributed_to, 'the article'), CASE WHEN attribution_type IS NULL THEN '' ELSE ' (quoted person)' END),
    CASE WHEN cited_source IS NOT NULL THEN concat('citing ', CASE WHEN cited_source_url IS NULL THEN cited_source ELSE concat('[', cited_source, '](', cited_source_url, ')') END) END) AS attribution,
    concat('**', upper(verdict[1]), verdict[2:], '**', CASE WHEN confidence IS NULL THEN '' ELSE printf(' · confidence %.2f', confidence) END) AS stamp FROM checked),
lines_out AS (
  SELECT document_id, 0 AS a, 0.0 AS b, '' AS c, 0 AS d, 0 AS e, unnest([concat('# Claim check — ', coalesce(title, u)), '', byline, '',
    concat('*', coalesce(claims, 0), ' claims extracted · ', coalesce(judged, 0), ' checked · ', coalesce(summary, 'none checked'), '.*'), '']) AS line, unnest([1, 2, 3, 4, 5, 6]) AS f
  FROM docs LEFT JOIN sums USING (document_id)
  UNION ALL SELECT document_id, 1, -checkworthiness, claim_id, 0, 0, unnest([concat('## "', text, '"'), '', attribution, '', stamp, '', rationale, '']), unnest([1, 2, 3, 4, 5, 6, 7, 8]) FROM said WHERE verdict IS NOT NULL
  UNION ALL SELECT document_id, 1, -checkworthiness, s.claim_id, 1, i, concat('- **', label, ':** [', coalesce(title, url), '](', url, ')', CASE WHEN snippet IS NULL THEN '' ELSE concat(' — "', snippet, '"') END), 0
    FROM said s JOIN backed USING (claim_id) WHERE verdict IS NOT NULL
  UNION ALL SELECT document_id, 1, -checkworthiness, claim_id, 2, 0, '', 0 FROM said WHERE verdict IS NOT NULL
  UNION ALL SELECT DISTINCT document_id, 2, 0.0, '', 0, 0, '## Not checked', 0 FROM said WHERE verdict IS NULL
  UNION ALL SELECT DISTINCT document_id, 2, 0.0, '', 0, 0, '', 1 FROM said WHERE verdict IS NULL
  UNION ALL SELECT document_id, 3, -checkworthiness, claim_id, 0, 0, concat('- "', text, '" — ', {_REASON}), 0 FROM said WHERE verdict IS NULL
  UNION ALL SELECT DISTINCT document_id, 4, 0.0, '', 0, 0, '', 0 FROM said WHERE verdict IS NULL)"""


def _report(t: Tables) -> DataFrame:
    shown = _evidence(t).withColumn("evidence_order", F.lpad(F.col("pos").cast("string"), 6, "0"))
    return pages_text.report_lines(_documents(t), _checked(t), shown, _stamp())


@query(
    f"""WITH {_REPORT}
SELECT document_id, line, count(*) AS n FROM lines_out GROUP BY 1, 2"""
)
def claim_report_lines(t: Tables) -> DataFrame:
    """Every document's report as lines, with how often each occurs."""
    return _report(t).groupBy("document_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REPORT} SELECT document_id, part, md5(concat(string_agg(line, chr(10) ORDER BY n), chr(10))) AS body FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a, b, c, d, e, f) AS n,
    ((row_number() OVER (PARTITION BY document_id ORDER BY a, b, c, d, e, f) - 1) // {pages_text.PART_LINES})::INTEGER AS part FROM lines_out) GROUP BY 1, 2""")
def claim_report(t: Tables) -> DataFrame:
    """Every document's report as one text."""
    return pages_text.bodies(_report(t), "document_id").select("document_id", "part", F.md5("body").alias("body"))


@query(
    """SELECT doc_id AS document_id, md5(concat(CASE WHEN doc_id % 3 > 0 THEN concat('# Title ', doc_id, chr(10), chr(10)) ELSE '' END, text)) AS user FROM documents"""
)
def claim_extraction_prompts(t: Tables) -> DataFrame:
    built = prompts.claim_extraction(F.col("title"), F.col("text"))
    return _documents(t).select("document_id", F.md5(built["user"]).alias("user"))


@query(
    f"""WITH {CLAIMS},
placed AS (SELECT document_id, pos, c.text AS claim, d.text, strpos(d.text, c.text) AS place FROM claims c JOIN documents d ON d.doc_id = document_id)
SELECT document_id, pos, md5(concat('Statement: ', claim, chr(10), 'Said by: ', CASE WHEN pos % 3 = 0 THEN 'Ann' ELSE 'the article' END, chr(10), chr(10), 'Where it stands (no proof by itself):', chr(10),
  substring(text, greatest(place - 1001, 0)::INTEGER + 1, (place + 999 - greatest(place - 1001, 0))::INTEGER))) AS user FROM placed"""
)
def research_prompts(t: Tables) -> DataFrame:
    """What the research calls read about each claim."""
    speaker = F.when(F.col("pos") % 3 == 0, "Ann")
    asked = _claims(t).select("document_id", "pos", "text", F.col("text").alias("quote"), speaker.alias("attributed_to"))
    documents = t.documents().select(F.col("doc_id").alias("document_id"), F.col("text").alias("full_text"))
    built = prompts.research(F.col("text"), F.col("attributed_to"), F.col("context"), opposing=False)
    return claims.with_context(asked, documents).select("document_id", "pos", F.md5(built["user"]).alias("user"))


@query(
    """SELECT doc_id, CASE WHEN error = '' THEN md5(text) ELSE '' END AS content, error FROM (
  SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'the answer holds no choice' WHEN doc_id % 5 = 0 THEN 'the answer was cut off at its length limit'
    WHEN doc_id % 3 = 0 THEN 'the answer is blank' ELSE '' END AS error FROM documents)"""
)
def response_checks(t: Tables) -> DataFrame:
    """Documents as model responses in JSON: some without a choice, some cut off, some blank."""
    doc = F.col("doc_id")
    message = F.struct(F.when(doc % 3 == 0, F.lit(" ")).otherwise(F.col("text")).alias("content"))
    choice = F.struct(F.when(doc % 5 == 0, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"), message.alias("message"))
    choices = F.when(doc % 7 != 0, F.array(choice)).otherwise(F.slice(F.array(choice), 1, 0))
    raw = t.documents().select("doc_id", F.to_json(F.struct(choices.alias("choices"))).alias("raw"))
    content, _, error = infer.response_content(F.col("raw"))
    blank = F.lit("")
    return raw.select("doc_id", F.coalesce(F.md5(content), blank).alias("content"), F.coalesce(error, blank).alias("error"))


@query(
    """WITH said AS (
  SELECT doc_id AS document_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(line) > 0),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY length(line) % 101 DESC, n) AS r FROM said
  WHERE n % 4 = 0 AND (length(line) % 101) / 100.0 >= 0.4 QUALIFY r <= 8)
SELECT s.document_id, count(*) AS claims, count(r) AS checked, count(*) FILTER (r IS NOT NULL AND length(s.line) % 3 = 0) AS supported,
  count(*) FILTER (r IS NOT NULL AND length(s.line) % 3 = 1) AS refuted, 3 * count(r) AS evidence
FROM said s LEFT JOIN chosen c ON c.document_id = s.document_id AND c.n = s.n GROUP BY 1"""
)
def claim_desk(t: Tables) -> DataFrame:
    """All documents through the desk: extracted, gated, researched both ways, grounded, judged."""
    none = F.lit(None).cast("string")
    documents = t.documents().select(
        F.col("doc_id").alias("document_id"), none.alias("title"), F.col("text").alias("full_text"), F.lit(0).alias("attempts"), none.alias("error"),
        F.lit(None).cast("timestamp").alias("extracted_at"),
    )
    made, stamped = claimdesk.extract(documents, rules.lines_as_claims, _stamp())
    made = durable.cut(made)
    found, outcomes = claimdesk.verify(made.where("selected"), stamped, rules.supports, rules.opposes, rules.judges_by_length)
    after = claims.apply_verdicts(made, outcomes, _stamp())
    backed = found.groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence"))
    return after.join(backed, "claim_id", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count("verdict").alias("checked"), F.count_if(F.col("verdict") == "supported").alias("supported"),
        F.count_if(F.col("verdict") == "refuted").alias("refuted"), F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence"),
    )
