"""Claim checking: submission, the verification gate, evidence, verdicts and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.dates import parse_iso
from loomgraph.functions.text import context_window, fit, is_blank, or_else, strip
from loomgraph.functions.urls import canonical_url
from loomgraph.operators.jobs import oldest
from loomgraph.operators.skew import lookup, top_per_key
from loomgraph.schemas import (
    ANNOTATIONS,
    CHECKABLE_CLAIM_TYPE,
    CHECKWORTHINESS_MIN,
    ERROR_MAX_CHARS,
    EXTRACT_BATCH,
    EXTRACT_MAX_ATTEMPTS,
    REPORT_BATCH,
    STANCES,
    VERDICTS,
    VERIFY_BATCH,
    VERIFY_MAX_ATTEMPTS,
    VERIFY_MAX_PER_DOCUMENT,
)


def submit_urls(documents: DataFrame, submissions: DataFrame) -> DataFrame:
    """``submission_id, url, canonical_url, document_id, created``: a page known under another
    spelling keeps its document; of equal new pages the first submission creates it."""
    asked = submissions.withColumn("canonical_url", canonical_url(F.col("url")))
    known = documents.select("canonical_url", F.col("document_id").alias("known_id"))
    first = asked.groupBy("canonical_url").agg(F.min("submission_id").alias("first_id"))
    joined = asked.join(first.join(known, "canonical_url", "left"), "canonical_url")
    return joined.select(
        "submission_id",
        "url",
        "canonical_url",
        F.coalesce("known_id", F.sha2("canonical_url", 256)).alias("document_id"),
        (F.col("known_id").isNull() & (F.col("submission_id") == F.col("first_id"))).alias("created"),
    )


def documents_to_extract(documents: DataFrame, n: int = EXTRACT_BATCH) -> DataFrame:
    due = F.col("extracted_at").isNull() & (F.col("attempts") < EXTRACT_MAX_ATTEMPTS)
    return oldest(documents.where(due), ["created_at", "document_id"], n)


def apply_fetches(documents: DataFrame, fetched: DataFrame, run_ts: Column, max_chars: int | None = None) -> DataFrame:
    """Documents after fetching. ``fetched`` has ``document_id, page_title, page_author, page_date, page_text,
    error_class, message``.

    Documents that have their text are left alone. A page without readable text, and a URL
    that is not public, will never succeed: their attempts are used up at once. Any other
    error costs one attempt. The whole text is kept unless ``max_chars`` says otherwise."""
    f = fetched.withColumn("_fetched", F.lit(True))
    due = F.col("_fetched") & F.col("full_text").isNull()
    error = F.when(
        F.col("error_class").isNotNull(), F.col("error_class")
    ).when(is_blank(F.col("page_text")), "NoReadableTextError")
    ok, failed = due & error.isNull(), due & error.isNotNull()
    final = failed & error.isin("NoReadableTextError", "BlockedURLError")
    text, _ = fit(strip(F.col("page_text")), max_chars)
    note = F.when(final, F.concat(error, F.lit(": "), F.coalesce("message", F.lit("")))).otherwise(F.col("message"))

    def put(column: str, value: Column) -> Column:
        return F.when(ok, value).otherwise(F.col(column))

    return (
        documents.join(f, "document_id", "left")
        .withColumns(
            {
                "error": F.when(failed, F.substring(note, 1, ERROR_MAX_CHARS)).otherwise(F.col("error")),
                "attempts": F.when(final, EXTRACT_MAX_ATTEMPTS).when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
                "title": put("title", or_else(F.col("page_title"))),
                "author": put("author", or_else(F.col("page_author"))),
                "published_at": put("published_at", parse_iso(F.col("page_date"))),
                "fetched_at": put("fetched_at", run_ts),
                "full_text": put("full_text", text),
            }
        )
        .drop(*(c for c in f.columns if c != "document_id"))
    )


def select_for_verification(
    claims: DataFrame, floor: float = CHECKWORTHINESS_MIN, per_document: int = VERIFY_MAX_PER_DOCUMENT
) -> DataFrame:
    """Claims (``document_id, pos, claim_type, checkworthiness``) with ``selected``: empirical, at or above
    the floor, among the document's most checkworthy; ties go to the earlier claim.

    The few chosen keys are found first, so a document with very many claims is never sorted."""
    eligible = claims.where((F.col("claim_type") == CHECKABLE_CLAIM_TYPE) & (F.col("checkworthiness") >= floor))
    chosen = top_per_key(
        eligible.select("document_id", "pos", "checkworthiness"),
        ["document_id"],
        [F.col("checkworthiness").desc(), F.col("pos")],
        per_document,
    ).select("document_id", "pos", F.lit(True).alias("selected"))
    return claims.join(chosen, ["document_id", "pos"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def pending(selected: str = "selected") -> Column:
    """Still owed a verdict."""
    return F.col(selected) & F.col("verdict").isNull() & (F.col("attempts") < VERIFY_MAX_ATTEMPTS)


def claims_to_verify(claims: DataFrame, n: int = VERIFY_BATCH) -> DataFrame:
    ranked = claims.where(pending())
    return ranked.orderBy(F.col("checkworthiness").desc(), "claim_id").limit(n)


def with_context(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with the stretch of document text around their quote."""
    texts = documents.select("document_id", "full_text")
    return lookup(claims, texts, ["document_id"]).withColumn(
        "context", context_window(F.col("full_text"), F.col("quote"))
    ).drop("full_text")


def citations(annotations: Column) -> tuple[Column, Column]:
    """(distinct cited URLs, whether the response was annotated at all) of an annotations JSON list."""
    parsed = F.from_json(annotations, ANNOTATIONS)
    listed = F.coalesce(F.size(parsed) > 0, F.lit(False)) & annotations.rlike(r"(?s)^\s*\[")
    cited = F.filter(
        F.transform(F.filter(parsed, lambda a: a.type == "url_citation"), lambda a: a.url_citation.url),
        lambda u: u.isNotNull() & (u != ""),
    )
    empty = F.array().cast("array<string>")
    return F.when(listed, F.array_distinct(cited)).otherwise(empty), F.coalesce(listed, F.lit(False))


def known_stance(stance: Column) -> Column:
    return F.when(stance.isin(*STANCES), stance).otherwise("context")


def ground(evidence: DataFrame, calls: DataFrame) -> DataFrame:
    """Evidence (``claim_id, call, pos, url, ...``) the call really visited, compared on canonical URLs.

    ``calls`` has ``claim_id, call, citation_urls, had_annotations``; a call without annotations
    gives nothing to check against and keeps all its evidence."""
    key = ["claim_id", "call"]
    asked = calls.select(*key, "had_annotations", F.transform("citation_urls", canonical_url).alias("_cited"))
    checked = evidence.join(asked, key).withColumn("canonical_url", canonical_url(F.col("url")))
    return checked.where(~F.col("had_annotations") | F.array_contains("_cited", F.col("canonical_url"))).drop(
        "had_annotations", "_cited"
    )


def dedupe_evidence(pooled: DataFrame) -> DataFrame:
    """One row per (claim, canonical URL, stance): the first in the order of ``call, pos``. A page
    quoted for and against stays twice."""
    key = ["claim_id", "canonical_url", "stance"]
    return top_per_key(pooled, key, [F.col("call"), F.col("pos")], 1).drop("rank")


def pool_evidence(evidence: DataFrame, calls: DataFrame) -> DataFrame:
    """The evidence the judge sees: both calls grounded on their own citations, pooled with the
    supporting call (0) before the opposing one (1), and de-duplicated."""
    return dedupe_evidence(ground(evidence.withColumn("stance", known_stance(F.col("stance"))), calls))


def apply_verdicts(claims: DataFrame, outcomes: DataFrame, run_ts: Column) -> DataFrame:
    """Claims after verification. ``outcomes`` has ``claim_id, new_verdict, new_confidence, new_rationale,
    message``. An unknown verdict, like any failed call, costs an attempt and leaves the verdict
    open; running out of attempts is not the same as "unverifiable"."""
    judged = F.col("new_verdict").isin(*VERDICTS) & F.col("message").isNull()
    failed = F.col("_tried").isNotNull() & ~F.coalesce(judged, F.lit(False))
    unknown = F.concat(F.lit("not a verdict: '"), F.coalesce("new_verdict", F.lit("")), F.lit("'"))
    return (
        claims.join(outcomes.withColumn("_tried", F.lit(True)), "claim_id", "left")
        .withColumns(
            {
                "verdict": F.when(judged, F.col("new_verdict")).otherwise(F.col("verdict")),
                "confidence": F.when(judged, F.col("new_confidence")).otherwise(F.col("confidence")),
                "rationale": F.when(judged, F.col("new_rationale")).otherwise(F.col("rationale")),
                "verified_at": F.when(judged, run_ts).otherwise(F.col("verified_at")),
                "error": F.when(judged, None)
                .when(failed, F.substring(F.coalesce("message", unknown), 1, ERROR_MAX_CHARS))
                .otherwise(F.col("error")),
                "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
            }
        )
        .drop("new_verdict", "new_confidence", "new_rationale", "message", "_tried")
    )


def reportable(documents: DataFrame, claims: DataFrame, n: int = REPORT_BATCH) -> DataFrame:
    """The oldest extracted, unreported documents, then without those that still wait for a verdict.

    The batch is cut before the check, so blocked documents use up their places."""
    due = documents.where(F.col("extracted_at").isNotNull() & F.col("reported_at").isNull())
    batch = durable.cut(oldest(due, ["extracted_at", "document_id"], n))
    # The batch is a written table, so Spark broadcasts it by its size and scans the claims without a shuffle.
    asked = batch.select("document_id")
    waiting = claims.where(pending()).join(asked, "document_id", "left_semi").select("document_id").distinct()
    return batch.join(waiting, "document_id", "left_anti")


def tally(claims: DataFrame) -> DataFrame:
    """``document_id, claim_count, verified_count, summary`` such as "2 refuted, 1 supported".

    Counted per verdict first; there are only as many verdicts as the vocabulary has."""
    counts = claims.groupBy("document_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    judged = F.when(F.col("verdict").isNotNull(), F.struct("verdict", "n"))
    listed = F.transform(
        F.array_sort(F.collect_list(judged)), lambda v: F.concat_ws(" ", v.n.cast("string"), v.verdict)
    )
    return counts.groupBy("document_id").agg(
        F.sum("n").alias("claim_count"),
        F.coalesce(F.sum(F.when(F.col("verdict").isNotNull(), F.col("n"))), F.lit(0)).alias("verified_count"),
        F.coalesce(or_else(F.array_join(listed, ", ")), F.lit("none checked")).alias("summary"),
    )
