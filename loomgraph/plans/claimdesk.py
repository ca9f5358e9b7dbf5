"""From submitted pages to checked claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions import markdown as md
from loomgraph.operators import claims, infer, pages_text, prompts
from loomgraph.operators.infer import Provider
from loomgraph.schemas import CLAIM_EXTRACTION, ERROR_MAX_CHARS, JUDGMENT, REPORT_BATCH, RESEARCH, VERDICTS
from loomgraph.sources import sinks


def extract(
    documents: DataFrame, extractor: Callable[[], Provider], run_ts: Column, parallelism: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(claims, documents after the sweep) of fetched documents due for extraction.

    Write the claims before the stamped documents: a crash in between repeats the
    extraction instead of losing it."""
    request = prompts.claim_extraction(F.col("title"), F.coalesce("full_text", F.lit("")))
    asked = documents.select("document_id", *(c.alias(n) for n, c in request.items()))
    answers = durable.cut(infer.infer(asked, ["document_id"], extractor, parallelism))
    value, wrong = infer.parsed(F.col("answer"), CLAIM_EXTRACTION, infer.valid_claims)
    read = answers.select("document_id", value.alias("v"), F.coalesce("error", wrong).alias("failure"))
    found = read.select("document_id", F.posexplode("v.claims").alias("pos", "c")).select("document_id", "pos", "c.*")
    key = F.sha2(F.concat_ws("\u0001", F.col("document_id").cast("string"), F.col("pos").cast("string")), 256)
    made = claims.select_for_verification(found).select(
        key.alias("claim_id"), "*", F.lit(0).alias("attempts"),
        *(F.lit(None).cast(kind).alias(n) for n, kind in (
            ("verdict", "string"), ("confidence", "double"), ("rationale", "string"), ("error", "string"), ("verified_at", "timestamp"))),
    )
    tried = read.select("document_id", "failure", F.lit(True).alias("_tried"))
    failed, done = F.col("failure").isNotNull(), F.col("_tried") & F.col("failure").isNull()
    stamped = (
        documents.join(tried, "document_id", "left")
        .withColumns(
            {
                "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
                "error": F.when(done, None).when(failed, F.substring("failure", 1, ERROR_MAX_CHARS)).otherwise(F.col("error")),
                "extracted_at": F.when(done, run_ts).otherwise(F.col("extracted_at")),
            }
        )
        .drop("failure", "_tried")
    )
    return made, stamped


def _research(asked: DataFrame, call: int, factory: Callable[[], Provider], parallelism: int | None):
    request = prompts.research(F.col("text"), F.col("attributed_to"), F.col("context"), opposing=bool(call))
    raw = durable.cut(
        infer.infer(asked.select("claim_id", *(c.alias(n) for n, c in request.items())), ["claim_id"], factory, parallelism)
    )
    content, notes, refused = infer.response_content(F.col("answer"))
    shown = raw.select("claim_id", content.alias("content"), notes.alias("notes"), F.coalesce("error", refused).alias("error"))
    value, wrong = infer.parsed(F.col("content"), RESEARCH, infer.valid_research)
    urls, had = claims.citations(F.col("notes"))
    return shown.select(
        "claim_id", F.lit(call).alias("call"), value.alias("v"), urls.alias("citation_urls"), had.alias("had_annotations"),
        F.coalesce("error", wrong).alias("error"),
    )


def verify(
    due: DataFrame,
    documents: DataFrame,
    support: Callable[[], Provider],
    oppose: Callable[[], Provider],
    judge: Callable[[], Provider],
    parallelism: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(evidence, outcomes) of the claims that are due.

    Two opposed research calls, grounded on their own citations, pooled and de-duplicated; the
    judge reads what is kept. A failure of any of the three calls fails the claim, and its
    evidence is not stored. The research answers are full chat responses, as they carry
    the citations."""
    asked = durable.cut(claims.with_context(due.select("claim_id", "document_id", "text", "quote", "attributed_to"), documents))
    calls = durable.cut(
        _research(asked, 0, support, parallelism).unionByName(_research(asked, 1, oppose, parallelism))
    )
    broken = calls.where("error IS NOT NULL").groupBy("claim_id").agg(F.min_by("error", "call").alias("message"))
    good = asked.join(broken, "claim_id", "left_anti")
    items = calls.join(good.select("claim_id"), "claim_id", "left_semi").select(
        "claim_id", "call", F.posexplode("v.evidence").alias("pos", "e")
    ).select("claim_id", "call", "pos", "e.*")
    pooled = durable.cut(claims.pool_evidence(items, calls.select("claim_id", "call", "citation_urls", "had_annotations")))
    read = good.join(prompts.evidence_text(good, pooled), "claim_id")
    request = prompts.judgment(F.col("text"), F.col("attributed_to"), F.col("evidence_text"))
    answers = durable.cut(
        infer.infer(read.select("claim_id", *(c.alias(n) for n, c in request.items())), ["claim_id"], judge, parallelism)
    )
    value, wrong = infer.parsed(F.col("answer"), JUDGMENT, infer.valid_judgment)
    judged = answers.select("claim_id", value.alias("v"), F.coalesce("error", wrong).alias("message")).select(
        "claim_id", F.col("v.verdict").alias("new_verdict"), F.col("v.confidence").alias("new_confidence"),
        F.col("v.rationale").alias("new_rationale"), "message",
    )
    outcomes = judged.unionByName(broken, allowMissingColumns=True)
    accepted = judged.where(F.col("message").isNull() & F.col("new_verdict").isin(*VERDICTS)).select("claim_id")
    return pooled.join(accepted, "claim_id", "left_semi"), outcomes


def report(
    documents: DataFrame, checked: DataFrame, evidence: DataFrame, generated_at: Column, path: str, n: int = REPORT_BATCH
) -> tuple[DataFrame, DataFrame]:
    """(reports, documents after the sweep): writes the Markdown of up to ``n`` finished documents below ``path``.

    The files are written here; store the reports and then the stamped documents, so that a
    crash in between repeats the report instead of losing it."""
    due = durable.cut(claims.reportable(documents, checked, n))
    ids = due.select("document_id")
    inside = durable.cut(checked.join(ids, "document_id", "left_semi"))
    place = F.concat(F.lpad(F.col("call").cast("string"), 3, "0"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    backed = evidence.join(inside.select("claim_id"), "claim_id", "left_semi").withColumn("evidence_order", place)
    lines = durable.cut(pages_text.report_lines(due, inside, backed, generated_at))
    # Documents of one title stay apart by a digest of their ids.
    name = F.concat_ws("-", md.report_name(F.col("title"), F.col("canonical_url"), generated_at), F.substring(F.sha2(F.col("document_id"), 256), 1, 10))
    named = due.select("document_id", name.alias("slug"))
    sinks.write_markdown(lines, named, "document_id", path)
    sums = claims.tally(inside).select("document_id", "claim_count", "verified_count")
    reports = (
        named.join(sums, "document_id", "left")
        .na.fill(0, ["claim_count", "verified_count"])
        .join(pages_text.bodies(lines, "document_id"), "document_id")
        .withColumn("generated_at", generated_at)
    )
    stamped = documents.join(ids.withColumn("_due", F.lit(True)), "document_id", "left").withColumn(
        "reported_at", F.when(F.col("_due"), generated_at).otherwise(F.col("reported_at"))
    )
    return reports, stamped.drop("_due")
