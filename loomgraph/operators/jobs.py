"""The ingest job queue: appending, claiming, gating and finishing jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import or_else, sanitize, sanitize_json
from loomgraph.operators.skew import lookup, top_per_key
from loomgraph.schemas import JOB_BATCH, JOB_MAX_ATTEMPTS


def new_jobs(submissions: DataFrame) -> DataFrame:
    """Pending jobs for submissions (``kb_id, submission_id, text, metadata, submitted_at``)."""
    return submissions.select(
        F.sha2(F.concat_ws("\u0001", "kb_id", F.col("submission_id").cast("string")), 256).alias("job_id"),
        "kb_id",
        sanitize(F.col("text")).alias("content"),
        sanitize_json(F.col("metadata")).alias("metadata"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("relevance_reason"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("attempts"),
        F.col("submitted_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )


def job_status(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status of requested jobs; null for an unknown job or another tenant's."""
    return lookup(requests, jobs.select("kb_id", "job_id", "status", "relevance_reason", "error"), ["kb_id", "job_id"])


def oldest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows; each task keeps ``n`` rows, nothing is sorted as a whole."""
    return rows.orderBy(*order).limit(n)


def claim_batch(jobs: DataFrame, n: int = JOB_BATCH) -> DataFrame:
    """The oldest pending jobs, marked as being processed. One writer claims at a time."""
    return oldest(jobs.where("status = 'pending'"), ["created_at", "job_id"], n).withColumn("status", F.lit("processing"))


def job_metadata(jobs: DataFrame) -> DataFrame:
    """Jobs with ``source_label``, ``source_published_at`` and ``source_ingested_at``."""
    whole = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ingested = F.coalesce(F.regexp_replace(whole, r"\.000000$", ""), F.lit(""))
    return jobs.withColumns(
        {
            "source_label": F.coalesce(F.get_json_object("metadata", "$.source"), F.lit("")),
            "source_published_at": F.coalesce(or_else(F.get_json_object("metadata", "$.published_at")), ingested),
            "source_ingested_at": ingested,
        }
    )


def relevance_route(relevant: Column) -> Column:
    """merge, skip, or retry when the verdict is missing; undecided content is never skipped."""
    return F.when(relevant, "merge").when(~relevant, "skip").otherwise("retry")


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, run_ts: Column, max_attempts: int = JOB_MAX_ATTEMPTS) -> DataFrame:
    """Jobs after a batch. ``outcomes`` has ``job_id, result`` (done, skipped or error)``, reason, message``.

    A finished job loses its error; a failed one goes back to pending until its attempts are
    used up, then stays failed."""
    o = outcomes.select("job_id", "result", "reason", "message")
    finished, failed = F.col("result").isin("done", "skipped"), F.col("result") == "error"
    tries = F.col("attempts") + 1
    dead = failed & (tries >= max_attempts)
    return (
        jobs.join(o, "job_id", "left")
        .withColumns(
            {
                "status": F.when(finished, F.col("result"))
                .when(dead, "failed")
                .when(failed, "pending")
                .otherwise(F.col("status")),
                "relevance_reason": F.when(finished, F.col("reason")).otherwise(F.col("relevance_reason")),
                "error": F.when(finished, None).when(failed, F.col("message")).otherwise(F.col("error")),
                "processed_at": F.when(finished | dead, run_ts).otherwise(F.col("processed_at")),
                "attempts": F.when(failed, tries).otherwise(F.col("attempts")),
            }
        )
        .drop("result", "reason", "message")
    )


def replay_events(events: DataFrame, max_attempts: int = JOB_MAX_ATTEMPTS) -> DataFrame:
    """``job_id, status, attempts`` after an event log (``job_id, ts, event_id, event`` with events
    submitted, processing, failed_attempt and done).

    The first ``done``, or the failed attempt that uses up the attempts, ends a job; later
    events change nothing. Only the first few failures of a job travel in the shuffle."""
    at = F.struct("ts", "event_id")
    failures = top_per_key(
        events.where("event = 'failed_attempt'"), ["job_id"], [F.col("ts"), F.col("event_id")], max_attempts
    )
    failed_at = failures.groupBy("job_id").agg(F.array_sort(F.collect_list(at)).alias("failed_at"))
    seen = events.groupBy("job_id").agg(
        F.min(F.when(F.col("event") == "done", at)).alias("done_at"), F.max_by("event", at).alias("last_event")
    )
    failed = F.coalesce("failed_at", F.array().cast("array<struct<ts:timestamp,event_id:bigint>>"))
    counted = F.size(F.filter(failed, lambda f: F.col("done_at").isNull() | (f < F.col("done_at"))))
    status = (
        F.when(counted >= max_attempts, "failed")
        .when(F.col("done_at").isNotNull(), "done")
        .when(F.col("last_event") == "processing", "processing")
        .otherwise("pending")
    )
    return seen.join(failed_at, "job_id", "left").select("job_id", status.alias("status"), counted.alias("attempts"))
