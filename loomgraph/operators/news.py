"""Gathering items: source reconciliation, polling, submission and job checks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_blank, or_else
from loomgraph.operators.jobs import oldest
from loomgraph.operators.skew import lookup, top_per_key, top_per_large_key
from loomgraph.schemas import (
    DEFAULT_LOOKBACK_HOURS,
    POLL_ITEM_LIMIT,
    READ_LIMIT_MAX,
    STATUS_BATCH,
    SUBMIT_BATCH,
    SUBMIT_ERROR_MAX_CHARS,
    SUBMIT_MAX_ATTEMPTS,
    TERMINAL_JOB_STATUSES,
)

SOURCE_KEY = ["kind", "locator"]


def reconcile_sources(stored: DataFrame, specs: DataFrame) -> DataFrame:
    """Sources after reading the declared ones (``kind, locator, title, ord``), with ``change``:
    inserted, declared, deactivated or unchanged. Declared sources take the declared title and
    are active; all others become inactive and keep their history."""
    wanted = specs.groupBy(*SOURCE_KEY).agg(F.max_by(F.struct("title"), "ord").alias("spec"))
    both = stored.withColumn("_stored", F.lit(True)).join(wanted, SOURCE_KEY, "full_outer")
    declared, known = F.col("spec").isNotNull(), F.col("_stored").isNotNull()
    change = (
        F.when(declared & ~known, "inserted")
        .when(declared, "declared")
        .when(F.col("active"), "deactivated")
        .otherwise("unchanged")
    )
    return both.select(
        *SOURCE_KEY,
        F.when(declared, F.col("spec.title")).otherwise(F.col("title")).alias("title"),
        declared.alias("active"),
        "last_polled_at",
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        change.alias("change"),
    )


def polled_items(items: DataFrame, limit: int = POLL_ITEM_LIMIT) -> DataFrame:
    """Items with a body, the first ``limit`` per source in feed order (``pos``)."""
    return top_per_large_key(items.where(~is_blank(F.col("text"))), ["source_id"], [F.col("pos")], limit).drop("rank")


def absent_items(stored: DataFrame, polled: DataFrame) -> DataFrame:
    """The polled items a source does not hold yet; of equal keys the first counts."""
    key = ["source_id", "dedup_key"]
    return top_per_key(polled, key, [F.col("pos")], 1).drop("rank").join(stored.select(*key), key, "left_anti")


def apply_poll(sources: DataFrame, outcomes: DataFrame, run_ts: Column) -> DataFrame:
    """Sources after a poll. ``outcomes`` has ``source_id, ok, discovered_title``; a source that was
    not polled has no row. A title once set stays."""
    ok = F.col("ok")
    return (
        sources.join(outcomes, "source_id", "left")
        .withColumns(
            {
                "last_polled_at": F.when(ok, run_ts).otherwise(F.col("last_polled_at")),
                "failure_count": F.when(ok, 0).when(~ok, F.col("failure_count") + 1).otherwise(F.col("failure_count")),
                "title": F.when(ok, F.coalesce(or_else(F.col("title")), "discovered_title")).otherwise(F.col("title")),
            }
        )
        .drop("ok", "discovered_title")
    )


def unsubmitted(items: DataFrame) -> DataFrame:
    return items.where(F.col("job_id").isNull() & (F.col("attempts") < SUBMIT_MAX_ATTEMPTS))


def items_to_submit(items: DataFrame, n: int = SUBMIT_BATCH) -> DataFrame:
    return oldest(unsubmitted(items), ["created_at", "item_id"], n)


def dead_letters(items: DataFrame) -> DataFrame:
    """Items that used up their submissions."""
    return items.where(F.col("job_id").isNull() & (F.col("attempts") >= SUBMIT_MAX_ATTEMPTS))


def prepare_items(items: DataFrame, extracted: DataFrame, run_ts: Column) -> DataFrame:
    """Items with ``full_text``: the page's readable text (``item_id, page_text``), else the feed's own
    body. Stamped either way, and an item stamped before stays as it is."""
    due = F.col("extracted_at").isNull()
    return (
        items.join(extracted, "item_id", "left")
        .withColumn("full_text", F.when(due, F.coalesce(or_else(F.col("page_text")), "content")).otherwise(F.col("full_text")))
        .withColumn("extracted_at", F.coalesce("extracted_at", run_ts))
        .drop("page_text")
    )


def submission_metadata(title: Column, url: Column, published_at: Column) -> Column:
    """The JSON sent along with an item; absent values leave no key."""
    published = F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.to_json(
        F.struct(
            F.coalesce(or_else(title, url), F.lit("untitled")).alias("source"),
            or_else(url).alias("url"),
            published.alias("published_at"),
        )
    )


def apply_submissions(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Items after submission. ``outcomes`` has ``item_id, new_job_id, message``; a null job id is a failure."""
    sent, failed = F.col("new_job_id").isNotNull(), F.col("new_job_id").isNull() & F.col("_tried").isNotNull()
    return (
        items.join(outcomes.withColumn("_tried", F.lit(True)), "item_id", "left")
        .withColumns(
            {
                "job_id": F.coalesce("new_job_id", "job_id"),
                "job_status": F.when(sent, "pending").otherwise(F.col("job_status")),
                "error": F.when(sent, None)
                .when(failed, F.substring("message", 1, SUBMIT_ERROR_MAX_CHARS))
                .otherwise(F.col("error")),
                "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
            }
        )
        .drop("new_job_id", "message", "_tried")
    )


def is_outstanding() -> Column:
    return F.col("job_id").isNotNull() & (
        F.col("job_status").isNull() | ~F.col("job_status").isin(*TERMINAL_JOB_STATUSES)
    )


def outstanding_items(items: DataFrame, n: int = STATUS_BATCH) -> DataFrame:
    return oldest(items.where(is_outstanding()), ["created_at", "item_id"], n)


def record_statuses(items: DataFrame, statuses: DataFrame) -> DataFrame:
    """Outstanding items with the status their job reports (``job_id, status``); an empty or missing
    report changes nothing. ``resolved`` marks the ones that reached an end."""
    return with_statuses(lookup(items, statuses, ["job_id"]))


def with_statuses(joined: DataFrame) -> DataFrame:
    reported = or_else(F.col("status"))
    return (
        joined.withColumn("resolved", F.coalesce(reported.isin(*TERMINAL_JOB_STATUSES), F.lit(False)))
        .withColumn("job_status", F.coalesce(reported, "job_status"))
        .drop("status")
    )


def counters(df: DataFrame, **counts: Column) -> DataFrame:
    """One row of sweep counters."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in counts.items()))


def watermark(state: DataFrame, key: str, run_start: datetime, lookback_hours: int = DEFAULT_LOOKBACK_HOURS) -> datetime:
    """When the flow last covered its window (``key, ran_at``), else some hours before ``run_start``."""
    row = state.where(F.col("key") == key).agg(F.max("ran_at")).first()
    return row[0] or run_start - timedelta(hours=lookback_hours)


def advance_watermark(state: DataFrame, key: str, ran_at: datetime) -> DataFrame:
    new = state.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(ran_at).cast("timestamp").alias("ran_at"))
    return state.where(F.col("key") != key).unionByName(new)


def window_report(rows: DataFrame, limit: int = READ_LIMIT_MAX) -> DataFrame:
    """Per tenant: sources returned, whether the page was full, and the oldest date returned."""
    return rows.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("returned"),
        (F.count(F.lit(1)) >= limit).alias("truncated"),
        F.min(F.coalesce("ingested_at", "published_at")).alias("oldest"),
    )
