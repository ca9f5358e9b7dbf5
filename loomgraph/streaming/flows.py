"""The same operators as Structured Streaming jobs.

Every flow runs with ``trigger(availableNow=True)`` as a scheduled sweep, or with an
interval as a continuous one; the checkpoint remembers what was covered."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomgraph import durable
from loomgraph.operators import graph_read, news
from loomgraph.plans import knowledge
from loomgraph.streaming.store import TableStore

QUEUE_SCHEMA = "job_id string, kb_id string, content string, metadata string, created_at timestamp"
ITEM_KEY = ["source_id", "dedup_key"]
GRAPH = ("entities", "related", "sources", "mentions")


def queue_stream(spark: SparkSession, path: str) -> DataFrame:
    """Jobs dropped as JSON files into a directory."""
    return spark.readStream.schema(QUEUE_SCHEMA).json(path)


def as_jobs(arrived: DataFrame) -> DataFrame:
    return arrived.select(
        "*", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("relevance_reason"),
        F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("processed_at"),
    )


def stream_id(batch: DataFrame) -> str:
    """The id a stream keeps in its checkpoint: a new checkpoint makes a new stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def drain_stream(
    arrived: DataFrame, store: TableStore, models: knowledge.Models, checkpoint: str, interval: str | None = None, in_turn: bool = False
) -> StreamingQuery:
    """Merge arriving jobs, and the ones that wait for another attempt, into the stored graph, all at once or ``in_turn``.

    Each micro-batch writes the buckets it touches as the next version and then commits it; a repeated micro-batch of
    the same stream finds itself committed and does nothing."""
    merge = knowledge.merge_in_turn if in_turn else knowledge.merge

    def step(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        if store.holds(stream, batch_id):
            return
        run_ts = F.lit(datetime.now(UTC))
        stored = {name: store.read(name, buckets=name in GRAPH) for name in store.tables}
        jobs = stored["jobs"]
        fresh = as_jobs(batch).dropDuplicates(["job_id"]).join(jobs.select("job_id"), "job_id", "left_anti")
        waiting = durable.cut(jobs.where("status = 'pending'").unionByName(fresh.select(*jobs.columns)))
        merged = merge(waiting, knowledge.State(**stored | {"jobs": waiting}), models, run_ts, f"stream/{stream}/{batch_id}")
        store.write({name: getattr(merged.changes, name) for name in store.tables}, stream, batch_id)

    writer = arrived.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def first_sightings(items: DataFrame) -> DataFrame:
    """Each (source, key) once, for ever: keys never expire, so the state grows with the items ever
    seen. ``insert_new_items`` keeps them in a table instead."""
    return items.dropDuplicates(ITEM_KEY)


def insert_new_items(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append items the table does not hold; the table itself is the memory.

    A micro-batch of a stream owns one folder of the table and rewrites it when it is repeated; all other
    folders count as stored, whichever stream wrote them."""
    spark = items.sparkSession
    schema = items.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        stored = _others(spark, path, schema, stream, batch_id)
        news.absent_items(stored, batch).write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch_id}")

    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()


def _others(spark: SparkSession, path: str, schema, stream: str, batch_id: int) -> DataFrame:
    if not durable.exists(spark, path):
        return spark.createDataFrame([], schema)
    stored = schema.fieldNames()
    table = spark.read.schema(T.StructType([*schema, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])).parquet(path)
    own = (F.col("stream") == stream) & (F.col("batch") == batch_id)
    return table.where(~own).select(*stored)


def daily_sources(sources: DataFrame, late: str = "1 day") -> DataFrame:
    """Sources per tenant and day of ingestion, closed once ``late`` has passed."""
    return (
        sources.withWatermark("ingested_at", late)
        .groupBy("kb_id", F.window("ingested_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("sources"), F.min("ingested_at").alias("oldest"))
        .select("kb_id", F.col("window.start").alias("day"), "sources", "oldest")
    )


def live_status(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Arriving items with the status of their job, from the current job table."""
    return news.with_statuses(items.join(jobs.select("job_id", "status"), "job_id", "left"))


def sources_of_window(sources: DataFrame, since, until=None, half_open: bool = False) -> DataFrame:
    """Sources from ``since`` on, the boundary included, so a boundary row may be in two windows;
    ``half_open`` takes (since, until] instead."""
    inside = graph_read.at_least(sources, "ingested_at", since)
    if half_open:
        inside = ~(F.col("ingested_at") <= F.lit(since).cast(sources.schema["ingested_at"].dataType))
    if until is not None:
        inside = inside & (F.col("ingested_at") <= F.lit(until).cast(sources.schema["ingested_at"].dataType))
    return sources.where(inside)


def sweep(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``step`` once over everything that arrived since the last sweep."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
