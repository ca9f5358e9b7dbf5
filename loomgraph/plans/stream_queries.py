"""The streaming flows over the given tables, each run as a sweep (``availableNow``) and held against the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.text import is_blank
from loomgraph.plans.news_queries import _POLLED, _polled
from loomgraph.plans.oracle_views import STORY_SOURCES
from loomgraph.plans.registry import query
from loomgraph.sources.files import stream_drop_directory, write_drop_directory
from loomgraph.sources.tables import Tables
from loomgraph.streaming import flows
from loomgraph.streaming.item_states import item_status_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEK_SECONDS = 7 * 24 * 3600
# For files far smaller than what Spark reckons to open one with, which would make a task for every few of them: the bytes a
# file counts for beside its own when they are dealt to tasks, and the tasks that list a micro-batch's files, each a path of its own.
SMALL_FILES = {
    "spark.sql.files.openCostInBytes": 16 << 10,
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": 64,
    "spark.sql.sources.ignoreDataLocality": "true",
}
# Files of one micro-batch: the driver holds the paths of so many at a time.
FILES_PER_BATCH = 100_000


@query(
    f"""WITH {_POLLED},
items AS (SELECT l_partkey % 97 AS source_id, pos, l_partkey % 1000 AS dedup_key, concat('text ', l_orderkey) AS text, l_orderkey % 2 AS arrival FROM order_lines WHERE l_returnflag <> 'R')
SELECT source_id, dedup_key, arg_min(text, arrival * 10000000000000 + pos) AS text FROM items GROUP BY 1, 2"""
)
def item_stream(t: Tables) -> DataFrame:
    """Feed items arrive in two sweeps; each key keeps the first text that came."""
    folder, table, check = (durable.fresh_folder(t.spark, kind) for kind in ("arrivals", "items", "checkpoint"))
    items = _polled(t).where(~is_blank(F.col("text")))
    odd = F.floor(F.col("pos") / 1000) % 2
    for arrival in (0, 1):
        items.where(odd == arrival).write.mode("append").parquet(folder)
        flows.insert_new_items(t.spark.readStream.schema(items.schema).parquet(folder), table, check).awaitTermination()
    return t.spark.read.parquet(table).select("source_id", "dedup_key", "text")


@query(
    f"""WITH {STORY_SOURCES}, days AS (SELECT kb_id, date_trunc('day', ingested_at) AS day, count(*) AS sources FROM sources GROUP BY 1, 2)
SELECT kb_id, strftime(day, '%Y-%m-%d') AS day, sources FROM days
WHERE day + INTERVAL 1 DAY <= (SELECT max(ingested_at) FROM sources) - INTERVAL 1 DAY"""
)
def daily_source_stream(t: Tables) -> DataFrame:
    """Sources per tenant and day as a windowed stream; the last days stay open."""
    folder, table, check = (durable.fresh_folder(t.spark, kind) for kind in ("arrivals", "days", "checkpoint"))
    arrived = t.story_sources().withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    arrived.write.parquet(folder)
    daily = flows.daily_sources(t.spark.readStream.schema(arrived.schema).parquet(folder))
    writer = daily.writeStream.format("parquet").option("path", table).option("checkpointLocation", check).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = t.spark.read.parquet(table)
    return found.select("kb_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("sources").cast("bigint").alias("sources"))


@query("""SELECT count(*) AS files, sum(length(text) + 1)::BIGINT AS chars, count(DISTINCT text) AS texts FROM documents""")
def drop_directory_stream(t: Tables) -> DataFrame:
    """Documents dropped as text files, one per document, and swept up."""
    folder, table, check = (durable.fresh_folder(t.spark, kind) for kind in ("dropped", "swept", "checkpoint"))
    named = t.documents().select(F.concat_ws("-", "source", "doc_id").alias("name"), F.col("text").alias("value"))
    write_drop_directory(named, folder)
    files = stream_drop_directory(t.spark, folder, FILES_PER_BATCH)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    before = {key: t.spark.conf.get(key) for key in SMALL_FILES}
    try:
        for key, value in SMALL_FILES.items():
            t.spark.conf.set(key, value)
        flows.sweep(files, keep, check).awaitTermination()
    finally:
        for key, value in before.items():
            t.spark.conf.set(key, value)
    found = t.spark.read.parquet(table)
    return found.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"), F.countDistinct("text").alias("texts"))


@query(
    """WITH told AS (
  SELECT event_id, ts, event_type, concat(user_id, '/', strftime(date_trunc('week', ts), '%Y-%m-%d')) AS job_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE concat('seen by ', event_type) END AS status FROM events),
jobs AS (
  SELECT job_id, arg_min(status, ts) FILTER (event_type IN ('error', 'purchase')) AS ended,
    arg_max(status, ts) FILTER (event_type IN ('view', 'click')) AS seen, max(ts) AS last FROM told GROUP BY 1)
SELECT t.event_id::VARCHAR AS item_id, t.job_id, coalesce(ended, seen, 'pending') AS job_status, ended IS NOT NULL AS resolved,
  ended IS NULL AND last + INTERVAL 7 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS gave_up
FROM told t JOIN jobs USING (job_id) WHERE event_type = 'signup'"""
)
def item_statuses(t: Tables) -> DataFrame:
    """Sign-ups as items whose job is a user's week, other events as reports on it: they come in two sweeps, and items wait in the
    stream's state until an error or a purchase ends their job, or until a week has passed without a word."""
    folder, table, check = (durable.fresh_folder(t.spark, kind) for kind in ("arrivals", "statuses", "checkpoint"))
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "done").otherwise(F.concat(F.lit("seen by "), kind))
    told = t.raw("events").select(
        F.when(kind == "signup", F.col("event_id")).cast("string").alias("item_id"), F.concat_ws("/", "user_id", week).alias("job_id"),
        F.when(kind != "signup", status).alias("status"), F.col("ts").cast("timestamp").alias("ts"),
    )
    half = told.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long"))).first()[0]

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, ROCKS)
    try:
        for arrived in (told.where(F.col("ts") <= F.lit(half)), told.where(F.col("ts") > F.lit(half))):
            arrived.write.mode("append").parquet(folder)
            stream = t.spark.readStream.schema(told.schema).parquet(folder)
            statuses = item_status_stream(stream, stream, WEEK_SECONDS)
            writer = statuses.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep)
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(key, before)
    latest = F.max_by(F.struct("job_id", "job_status", "resolved", "gave_up"), "batch").alias("v")
    return t.spark.read.parquet(table).groupBy("item_id").agg(latest).select("item_id", "v.*")
