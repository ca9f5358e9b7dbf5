"""RSS and Atom feeds read with Spark's XML source, and the item rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.dates import parse_feed_date
from loomgraph.functions.text import clean_title, or_else, strip
from loomgraph.functions.urls import canonical_url, is_web_url
from loomgraph.schemas import SOURCE_KINDS

_TEXT = T.StringType()
# The elements of an entry; a list keeps the first of repeated ones.
_RSS = T.StructType(
    [T.StructField(n, _TEXT) for n in ("title", "link", "description", "pubDate", "updated", "date", "encoded")]
    + [T.StructField("guid", T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("_isPermaLink", _TEXT)]))]
)
_ATOM_LINK = T.StructType([T.StructField("_href", _TEXT), T.StructField("_rel", _TEXT)])
_ATOM = T.StructType(
    [T.StructField(n, _TEXT) for n in ("title", "id", "summary", "published", "updated", "content")]
    + [T.StructField("link", T.ArrayType(_ATOM_LINK))]
)


def _xml(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema)
    return reader.load(path).select("*", F.col("_metadata.file_path").alias("locator"), F.col("_metadata.file_block_start").alias("block"))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries of the feed files below ``path``: ``locator, pos, guid, link, title, content, summary, published``."""
    rss = _xml(spark, path, "item", _RSS).select(
        "locator",
        "block",
        F.col("guid._VALUE").alias("guid"),
        "link",
        "title",
        F.col("encoded").alias("content"),
        F.col("description").alias("summary"),
        F.coalesce("pubDate", "updated", "date").alias("published"),
    )
    own = F.filter("link", lambda a: a["_rel"].isNull() | (a["_rel"] == "alternate"))
    atom = _xml(spark, path, "entry", _ATOM).select(
        "locator",
        "block",
        F.col("id").alias("guid"),
        F.coalesce(F.get(own, 0)["_href"], F.get("link", 0)["_href"]).alias("link"),
        "title",
        "content",
        "summary",
        F.coalesce("published", "updated").alias("published"),
    )
    # Splits of a file may be read in any order. A split has fewer entries than bytes, so its start plus the place in
    # it follows the order of the file.
    inside = Window.partitionBy("locator", "block").orderBy("_n")
    entries = rss.unionByName(atom).withColumn("_n", F.monotonically_increasing_id())
    return entries.withColumn("pos", F.col("block") + F.row_number().over(inside)).drop("_n", "block")


def feed_titles(spark: SparkSession, path: str) -> DataFrame:
    """``locator, feed_title`` of RSS channels and Atom feeds."""
    only = T.StructType([T.StructField("title", _TEXT)])
    both = _xml(spark, path, "channel", only).unionByName(_xml(spark, path, "feed", only))
    return both.groupBy("locator").agg(F.first("title").alias("feed_title"))


def dedup_key(guid: Column, link: Column) -> Column:
    """The entry's own id, else its canonical link; null when it has neither."""
    return F.coalesce(or_else(guid), canonical_url(or_else(link)))


def item_url(guid: Column, link: Column) -> Column:
    """The link when it is a clean URL, else the id when that is one."""
    return F.coalesce(F.when(is_web_url(link), strip(link)), F.when(is_web_url(guid), strip(guid)))


def item_text(content: Column, summary: Column) -> Column:
    """The full body when the entry has one, even an empty one; else the summary."""
    return F.when(content.isNotNull(), or_else(content)).otherwise(or_else(summary))


def to_items(entries: DataFrame) -> DataFrame:
    """Items of raw entries; an entry without any key is left out."""
    guid, link = F.col("guid"), F.col("link")
    return entries.withColumns(
        {
            "dedup_key": dedup_key(guid, link),
            "url": item_url(guid, link),
            "title": clean_title(F.col("title")),
            "text": item_text(F.col("content"), F.col("summary")),
            "published_at": parse_feed_date(F.col("published")),
        }
    ).where("dedup_key IS NOT NULL").drop("guid", "link", "content", "summary", "published")


def feed_outcomes(requested: DataFrame, entries: DataFrame, titles: DataFrame) -> DataFrame:
    """``locator, ok, feed_title`` per requested feed; a feed that yields no entry failed."""
    counted = entries.groupBy("locator").agg(F.count(F.lit(1)).alias("n"))
    return (
        requested.select("locator")
        .distinct()
        .join(counted, "locator", "left")
        .join(titles, "locator", "left")
        .select("locator", (F.coalesce("n", F.lit(0)) > 0).alias("ok"), "feed_title")
    )


def check_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid specs with ``locator``, rejected specs with ``reason``) of declared sources (``kind, url, path,
    title``)."""
    located = specs.withColumn("locator", or_else(F.col("url"), F.col("path")))
    reason = F.when(
        ~F.coalesce(F.col("kind").isin(*SOURCE_KINDS), F.lit(False)),
        F.concat(F.lit("no reader for kind "), F.coalesce("kind", F.lit(""))),
    ).when(
        F.col("locator").isNull(), F.concat(F.col("kind"), F.lit(" without a place: give url or path"))
    )
    judged = located.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason", "url", "path"), judged.where("reason IS NOT NULL")


def fetch_items(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Items of several (kind, path) sources, each kind with its own reader."""
    from loomgraph.sources.files import read_drop_directory

    readers = {"rss": lambda path: to_items(read_feeds(spark, path)), "files": lambda path: read_drop_directory(spark, path)}
    frames = []
    for kind, path in sources:
        if kind not in readers:
            raise ValueError(f"no reader for kind {kind}")
        columns = ["dedup_key", "url", "title", "text", "published_at", "pos"]
        frames.append(readers[kind](path).select(F.lit(kind).alias("kind"), F.lit(path).alias("locator"), *columns))
    if not frames:
        return spark.createDataFrame([], "kind string, locator string, dedup_key string, url string, title string, text string, published_at timestamp, pos long")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
