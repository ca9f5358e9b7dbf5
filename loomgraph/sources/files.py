"""Drop directories of text files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomgraph.schemas import TEXT_SUFFIXES

_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def _has_text_suffix(name: Column) -> Column:
    return F.lower(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).isin(*TEXT_SUFFIXES) & name.contains(".")


def files_to_items(files: DataFrame) -> DataFrame:
    """Items of files read as bytes: the key is the name and a digest of the text, so an edited
    file is a new item. Invalid UTF-8 is replaced, line ends are unified."""
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    return (
        files.withColumn("title", name)
        .where(_has_text_suffix(F.col("title")))
        .withColumn("text", text)
        .select(
            F.concat("title", F.lit(":"), F.substring(F.sha2("text", 256), 1, 16)).alias("dedup_key"),
            F.lit(None).cast("string").alias("url"),
            "title",
            "text",
            F.col("modificationTime").alias("published_at"),
            F.xxhash64("title").alias("pos"),
        )
    )


def write_drop_directory(texts: DataFrame, path: str) -> None:
    """Drop texts (``name, value``) as files ``name=<name>.txt`` of one directory; rows that share a name are lines of one file.

    Tasks write their files in place, so a file costs one open and no rename, and a repeated task writes the same ones again."""

    def drop(rows: Iterator[Row]) -> None:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder)
        for name, lines in groupby(rows, lambda r: r["name"]):
            with system.open_output_stream(f"{folder}/name={quote(name, safe='')}.txt") as out:
                for line in lines:
                    out.write(f"{line['value'] or ''}\n".encode())

    texts.select("name", "value").repartition("name").sortWithinPartitions("name").foreachPartition(drop)


def read_drop_directory(spark: SparkSession, path: str) -> DataFrame:
    """Items of one directory (not below it); a missing directory is empty."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        files = spark.createDataFrame([], _FILE)
    return files_to_items(files)


def stream_drop_directory(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same items as files arrive, in micro-batches of at most ``files_per_batch`` files, if given."""
    reader = spark.readStream.format("binaryFile").schema(_FILE)
    if files_per_batch:
        # The directory is listed once; what a micro-batch leaves is kept for the next ones.
        reader = reader.option("maxFilesPerTrigger", files_per_batch).option("maxCachedFiles", (1 << 31) - 1)
    return files_to_items(reader.load(path))
