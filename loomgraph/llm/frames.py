"""Row-wise helpers between Spark and Arrow, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.session import prepare

# Rows handed back to Spark at a time.
OUT_ROWS = 20_000
OUT_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, with the session settings the operators rely on."""
    prepare(spark)
    # Whole texts travel in these batches, so they are bounded by bytes, not only by rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def hash_below(column: str, share: float | Column) -> Column:
    """True for about a ``share`` of the values, always the same ones: those with the smallest hashes."""
    place = (F.xxhash64(column).cast("double") + 2.0**63) / 2.0**64
    return place < share


def text_key(text: str | Column = "text") -> list[Column]:
    """``key`` and ``chars``: with ``doc_id`` they name a row by its content, so that repeated or missing ids do no harm.

    Very many rows may share an id, so both a 64-bit hash and the length have to agree."""
    return [F.xxhash64(text).alias("key"), F.coalesce(F.length(text), F.lit(-1)).alias("chars")]


def one_text_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text``: of each key's rows the text with the smallest hash, however many rows a key has."""
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, F.col("_first.text").alias("text"))


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        if batch.num_columns == 1:
            for x in batch.column(0):
                yield (x.as_py(),)
        else:
            for row in zip(*batch.columns, strict=True):
                yield tuple(x.as_py() for x in row)


def _run(batches, make, schema, arrow):
    out, weight = [[] for _ in arrow.names], 0
    for row in make(_values(batches)):
        for column, value in zip(out, row, strict=True):
            column.append(value)
            if isinstance(value, (str, bytes)):
                weight += len(value)
        if len(out[0]) >= OUT_ROWS or weight >= OUT_BYTES:
            yield _batch(out, arrow)
            out, weight = [[] for _ in arrow.names], 0
    if out[0]:
        yield _batch(out, arrow)


def _batch(columns, arrow):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def map_rows(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``make`` over the rows of each partition; it takes and yields tuples, one row at a time,
    and so never holds more than it keeps itself."""
    parsed = StructType.fromDDL(schema)
    return df.mapInArrow(partial(_run, make=make, schema=schema, arrow=to_arrow_schema(parsed)), parsed)


def map_arrays(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[list]], schema: str) -> DataFrame:
    """Like ``map_rows``, but ``make`` yields whole columns (lists or NumPy arrays of one length)."""
    parsed = StructType.fromDDL(schema)
    return df.mapInArrow(partial(_run_arrays, make=make, arrow=to_arrow_schema(parsed)), parsed)


def _run_arrays(batches, make, arrow):
    for columns in make(_values(batches)):
        yield _batch(columns, arrow)
