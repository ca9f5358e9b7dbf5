"""Building blocks that keep one hot key from becoming one hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tasks that share a key with very many rows before its rows meet in one.
SALTS = 32


def lookup(requests: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``requests`` with ``table``, moving only the table rows that are asked for.

    A left join cannot broadcast its left side, so few requests would still shuffle the whole
    table. The semi-join goes first: broadcast by its size for few requests, and for many
    it leaves the table partitioned as the join needs it."""
    asked = requests.select(*keys).distinct()
    return requests.join(table.join(asked, keys, "left_semi"), keys, "left")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key. Spark prunes each key to ``k`` rows per task
    before the shuffle, so a hot key costs ``k`` rows per map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_per_large_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """``top_per_key`` for a few keys that hold very many rows, such as tenants: each map task's first ``k`` go to one of
    ``salts`` tasks per key, and only the first ``k`` of each of these meet in one."""
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return top_per_key(top_per_key(salted, [*keys, "_salt"], order, k, rank).drop("_salt", rank), keys, order, k, rank)


def gathered(df: DataFrame, keys: list[str], order: list[str], item: Column) -> DataFrame:
    """``keys, items, n``: the whole list of each key, in the order of the given columns.

    For keys whose rows come out of one stored value (a model's answer, a prompt's parts), which bounds them."""
    listed = F.sort_array(F.collect_list(F.struct(*order, item.alias("_item"))))
    return df.groupBy(*keys).agg(listed.alias("_list"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("_list._item").alias("items"), "n")


def running_last(
    df: DataFrame, keys: list[str], pos: str, value: str, name: str, chunk: int = 10_000
) -> DataFrame:
    """Latest non-null ``value`` at or before each row's ``pos``, per key.

    Each key is cut into stretches of ``chunk`` positions: a window inside the
    stretch, plus the value carried in from earlier stretches. No task ever holds
    more than one stretch of a key, whatever the key's size."""
    cut = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*cut).agg(F.max_by(value, pos).alias("_end"))
    # Every stretch gets the last value of the stretches before it.
    stretches = rows.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(ends, cut, "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy(*cut).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(carried, cut)
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_chunk", "_carry")
    )
