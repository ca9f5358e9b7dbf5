"""Tables written to the cluster's shared folder, to cut lineage and publish state.

Executors may be lost at any time, so nothing here lives on an executor's own
disk: an intermediate that is read more than once, or that closes a loop
iteration, becomes a parquet table under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; on one machine (``local[..]``) a
    temporary one when the setting is missing."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    path = tempfile.mkdtemp(prefix="loomgraph-")
    spark.conf.set(_CHECKPOINT_KEY, path)
    return path


def run_dir(spark: SparkSession) -> str:
    """This application's folder of intermediates; the driver deletes it when it ends."""
    folder = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    path, system = _located(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A name nobody has used, in the run's folder."""
    return f"{run_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` to the run's folder and return a reader of the written table; the columns it is partitioned by, if any,
    are its last ones. Without a ``compression`` the session's holds."""
    spark = df.sparkSession
    path = fresh_folder(spark, "cut")
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def packed(df: DataFrame) -> DataFrame:
    """``cut`` for texts and hashed ids, which zstd halves and the usual compression leaves as they are."""
    return cut(df, compression="zstd")


def _located(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """Path, length and modification time of every file below ``folder``: what changes when its tables do."""
    path, system = _located(spark, folder)
    files, found = system.listFiles(path, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there."""
    path, system = _located(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _located(spark, path)
    return system.exists(target)


def cut_counted(df: DataFrame, **flags: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut`` that also counts the rows (``n``) and the rows matching each flag, in the
    same pass as the write."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n")] + [F.count_if(flag).alias(name) for name, flag in flags.items()]
    table = cut(df.observe(seen, *metrics))
    return table, seen.get


def drop(df: DataFrame) -> None:
    """Delete a table made by ``cut`` once nothing reads it any more; other tables are left alone."""
    path = df.__dict__.get("_stored_at")
    if path:
        delete(df.sparkSession, path)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write one snapshot of a table to a fresh folder below ``path`` and return it.

    Readers switch to the returned folder only after the write has committed."""
    target = f"{path.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target
