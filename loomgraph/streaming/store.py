"""Versions of a set of tables in one folder of the shared file system, in buckets of their keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import durable
from loomgraph.operators.graph_write import BUCKET, bucket_of, replaced, touched_buckets
from loomgraph.plans.knowledge import KEYS


@dataclass
class TableStore:
    """``path/<table>/v=<n>/_bucket=<b>`` holds bucket b of a table as version n wrote it; the line below
    ``path/commits/v=<n>`` says which version holds each bucket now, and so makes version n current.

    A batch writes the buckets of the keys it changes and no others. Rows of a bucket lie by tenant, so that reading one
    tenant skips most row groups. ``buckets`` is fixed when the store is made: rows a table is expected to hold, over
    the rows one batch should rewrite for a changed key; ``files`` spreads each bucket over as many tasks. What
    only superseded versions hold is deleted, but for the last ``keep`` ones, which readers may still be reading.

    Versions count on their own. A commit names the last micro-batch of each stream, so a repeated batch is
    known, and a stream that starts anew (batch 0 again) is not taken for one that was stored."""

    spark: SparkSession
    path: str
    buckets: int = 64
    files: int = 1
    keep: int = 2
    keys: dict[str, list[str]] = field(default_factory=lambda: dict(KEYS))

    @property
    def tables(self) -> tuple[str, ...]:
        return tuple(self.keys)

    def _commits(self) -> list[dict]:
        """The commits that are kept, the current one last."""
        try:
            lines = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.path}/commits")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted((json.loads(r[0]) for r in lines.collect()), key=lambda c: c["version"])

    def _current(self) -> dict:
        commits = self._commits()
        return commits[-1] if commits else {"version": -1, "buckets": self.buckets, "streams": {}, "tables": {}}

    def version(self) -> int:
        """The current version, -1 when there is none."""
        return self._current()["version"]

    def holds(self, stream: str, batch: int) -> bool:
        """Whether this micro-batch of this stream is stored."""
        return self._current()["streams"].get(stream, -1) >= batch

    def _table(self, commit: dict, table: str) -> DataFrame:
        stored = commit["tables"][table]
        schema = T.StructType.fromJson(stored["schema"]).add(BUCKET, T.IntegerType())
        paths = [f"{self.path}/{table}/v={v}/{BUCKET}={b}" for b, v in stored["at"].items()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.path}/{table}").schema(T.StructType([*schema, T.StructField("v", T.LongType())]))
        frame = reader.parquet(*paths).drop("v")
        frame._buckets = commit["buckets"]
        return frame

    def read(self, table: str, buckets: bool = False) -> DataFrame:
        """The current rows; with ``buckets`` as a table of which changes read the touched buckets only."""
        frame = self._table(self._current(), table)
        return frame if buckets else frame.drop(BUCKET)

    def touched(self, changes: dict[str, DataFrame]) -> dict[str, list[int]]:
        return {t: touched_buckets(rows, self.keys[t], self._current()["buckets"]) for t, rows in changes.items()}

    def write(self, changes: dict[str, DataFrame], stream: str = "", batch: int = 0) -> None:
        """Write the buckets that ``changes`` touch, with the changed rows in them, as the next version, then commit it.
        An unfinished version is overwritten. Changes are read twice: give written tables.

        The first version has to name all tables, empty ones too."""
        commits = self._commits()
        commit = commits[-1] if commits else self._current()
        version, count = commit["version"] + 1, commit["buckets"]
        tables = dict(commit["tables"])
        for name, rows in changes.items():
            keys = self.keys[name]
            touched = touched_buckets(rows, keys, count)
            if name not in tables:
                tables[name] = {"schema": rows.schema.jsonValue(), "at": {}}
            if not touched:
                continue
            at = tables[name]["at"]
            if any(str(b) in at for b in touched):
                stored = self._table(commit, name).where(F.col(BUCKET).isin(touched))
                rows = replaced(stored, rows, keys)
            place = F.pmod(F.xxhash64(*(F.col(k) for k in keys), F.lit(1)), F.lit(self.files))
            by_tenant = [c for c in ("kb_id",) if c in rows.columns]
            (
                rows.withColumn(BUCKET, bucket_of(keys, count))
                .repartition(BUCKET, place)
                .sortWithinPartitions(BUCKET, *by_tenant)
                .write.mode("overwrite")
                .partitionBy(BUCKET)
                .parquet(f"{self.path}/{name}/v={version}")
            )
            tables[name] = {**tables[name], "at": at | {str(b): version for b in touched}}
        streams = commit["streams"] | {stream: batch}
        after = {"version": version, "buckets": count, "streams": streams, "tables": tables}
        line = self.spark.createDataFrame([(json.dumps(after),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/v={version}")
        self._forget([*commits, after])

    def _forget(self, commits: list[dict]) -> None:
        """Delete commits older than the last ``keep``, then the buckets none of the others names."""
        old, kept = commits[: -self.keep], commits[-self.keep :]
        held = {(t, b, v) for c in kept for t, stored in c["tables"].items() for b, v in stored["at"].items()}
        for commit in old:
            durable.delete(self.spark, f"{self.path}/commits/v={commit['version']}")
            for table, stored in commit["tables"].items():
                for bucket, version in stored["at"].items():
                    if (table, bucket, version) not in held:
                        durable.delete(self.spark, f"{self.path}/{table}/v={version}/{BUCKET}={bucket}")
