"""Submitted items that wait in keyed state until their job ends or time is up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.functions.text import or_else
from loomgraph.schemas import TERMINAL_JOB_STATUSES

OUTPUT = "item_id string, job_id string, job_status string, resolved boolean, gave_up boolean"
UNREPORTED = "pending"


def reported(status: str | None, reports: list[tuple[int, str]]) -> str | None:
    """A job's status after the reports (time, status) that arrived together: the first one that ends it holds for
    good, otherwise the latest counts."""
    if status in TERMINAL_JOB_STATUSES or not reports:
        return status
    ends = [r for r in reports if r[1] in TERMINAL_JOB_STATUSES]
    return min(ends)[1] if ends else max(reports)[1]


class ItemStates(StatefulProcessor):
    """Per job: the status heard last, and the items that wait for its end. A job has one item or a few."""

    def __init__(self, patience_ms: int) -> None:
        self._patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._heard = handle.getValueState("heard", "status string, at_ms long, timer_ms long")
        self._waiting = handle.getListState("waiting", "item_id string")

    def _rows(self, job, items, status, gave_up=False) -> Iterator[Row]:
        ended = status in TERMINAL_JOB_STATUSES
        for item in items:
            yield Row(item_id=item, job_id=job, job_status=status or UNREPORTED, resolved=ended, gave_up=gave_up)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each call to the state is a message to the JVM: a job heard of for the first time has no items and no timer to ask for.
        known = self._heard.get() if self._heard.exists() else None
        before, at_ms, timer_ms = known or (None, 0, None)
        reports, arrived = [], {}
        for row in rows:
            at_ms = max(at_ms, row["at_ms"])
            if row["item_id"] is not None:
                arrived[row["item_id"]] = None
            elif row["status"] is not None:
                reports.append((row["at_ms"], row["status"]))
        status = reported(before, reports)
        waiting = [r[0] for r in self._waiting.get()] if known and self._waiting.exists() else []
        fresh = [i for i in arrived if i not in waiting]
        told = (waiting + fresh) if status != before else list(arrived)
        if status in TERMINAL_JOB_STATUSES:
            if waiting:
                self._waiting.clear()
        elif fresh:
            self._waiting.appendList([(i,) for i in fresh])
        due = max(at_ms + self._patience, timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer_ms:
            if timer_ms is not None:
                self._handle.deleteTimer(timer_ms)
            self._handle.registerTimer(due)
        self._heard.update((status, at_ms, due))
        yield from self._rows(key[0], told, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status = self._heard.get()[0] if self._heard.exists() else None
        waiting = [r[0] for r in self._waiting.get()] if self._waiting.exists() else []
        self._heard.clear()
        self._waiting.clear()
        yield from self._rows(key[0], waiting, status, gave_up=True)

    def close(self) -> None:
        pass


def item_status_stream(items: DataFrame, reports: DataFrame, patience_seconds: int, late: str = "1 hour") -> DataFrame:
    """Items (``item_id, job_id, ts``) with the status of their job, told again whenever it changes, until it ends.

    ``reports`` has ``job_id, status, ts`` and may come in any later micro-batch; empty reports change nothing, and items
    without a job are nobody's to wait for. ``resolved`` marks the end. A job that nothing was heard of for
    ``patience_seconds`` of event time is forgotten, and its waiting items are told once more with ``gave_up``, so the
    state does not outgrow that time. Rows more than ``late`` behind the newest are dropped, as with any watermark.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    none = F.lit(None).cast("string")
    text = {c: F.col(c).cast("string").alias(c) for c in ("item_id", "job_id")}
    waiting = items.select(text["job_id"], text["item_id"], none.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    heard = reports.select(text["job_id"], none.alias("item_id"), or_else(F.col("status")).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    both = waiting.where("item_id IS NOT NULL").unionByName(heard.where("status IS NOT NULL"))
    timed = both.where("job_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("job_id").transformWithState(
        statefulProcessor=ItemStates(patience_seconds * 1000), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )
