"""The job state machine over a stream of outcome events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.schemas import JOB_MAX_ATTEMPTS

OUTPUT = "job_id string, status string, attempts int"
WAITING = {"submitted": "pending", "failed_attempt": "pending", "processing": "processing", "done": "done"}

# What decides a job, as far as it has been seen: [first done, first failures, last event].
# Each event is (time, id, name); the order of arrival does not matter.
EMPTY = [None, [], None]


def absorb(seen: list, event: tuple[int, int, str], max_attempts: int = JOB_MAX_ATTEMPTS) -> list:
    done, failures, last = seen
    at = list(event[:2])
    if event[2] == "done":
        done = at if done is None else min(done, at)
    if event[2] == "failed_attempt":
        failures = sorted([*failures, at])[:max_attempts]
    return [done, failures, max([last, list(event)], key=lambda e: e or [])]


def outcome(seen: list, max_attempts: int = JOB_MAX_ATTEMPTS) -> tuple[str, int]:
    """(status, attempts): the first ``done``, or the last allowed failure, ended the job."""
    done, failures, last = seen
    attempts = sum(done is None or at < done for at in failures)
    if attempts >= max_attempts:
        return "failed", attempts
    return ("done" if done is not None else WAITING[last[2]]), attempts


class JobStates(StatefulProcessor):
    """A job's state is a few events, however many it has had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "seen string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = json.loads(self._state.get()[0]) if self._state.exists() else EMPTY
        for batch in rows:
            times = batch["ts"].astype("datetime64[us]").astype("int64")
            for event in zip(times.tolist(), batch["event_id"].tolist(), batch["event"].tolist(), strict=True):
                seen = absorb(seen, event)
        self._state.update((json.dumps(seen),))
        status, attempts = outcome(seen)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame) -> DataFrame:
    """``job_id, status, attempts`` after each micro-batch of events (``job_id, ts, event_id, event``), in update mode.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobStates(), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )
