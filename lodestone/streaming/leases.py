"""Leases of jobs as keyed state with timers: heartbeats extend them, silence gives the job back.

The log has ``job, id, at, kind`` with the kinds ``claim``, ``heartbeat`` and ``complete``.  A claim of a waiting job begins an
attempt with a lease; a claim of a running job is refused.  A heartbeat of a running job begins its lease anew.  A lease that
ends gives the job back for ``retry``, after the last attempt it has ``failed``.  What ended takes no more notice of its log.

With ``eventTime`` a job's entries wait in the state until the watermark has passed them and are taken in order of ``(at, id)``,
so the result doesn't depend on how they came in batches; leases end by the watermark, too.  With ``processingTime`` entries count
from when they arrive, and a timer of the clock ends the lease.

Jobs are dealt to buckets, which are the keys of the state: what waits in a bucket is read and written whole, and has one timer for its
first moment, as a call between Python and the state store costs more than many entries.  A job's status is a value of its own in
the bucket's map, and is touched only when the job is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "job long, at long, attempt int, status string"
ENTRIES = pa.schema([("job", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("kind", pa.string())])
BUCKETS = 1024


def advance(state: tuple[str, int, int], entries: list[tuple[int, int, str]], until: int, lease: int, attempts: int) -> tuple[tuple[str, int, int], list[tuple[int, int, str]]]:
    """The state ``(status, attempt, lease end)`` after ``entries`` (in order) and the clock at ``until``, and its changes ``(at, attempt, status)``."""
    status, attempt, end = state
    changes = []
    for at, _, kind in [*entries, (until, 0, "")]:
        if status == "running" and end < at:
            status = "failed" if attempt >= attempts else "retry"
            changes.append((end, attempt, status))
        if kind == "claim" and status in ("", "retry"):
            status, attempt, end = "running", attempt + 1, at + lease
            changes.append((at, attempt, status))
        elif kind == "heartbeat" and status == "running":
            end = at + lease
        elif kind == "complete" and status == "running":
            status = "completed"
            changes.append((at, attempt, status))
    return (status, attempt, end), changes


def packed(entries: pd.DataFrame) -> bytes:
    """Entries as an Arrow stream, so that the state store takes them as one value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ENTRIES) as writer:
        writer.write_batch(pa.RecordBatch.from_pandas(entries, ENTRIES, preserve_index=False))
    return out.getvalue().to_pybytes()


def unpacked(entries: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(entries).read_pandas()


class Leases(StatefulProcessor):
    """The jobs of a bucket.  The moments of entries and of leases' ends lie before the clock, not on it, when they are taken; so
    timers stand a moment later.  A lease's end waits among the entries as one of no kind, which only wakes its job."""

    def __init__(self, lease_ms: int, attempts: int, event_time: bool):
        self.lease_ms, self.attempts, self.event_time = lease_ms, attempts, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job long", "status string, attempt int, lease_end long")
        self.waiting = handle.getListState("waiting", "entries binary")

    def _now(self, timers: Any) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = (batch[["job", "at_ms", "id", "kind"]].rename(columns={"at_ms": "at"}) for batch in rows)
        if key[0] < 0:  # entries without a job or a moment
            return
        if self.event_time:  # they are taken when the watermark has passed them
            self._wait(new)
        else:
            now = self._now(timerValues)
            yield from self._advance(pd.concat(list(new)).assign(at=now), now)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        waiting = pd.concat([unpacked(p) for (p,) in self.waiting.get()]) if self.waiting.exists() else None
        due = waiting["at"] < now if waiting is not None else None
        if due is not None and due.any():  # else another timer has come before
            self.waiting.clear()
            yield from self._advance(waiting[due], now, waiting[~due])

    def _wait(self, entries: Iterator[pd.DataFrame]) -> None:
        first = None
        for some in entries:
            if len(some):
                self.waiting.appendValue((packed(some),))
                first = min(int(some["at"].min()), first if first is not None else int(some["at"].min()))
        if first is not None:
            self.handle.registerTimer(first + 1)

    def _advance(self, entries: pd.DataFrame, now: int, later: pd.DataFrame | None = None) -> Iterator[pd.DataFrame]:
        """The changes by ``entries`` and the clock; what is ``later`` goes on waiting, with the ends of leases."""
        known, changes, ends = self.jobs.exists(), [], []
        entries = entries.sort_values(["job", "at", "id", "kind"])
        for job, own in groupby(zip(*(entries[c].tolist() for c in ENTRIES.names)), itemgetter(0)):
            was = tuple((known and self.jobs.getValue((job,))) or ("", 0, 0))
            state, new = advance(was, [e[1:] for e in own], now, self.lease_ms, self.attempts)
            changes += [(job, *c) for c in new]
            if state != was:
                self.jobs.updateValue((job,), state)
                if state[0] == "running":
                    ends.append((job, state[2], 0, ""))
        ended = pd.DataFrame(ends, columns=ENTRIES.names)
        self._wait(iter([ended if later is None else pd.concat([later, ended]) if ends else later]))
        if changes:
            yield pd.DataFrame(changes, columns=["job", "at", "attempt", "status"]).astype({"attempt": "int32"})

    def close(self) -> None:
        pass


def lease_changes(log: DataFrame, lease: int, attempts: int, delay: str = "1 hour", event_time: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """``job, at, attempt, status`` of a streamed log; ``lease`` in milliseconds, ``at`` in milliseconds since 1970.

    Each bucket's jobs are one group of state: what of their entries is later than the watermark is held there, so a bucket's memory
    is bounded by its entries in a batch and in ``delay``, and by its running jobs.  ``buckets`` stays as it was when a stream goes on.
    The state store must be RocksDB (``use_state_store``)."""
    placed = F.when(F.col("job").isNotNull() & F.col("at").isNotNull(), F.pmod(F.xxhash64("job"), F.lit(buckets))).otherwise(-1)
    known = {"at_ms": F.coalesce(F.unix_millis("at"), F.lit(0)), "job": F.coalesce("job", F.lit(0)), "id": F.coalesce("id", F.lit(2**63 - 1))}  # whole numbers stay whole in pandas
    timed = log.withWatermark("at", delay).withColumns(known | {"bucket": placed})  # rows without a job count for the watermark
    mode = "eventTime" if event_time else "processingTime"
    return timed.groupBy("bucket").transformWithStateInPandas(Leases(lease, attempts, event_time), CHANGES, "append", mode)


def use_state_store(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATES)
