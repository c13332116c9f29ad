"""Stateful streams: suppressing repeated submissions, keeping status timelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.applications import upsert_applications
from ..operators.sequence import status_changes
from ..session import cut_lineage
from ..sinks.tables import BUCKET, BucketTable
from .ingest import run_batches

_ACCEPTED = StructType([StructField("last_us", LongType())])


def accepted_submissions(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, late: str, keep_state: str) -> DataFrame:
    """Submissions at least a gap after the key's last accepted one.

    Equal to the rule on the whole table as long as a key's events arrive in time order between
    micro-batches. Events behind the watermark (``late``) or older than the key's last accepted event
    are dropped: what they would have changed has been written already. A key's state is dropped after
    ``keep_state``, which must cover the gap. Within a micro-batch a key's events are put in time order
    first; the trigger size bounds them. Events without a time are never accepted.
    """
    gap = int(gap_seconds * 1_000_000)
    columns = list(events.columns)
    hold_ms = int(pd.Timedelta(keep_state).total_seconds() * 1000)
    if hold_ms * 1000 < gap:
        raise ValueError("keep_state must not be shorter than the gap")
    events = events.where(F.col(ts).isNotNull())

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames), ignore_index=True).sort_values([ts, tie], kind="stable")
        times = pdf[ts].to_numpy(dtype="datetime64[us]").astype(np.int64)
        last = state.get[0] if state.exists else None
        rows, at = [], 0 if last is None else int(np.searchsorted(times, last + gap, side="left"))
        while at < len(times):
            rows.append(at)
            last = int(times[at])
            at = int(np.searchsorted(times, last + gap, side="left"))
        if last is not None:
            state.update((last,))
            due = max(last // 1000 + hold_ms, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(due)
        yield pdf.iloc[rows][columns]

    return (
        events.withWatermark(ts, late).groupBy(key)
        .applyInPandasWithState(step, events.schema, _ACCEPTED, "append", GroupStateTimeout.EventTimeTimeout)
    )


def upsert_stream(
    accepted: DataFrame, applications: BucketTable, to_events: Callable[[DataFrame], DataFrame],
    ts: str, tie: str, today: Column, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Fold accepted submissions into the applications (bucketed by key), rewriting only the buckets they fall in.

    A micro-batch that runs again finds its submissions in the table and changes nothing but the numbers of applications
    it had not written: every submission counts exactly once, and numbers are unique.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        events = cut_lineage(to_events(batch))  # of a stateful operator, and read more than once
        buckets = applications.touched(events.select("key").distinct(), events.select("key").distinct())
        if not buckets:
            return
        highest = applications.read().select(F.coalesce(F.max("tracker_num"), F.lit(0)).alias("n"))
        before = applications.read(buckets).drop(BUCKET)
        applications.replace(upsert_applications(before, events, ts, tie, today, highest=highest), buckets)

    return run_batches(accepted, step, checkpoint, trigger)


# ── status timeline ──────────────────────────────────────────────────────

_EVENT = "us long, tie long, status string, payload string"


class _Timeline(StatefulProcessor):
    """Per key: events that wait for the watermark, and the status after the last one that was released.

    An event is released when the watermark has passed its time, so that no earlier one can follow; those released
    together are put in order of time and tie, and the ones that change the status are emitted.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _EVENT)
        self.last = handle.getValueState("last", "status string")

    def _wake_at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            events = [
                (int(us), int(tie), None if pd.isna(status) else status, None if pd.isna(payload) else payload)
                for us, tie, status, payload in zip(pdf["us"], pdf["tie"], pdf["status"], pdf["payload"], strict=True)
            ]
            self.pending.appendList(events)
            first = min([e[0] for e in events] + ([] if first is None else [first]))
        if first is not None:
            self._wake_at(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.pending.get()) if self.pending.exists() else []
        ready = sorted((e for e in waiting if e[0] <= passed), key=lambda e: e[:2])
        rest = [e for e in waiting if e[0] > passed]
        if ready:
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        if rest:
            self._wake_at(min(e[0] for e in rest))
        known = self.last.exists()
        status = self.last.get()[0] if known else None
        out = []
        for e in ready:
            if not known or e[2] != status:
                out.append((key[0], *e))
            known, status = True, e[2]
        if ready:
            self.last.update((status,))
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "tie", "status", "payload"])

    def close(self) -> None:
        pass


def _slim(events: DataFrame, key: str, ts: str, tie: str, status: str) -> tuple[Column, list[str]]:
    others = [c for c in events.columns if c not in (key, ts, tie, status)]
    return (F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit(None).cast("string")), others


def _wide(rows: DataFrame, schema: StructType, key: str, ts: str, tie: str, status: str, others: list[str]) -> DataFrame:
    """Events in their own columns again."""
    names = {
        key: F.col("key"), ts: F.timestamp_micros("us").cast(schema[ts].dataType), tie: F.col("tie").cast(schema[tie].dataType), status: F.col("status")
    }
    if others:
        rows = rows.withColumn("payload", F.from_json("payload", StructType([schema[c] for c in others])))
    return rows.select(*[(names[c] if c in names else F.col(f"payload.`{c}`")).alias(c) for c in schema.names])


def status_change_stream(events: DataFrame, key: str, ts: str, tie: str, status: str, late: str) -> DataFrame:
    """Events at which a key's status changes, in order of their time, whatever the order in which they arrive.

    Events wait until the watermark, ``late`` behind the newest event, has passed their time; what arrives within that is
    sorted in. Null is a status like any other; events without a time or a key have no place and are left out. Events
    behind the watermark are dropped, and counted by Spark (``numRowsDroppedByWatermark`` of the query's progress). Run
    it with :func:`rocksdb_state`; :func:`timeline_so_far` adds what still waits.
    """
    payload, others = _slim(events, key, ts, tie, status)
    slim = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).select(
        F.col(ts), F.col(key).alias("key"), F.unix_micros(ts).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(status).alias("status"), payload.alias("payload"),
    )
    kind = events.schema[key].dataType.simpleString()
    out = slim.groupBy("key").transformWithStateInPandas(_Timeline(), f"key {kind}, {_EVENT}", "append", "eventTime")
    return _wide(out, events.schema, key, ts, tie, status, others)


def timeline_so_far(emitted: DataFrame, checkpoint: str, key: str, ts: str, tie: str, status: str) -> DataFrame:
    """The timeline of all events that have arrived: what the stream emitted, and the changes among the events that
    still wait for the watermark, read from the state of the stream's last batch."""
    spark = emitted.sparkSession
    others = [c for c in emitted.columns if c not in (key, ts, tie, status)]

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    waiting = _wide(state("pending").select("key.key", "list_element.*"), emitted.schema, key, ts, tie, status, others)
    last = state("last").select(F.col("key.key").alias(key), F.col("value.status").alias(status))
    return emitted.unionByName(status_changes(waiting, key, ts, tie, status, last))
