"""Ordered rules over event streams kept as tables: changes, gaps, reposts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import lookup, micros, time_chunk, with_previous

DAY = 86_400


def status_changes(
    events: DataFrame, key: str, ts: str, tie: str, status: str, prior: DataFrame | None = None, chunk_seconds: int = DAY
) -> DataFrame:
    """Timeline as rows: the events at which a key's status differs from the one before.

    ``prior`` (key, status) holds the status before the first event of known keys; a key it does
    not hold is new, and its first event always counts.
    """
    tagged = with_previous(
        events, [key], [ts, tie], {"__before": F.col(status), "__row": F.lit(1)}, time_chunk(F.col(ts), chunk_seconds)
    )
    if prior is not None:
        start = prior.select(F.col(key), F.col(status).alias("__start"), F.lit(1).alias("__known"))
        tagged = lookup(tagged, start, key)
        first = F.col("__row").isNull()
        changed = F.when(first & F.col("__known").isNotNull(), ~F.col("__start").eqNullSafe(F.col(status)))
        changed = changed.when(first, True).otherwise(~F.col("__before").eqNullSafe(F.col(status)))
    else:
        changed = F.col("__row").isNull() | ~F.col("__before").eqNullSafe(F.col(status))
    return tagged.where(changed).select(*events.columns)


def far_from_previous(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: float, chunk_seconds: int = DAY
) -> DataFrame:
    """Events at least ``gap_seconds`` after the key's previous event."""
    tagged = with_previous(events, keys, [ts, tie], {"__ts": F.col(ts)}, time_chunk(F.col(ts), chunk_seconds))
    gap = micros(F.col(ts)) - micros(F.col("__ts"))
    return tagged.where(F.col("__ts").isNull() | (gap >= int(gap_seconds * 1_000_000))).drop("__ts")


def map_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType,
) -> DataFrame:
    """Apply ``fn`` to ordered groups, all complete groups of an Arrow batch in one call.

    Rows are partitioned and sorted by Spark; ``fn`` gets a frame of whole groups and the offsets at
    which they start and end. A task keeps only the group that is still open, so a group must fit into
    memory but a partition need not.
    """
    keys = list(keys)

    def differs(a: pd.Series, b: pd.Series) -> np.ndarray:
        return ((a.to_numpy() != b.to_numpy()) & ~(a.isna().to_numpy() & b.isna().to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            changed = np.zeros(len(batch), dtype=bool)
            for k in keys:
                changed[1:] |= differs(batch[k].iloc[1:], batch[k].iloc[:-1])
                if pending:
                    changed[0] |= bool(differs(batch[k].iloc[:1], pending[-1][k].iloc[-1:])[0])
            cuts = np.flatnonzero(changed)
            if not len(cuts):
                pending.append(batch)
                continue
            pending.append(batch.iloc[: cuts[-1]])
            whole = pd.concat(pending, ignore_index=True)
            carried = len(whole) - int(cuts[-1])
            offsets = np.unique(np.concatenate([[0], cuts + carried]))
            if len(whole):
                yield fn(whole, offsets)
            pending = [batch.iloc[cuts[-1]:]]
        if pending:
            whole = pd.concat(pending, ignore_index=True)
            yield fn(whole, np.asarray([0, len(whole)]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _accepted(times: np.ndarray, start: int, gap: int) -> np.ndarray:
    """Positions accepted when ``start`` is the first one: each next one is a gap later."""
    out = []
    while start < len(times):
        out.append(start)
        start = int(np.searchsorted(times, times[start] + gap, side="left"))
    return np.asarray(out, dtype=np.int64)


def _exits(times: np.ndarray, chunk_start: int, gap: int) -> tuple[list[int], list[int]]:
    """For a chunk's sorted times: first accepted time → last accepted time, for every possible start.

    Possible starts are the events a last accepted time before the chunk can still push away, and the
    first event after them. Neighbouring starts with the same outcome are one entry (the latest).
    """
    edge = int(np.searchsorted(times, chunk_start + gap, side="left"))
    starts = np.unique(np.searchsorted(times, np.append(times[:edge], chunk_start + gap)))
    starts = starts[starts < len(times)]
    following = np.searchsorted(times, times + gap, side="left")
    at = starts.copy()
    while True:
        nxt = following[at]
        moving = nxt < len(times)
        if not moving.any():
            break
        at = np.where(moving, nxt, at)
    keep = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, dtype=bool)
    return times[starts][keep].tolist(), times[at][keep].tolist()


def far_from_accepted(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: float, chunk_seconds: int = DAY
) -> DataFrame:
    """Events at least ``gap_seconds`` after the key's last *accepted* event.

    A key is cut into time chunks. Where the acceptance starts in a chunk depends on the last
    accepted time before it, and only events in the chunk's first ``gap_seconds`` can differ. So
    each chunk first reports, for each possible start, the last time it would accept; a fold over
    one small row per chunk then fixes the start of every chunk, and the chunks are marked in
    parallel. Events with a null key are a key of their own; events without a time are never accepted.
    """
    if chunk_seconds < gap_seconds:
        raise ValueError("chunk_seconds must not be shorter than the gap")
    gap, span = int(gap_seconds * 1_000_000), int(chunk_seconds * 1_000_000)
    keys = list(keys)
    base = events.where(F.col(ts).isNotNull()).withColumns({"__us": micros(F.col(ts)), "__chunk": time_chunk(F.col(ts), chunk_seconds)})
    key_fields = [events.schema[k] for k in keys]
    chunk_field = T.StructField("__chunk", T.LongType())

    def exits(pdf: pd.DataFrame, offsets: np.ndarray) -> pd.DataFrame:
        at, chunk = pdf["__us"].to_numpy(dtype=np.int64), pdf["__chunk"].to_numpy(dtype=np.int64)
        found = [_exits(at[i:j], int(chunk[i]) * span, gap) for i, j in zip(offsets[:-1], offsets[1:])]
        out = pdf[[*keys, "__chunk"]].iloc[offsets[:-1]].copy()
        out["firsts"], out["lasts"] = [f for f, _ in found], [x for _, x in found]
        return out

    times = T.ArrayType(T.LongType())
    exit_schema = T.StructType([*key_fields, chunk_field, T.StructField("firsts", times), T.StructField("lasts", times)])
    chunks = map_groups(base.select(*keys, "__chunk", "__us"), [*keys, "__chunk"], ["__us"], exits, exit_schema)

    def fold(pdf: pd.DataFrame, offsets: np.ndarray) -> pd.DataFrame:
        starts, entry, last = set(offsets.tolist()), [], None
        for row, (firsts, lasts) in enumerate(zip(pdf["firsts"], pdf["lasts"])):
            last = None if row in starts else last
            entry.append(last)
            floor = -(2**62) if last is None else last + gap
            # The entry whose range of starts holds the first event at or after the floor.
            i = int(np.searchsorted(np.asarray(firsts, dtype=np.int64), floor, side="left"))
            if i < len(lasts):
                last = int(lasts[i])
        out = pdf[[*keys, "__chunk"]].copy()
        out["__entry"] = pd.array(entry, dtype="Int64")
        return out

    fold_schema = T.StructType([*key_fields, chunk_field, T.StructField("__entry", T.LongType())])
    entries = map_groups(chunks, keys, ["__chunk"], fold, fold_schema)
    columns = list(events.columns)

    def mark(pdf: pd.DataFrame, offsets: np.ndarray) -> pd.DataFrame:
        at, entry = pdf["__us"].to_numpy(dtype=np.int64), pdf["__entry"].astype("Int64")
        unknown, before, rows = entry.isna().to_numpy(), entry.fillna(0).to_numpy(dtype=np.int64), []
        for i, j in zip(offsets[:-1], offsets[1:]):
            start = 0 if unknown[i] else int(np.searchsorted(at[i:j], before[i] + gap, side="left"))
            rows.append(i + _accepted(at[i:j], start, gap))
        return pdf.iloc[np.concatenate(rows)][columns]

    names = {k: f"__e{i}" for i, k in enumerate([*keys, "__chunk"])}
    entries = entries.select(*[F.col(k).alias(c) for k, c in names.items()], "__entry")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in names.items()])
    joined = base.join(entries, same).drop(*names.values())
    return map_groups(joined, [*keys, "__chunk"], ["__us", tie], mark, T.StructType(list(events.schema.fields)))


def repost_signal(listings: DataFrame, keys: Sequence[str], day: Column, days: int = 90, times: int = 2) -> DataFrame:
    """Per key and day: listings of the same key in the last ``days`` days, and is that a repost?

    Rows are counted per day before the window, so a group has at most one row per day.
    """
    per_day = listings.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("on_day"))
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    recent = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, 0)
    counted = per_day.withColumn("in_window", F.sum("on_day").over(recent))
    return counted.withColumn("reposted", F.col("in_window") >= times)
