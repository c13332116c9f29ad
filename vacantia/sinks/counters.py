"""Counters taken while rows are written, for batch jobs and for streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def value_counts(column: str, values: Sequence[str]) -> list[Column]:
    """A count per stated value, and one of all the others (null among them)."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    each = [F.count(F.when(value == v, 1)).alias(v) for v in values]
    return [*each, F.count(F.when(~value.isin(list(values)), 1)).alias("other")]


def write_counted(rows: DataFrame, path: str, column: str, values: Sequence[str]) -> dict[str, int]:
    """Write rows and return how many have each of the stated values, counted by the job that writes them."""
    seen = Observation("written")
    rows.observe(seen, *value_counts(column, values)).write.mode("errorifexists").parquet(path)
    return seen.get


class BatchCounters(StreamingQueryListener):
    """Adds up the counters that a stream's micro-batches report under a name given to ``observe``.

    What a batch observed is known once it ends; a batch that ends is counted once, by its number.
    """

    def __init__(self, name: str):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for row in self.batches.values():
            for k, v in row.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
