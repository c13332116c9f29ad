"""Joins and ordered operations that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def lookup(facts: DataFrame, table: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join of many rows with a table that has one row per key.

    The rows' key may be badly skewed. Spark's adaptive execution splits the oversized partitions of a
    join, but only where both sides come straight from a shuffle made for that join, which a table
    that was just aggregated by the key does not. A hash of the key as an additional join key gives the
    (small) table such a shuffle of its own; the rows are shuffled once, as in any join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    values = [c for c in table.columns if c not in keys]
    right = table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *values, F.xxhash64(*keys).alias("__kh"))
    left = facts.withColumn("__fh", F.xxhash64(*keys))
    condition = F.col("__fh") == F.col("__kh")
    for i, k in enumerate(keys):
        condition = condition & (F.col(k) == F.col(f"__k{i}"))
    return left.join(right, condition, "left").drop("__fh", "__kh", *[f"__k{i}" for i in range(len(keys))])


def exclude(facts: DataFrame, keys_table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose key does not occur in the table (``on``: row column → table column).

    The same additional join key as in :func:`lookup` lets hot keys of the rows be split.
    """
    known = keys_table.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(on.values())], F.xxhash64(*on.values()).alias("__kh")
    )
    condition = F.xxhash64(*on) == F.col("__kh")
    for i, c in enumerate(on):
        condition = condition & (F.col(c) == F.col(f"__k{i}"))
    return facts.join(known, condition, "left_anti")


def in_group(facts: DataFrame, keys_table: DataFrame, on: str | Sequence[str], flag: str) -> DataFrame:
    """Add a boolean: does the row's key occur in the table?"""
    keys = [on] if isinstance(on, str) else list(on)
    marked = keys_table.select(*keys).distinct().withColumn(flag, F.lit(True))
    return lookup(facts, marked, keys).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, for timestamps with and without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def time_chunk(ts: Column, seconds: int) -> Column:
    """Number of the fixed time span a timestamp falls into."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], chunk: Column
) -> DataFrame:
    """``lag`` by key in the given order, computed per chunk of the key.

    ``chunk`` must not decrease along the order (a time span of the first order column). A key is
    split at the chunk borders, so a key with a third of all rows becomes many small groups; the
    last value of each chunk is carried over by a table with one row per key and chunk. Rows with a
    null key are a key of their own, rows without a chunk its first one.
    """
    picked = F.struct(*[c.alias(n) for n, c in values.items()])
    base = df.withColumns({"__chunk": chunk, "__cur": picked})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    rows = base.withColumns({"__lag": F.lag("__cur").over(inside), "__first": F.row_number().over(inside) == 1})
    last = base.groupBy(*keys, "__chunk").agg(F.max_by("__cur", F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__chunk")
    names = {k: f"__c{i}" for i, k in enumerate([*keys, "__chunk"])}
    carried = last.select(*[F.col(k).alias(c) for k, c in names.items()], F.lag("__last").over(across).alias("__carried"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in names.items()])
    joined = rows.join(carried, same, "left")
    previous = F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__lag"))
    return joined.select(*df.columns, *[previous[n].alias(n) for n in values])


def number_rows(df: DataFrame, order: Sequence[str], chunk: Column, out: str, start: int | Column = 1) -> DataFrame:
    """Consecutive numbers in the given order without gathering all rows in one task.

    Rows are numbered inside each chunk; an offset table with one row per chunk is added. ``chunk`` must
    not decrease along the order; rows without one (a null first order column) are a chunk of their own
    and come first, as nulls do in the order.
    """
    base = df.withColumn("__chunk", chunk)
    inside = Window.partitionBy("__chunk").orderBy(*order)
    sizes = base.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__chunk").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    numbered = base.withColumn("__rn", F.row_number().over(inside)).join(offsets, F.col("__chunk").eqNullSafe(F.col("__of")))
    return numbered.select(*df.columns, (F.col("__offset") + F.col("__rn") - 1 + first).alias(out))


def number_in_order(df: DataFrame, order: Sequence[str], out: str, start: int | Column = 1) -> DataFrame:
    """Consecutive numbers in the given order where any time span may hold all the rows.

    The chunks are ranges of the whole order with sampled borders, fixed by a checkpoint, so that rows of
    one moment are still several tasks' work.
    """
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    return number_rows(ranges, order, F.col("__range"), out, start).drop("__range")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key. Spark cuts each map task's groups to one row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank; groups are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
