"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Re-hang neighbours on the smallest one: larger neighbours of each node, or the node with its smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    hung = near.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` for every node of ``u, v`` (long, not null): the smallest node that can be reached.

    Large-star and small-star steps in turn until the edges stay as they are; the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, k = mark, k + 1
        now = staged(_star(_star(now, large=True), large=False), f"{name}-{k}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
