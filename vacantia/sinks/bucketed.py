"""A registry kept as bucketed tables, so that joins on its key do not move it.

Listings are written in buckets of their key, sorted by it, with the canonical URL and the listing id that lookups need;
a narrow second table holds (listing_id, key) in buckets of the id. Whatever is joined with the registry is dealt to its
buckets; the registry is read where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import with_url_keys
from ..operators.registry import merge_snapshot

FEW_GROUPS = 100_000  # at most so many scanned groups are sent to every task


class BucketedRegistry:
    """Two tables of the session's catalog in one folder. A new content is written under a new name."""

    def __init__(self, spark: SparkSession, name: str, root: str, key: str = "key", buckets: int = 64):
        self.spark, self.name, self.root, self.key, self.buckets = spark, name, root.rstrip("/"), key, buckets

    def _save(self, rows: DataFrame, name: str, by: str) -> None:
        # Dealt by the bucketed column first: a file per bucket and not one per task and bucket.
        dealt = rows.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by)
        dealt.mode("errorifexists").option("path", f"{self.root}/{name}").saveAsTable(name)

    def write(self, listings: DataFrame, url_keys: bool = True) -> BucketedRegistry:
        """Write listings (one row per key). With ``url_keys``, the key is a URL whose forms are stored with it."""
        if url_keys:
            listings = with_url_keys(listings, {"canonical": F.col(self.key)}, {"listing_id": F.col(self.key)})
        self._save(listings, self.name, self.key)
        if url_keys:
            ids = self.read().where("listing_id <> ''").select("listing_id", self.key)
            self._save(ids, f"{self.name}_ids", "listing_id")
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def ids(self) -> DataFrame:
        return self.spark.table(f"{self.name}_ids")

    def with_lifecycle(self, by_url: DataFrame, by_id: DataFrame) -> DataFrame:
        """As ``with_lifecycle`` of the matching operators, for the whole registry.

        What applies by id is first named by key, over the narrow table; then one join on the key brings both.
        """
        named = self.ids().join(by_id, F.col("listing_id") == F.col("id")).select(F.col(self.key).alias("__k"), F.col("by_id").alias("__value"), F.lit(1).alias("__rank"))
        direct = by_url.select(F.col("url").alias("__k"), F.col("by_url").alias("__value"), F.lit(0).alias("__rank"))
        best = direct.unionByName(named).groupBy("__k").agg(F.min_by("__value", "__rank").alias("__value"))
        rows = self.read()
        found = rows.join(best, F.col(self.key) == F.col("__k"), "left")
        value = F.col("__value")
        return found.select(*[rows[c] for c in rows.columns], value["status"].alias("status"), value["report"].alias("report"), value.isNotNull().alias("tracked"))

    def merged(self, scan: DataFrame, group: str, policy: dict[str, int], scanned_groups: DataFrame | None = None, scan_date: Column | None = None) -> DataFrame:
        """As ``merge_snapshot`` with the registry as it is kept. The scanned groups are counted; few are sent to all tasks."""
        return merge_snapshot(self.read(), scan, self.key, group, policy, scanned_groups, scan_date, few_groups=FEW_GROUPS)
