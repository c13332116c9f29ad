"""Writing results: tables by batch and by bucket, appended history, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import field_kind
from ..functions.text import join_present, strip


BATCH, BUCKET = "batch", "bucket"


def with_column(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


class BatchTable:
    """A table that only grows: a folder per micro-batch, replaced as a whole when a batch runs again.

    Readers ask for the batches before their own, so they never see what a failed run of the present batch left.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        # The folder of "no batch yet" is empty: the table can be read before its first batch.
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{self.root}/{BATCH}=-1")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/{BATCH}={batch}")

    def read(self, before: int | None = None, since: int | None = None) -> DataFrame:
        """Rows with the number of their batch; of all batches or of those in ``[since, before)``."""
        rows = self.spark.read.schema(with_column(self.schema, BATCH, T.LongType())).parquet(self.root)
        if before is not None:
            rows = rows.where(F.col(BATCH) < before)
        return rows if since is None else rows.where(F.col(BATCH) >= since)

    def compacted(self, root: str, before: int) -> BatchTable:
        """A new table in which the many small folders of the batches before ``before`` are one; later ones stay apart."""
        out = BatchTable(self.spark, root, self.schema)
        out.write(self.read(before), before - 1)
        for (batch,) in self.read(since=before).select(BATCH).distinct().collect():
            out.write(self.read(batch + 1, batch), batch)
        return out


class BucketTable:
    """A table of one row per key in hash buckets of a column, of which a change rewrites only those it touches.

    Partitions are replaced when a job commits, and only those that get rows. A bucket always holds one row that is
    all null, so that a bucket left without rows is written too; readers don't see these rows. There must be one writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, by: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.root, self.key, self.by, self.buckets = spark, root.rstrip("/"), key, by, buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self._every = [(b,) for b in range(buckets)]

    def bucket_of(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Write the first content of a table that is not there yet; nothing happens to one that is."""
        self._put(rows, self.spark.createDataFrame(self._every, f"{BUCKET} int"), "ignore")

    def read(self, buckets: DataFrame | Sequence[int] | None = None) -> DataFrame:
        """All rows with their bucket, or those of some buckets (only their files are read)."""
        rows = self.spark.read.schema(with_column(self.schema, BUCKET, T.IntegerType())).parquet(self.root)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(list(buckets)))
        return rows.where(F.col(self.key).isNotNull())

    def touched(self, keys: DataFrame, values: DataFrame | None = None) -> list[int]:
        """The buckets that hold any of the keys now, and those of the values; at most as many numbers as buckets."""
        held = self.read().select(F.col(self.key).alias("k"), BUCKET).join(keys.toDF("k"), "k", "left_semi").select(BUCKET)
        if values is not None:
            held = held.unionByName(values.toDF("v").select(self.bucket_of(F.col("v")).alias(BUCKET)))
        return sorted(r[0] for r in held.distinct().collect())

    def replace(self, rows: DataFrame, buckets: Sequence[int]) -> None:
        """Put ``rows`` as the whole content of ``buckets``; the files of the other buckets stay as they are."""
        if buckets:
            self._put(rows, self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int"), "overwrite")

    def _put(self, rows: DataFrame, buckets: DataFrame, mode: str) -> None:
        marks = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], BUCKET)
        whole = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket_of(F.col(self.by))).unionByName(marks)
        # Buckets are put together before writing; one with very many rows is cut by adaptive execution.
        dealt = whole.hint("rebalance", F.col(BUCKET))
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.root)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Whole table as JSON lines in a new folder."""
    df.write.mode("errorifexists").json(path)


def history_rows(listings: DataFrame, day: Column, status: Column) -> DataFrame:
    """Scan-history rows of listings with their outcome."""
    return listings.select(
        "url", day.alias("first_seen"), F.col("source").alias("portal"), "title", "company", status.alias("status"),
        F.coalesce("location", F.lit("")).alias("location"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("first_seen").parquet(path)


def pending_lines(listings: DataFrame) -> DataFrame:
    """Checklist lines ``- [ ] url | company | title``."""
    return listings.select(F.concat(F.lit("- [ ] "), F.concat_ws(" | ", "url", "company", "title")).alias("value"))


def write_scan(rows: DataFrame, meta: DataFrame, path: str) -> None:
    """A raw scan as a table and its one-row meta table next to it."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    meta.write.mode("errorifexists").json(f"{path}/meta")


def tracker_in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("tracker_num")


def write_tracker(rows: DataFrame, path: str) -> None:
    """Tracker lines in order of their number, as text."""
    tracker_in_order(rows).select(F.col("line").alias("value")).write.mode("errorifexists").text(path)


def watchlist_json(companies: DataFrame, searches: list[str]) -> DataFrame:
    """Company-list entries of a watchlist as JSON; big boards carry their own search terms."""
    terms = F.when(F.col("provider") == "workday", F.array(*[F.lit(s) for s in searches]))
    keep_note = F.concat(
        F.lit("watchlist — fit "), F.coalesce(F.col("fit").cast("string"), F.lit("?")), F.lit("/5 ("), "provider",
        F.when(F.coalesce("stale", F.lit(False)), ", no current openings — re-checked over time").otherwise(""), F.lit(")"),
    )
    candidate_note = F.concat(
        F.lit("candidate — "), F.col("openings").cast("string"), F.lit(" relevant, unvetted ("), "provider", F.lit(")")
    )
    note = F.when(F.col("entry") == "keep", keep_note).otherwise(candidate_note)
    entry = F.struct("name", "careers_url", "provider", terms.alias("search"), F.lit(True).alias("enabled"), note.alias("notes"))
    return companies.select("key", F.to_json(entry).alias("value"))


def essay_rows(submissions: DataFrame, day: Column) -> DataFrame:
    """Free-text answers of submitted forms, one row each.

    ``submissions``: key, company, title, fields (array of struct(label, type, value, …)).
    """
    f = submissions.select("key", "company", "title", day.alias("date"), F.explode("fields").alias("f"))
    kind = field_kind(F.col("f.label"), F.col("f.type"), F.lit(None).cast("int"))["kind"]
    given = strip(F.coalesce("f.value", F.lit(""))) != ""
    return f.where((kind == "free_text") & given).select(
        "key", "company", "title", F.col("f.label").alias("question"), F.col("f.value").alias("answer"), "date"
    )


def body_file(company: Column, title: Column, url: Column, text: Column) -> Column:
    """Text body of a listing with its two heading lines."""
    return F.concat(F.lit("# "), join_present(" — ", company, title), F.lit("\n"), url, F.lit("\n\n"), text, F.lit("\n"))


def snapshots(submissions: DataFrame) -> DataFrame:
    """Submitted page texts per key, as rows of a table."""
    return submissions.where("coalesce(snapshot, '') <> ''").select("key", "submitted_at", "snapshot")
