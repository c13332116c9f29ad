"""Streams of scan snapshots: incremental ingest, registry refresh, open counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.status import is_open
from ..operators.dedup import scan_outcomes
from ..operators.registry import refresh_listings
from ..session import cut_lineage
from ..sinks.tables import BATCH, BUCKET, BatchTable, BucketTable, with_column


def scan_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_trigger: int | None = None, **options) -> DataFrame:
    """New snapshot files of a folder as a stream; the trigger size bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).load(path)


def passing(listings: DataFrame, title_ok: Column, location_ok: Column) -> DataFrame:
    """The stateless part of the ingest: keyword and location rules."""
    return listings.where(F.coalesce(title_ok, F.lit(False)) & F.coalesce(location_ok, F.lit(False)))


def run_batches(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a stream of micro-batches. ``trigger`` as in ``writeStream.trigger``; by default all that is there, then stop."""
    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest(
    listings: DataFrame, history: BatchTable, roles: DataFrame, title_ok: Column, location_ok: Column,
    url: str, company: str, role: str, order: str, checkpoint: str, pending: BatchTable | None = None, trigger: dict | None = None,
    keep_batches: int | None = None,
) -> StreamingQuery:
    """Tag every new listing with its outcome and add it to the history; what was added is also pending work.

    A listing that was added takes its URL and its (company, role), for its own batch and for all that follow, so the
    result doesn't depend on how listings are dealt out to files as long as files come in ``order``. Other outcomes take
    nothing. A batch looks only at the history of the batches before it and writes its own folder, so a batch that is
    run again after a failure replaces itself with the same rows. Of the history only the keys that the batch brings are
    looked at, and with ``keep_batches`` only those of so many last batches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        since = None if keep_batches is None else batch_id - keep_batches
        taken = history.read(batch_id, since).where("outcome = 'added'")
        urls = taken.select(F.col(url).alias("url")).where("url IS NOT NULL")
        seen = urls.join(batch.select(F.col(url).alias("url")).distinct(), "url", "left_semi").distinct()
        pair = [F.lower(F.col(company)).alias("company_lc"), F.lower(F.col(role)).alias("role_lc")]
        asked = batch.select(*pair).distinct()
        known = roles.select("company_lc", "role_lc").unionByName(taken.select(*pair))
        known = known.join(asked, ["company_lc", "role_lc"], "left_semi").distinct()
        history.write(scan_outcomes(batch, title_ok, location_ok, seen, known, url, company, role, order), batch_id)
        if pending is not None:
            pending.write(history.read(batch_id + 1, batch_id).where("outcome = 'added'").select(url, company, role), batch_id)

    return run_batches(listings, step, checkpoint, trigger)


def outcome_schema(listings: DataFrame) -> StructType:
    """Columns of the history that :func:`ingest` writes."""
    return with_column(StructType(listings.schema.fields), "outcome", StringType())


def refresh_stream(
    scans: DataFrame, scan: str, meta: DataFrame, arrived: str, registry: BucketTable,
    to_listings: Callable[[DataFrame], DataFrame], scan_date: Column, checkpoint: str,
    scanned_groups: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Merge scans into the registry, each as soon as all of it is there, rewriting only the buckets it touches.

    A scan may be many files in many micro-batches, and a micro-batch may hold parts of several scans.
    ``scan`` names the column with the scan's id; ``meta`` (scan, n_rows) is what each scan's own record
    states. Rows wait in the folder ``arrived``, by scan and batch, until their scan is complete, so nothing expires
    because a file is still missing. A batch only looks at the scans it brings rows of; their ids are few and go through
    the driver. Which scans are merged is recorded one by one: a batch that runs again goes on after the last one, and
    merging the same scan twice changes nothing. Rows without a scan's id belong to no scan and stay where they are.
    """
    spark = scans.sparkSession
    rows_schema = StructType(scans.schema.fields)
    waiting_schema = with_column(with_column(StructType([f for f in rows_schema if f.name != scan]), scan, StringType()), BATCH, LongType())
    merged = BatchTable(spark, f"{arrived.rstrip('/')}-merged", StructType([StructField("scan", StringType())]))

    def waiting() -> DataFrame:
        return spark.read.schema(waiting_schema).parquet(arrived)

    def step(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn(BATCH, F.lit(batch_id).cast("long"))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scan, BATCH).parquet(arrived)
        present = waiting().where(F.col(BATCH) == batch_id).select(scan).where(F.col(scan).isNotNull())
        ids = [r[0] for r in present.distinct().collect()]
        if not ids:
            return
        have = waiting().where(F.col(scan).isin(ids) & (F.col(BATCH) <= batch_id)).groupBy(scan).agg(
            F.count(F.lit(1)).alias("now"), F.count(F.when(F.col(BATCH) < batch_id, 1)).alias("before")
        )
        full = have.join(meta.select(F.col("scan").alias(scan), "n_rows"), scan).where("now >= n_rows AND before < n_rows")
        done = [r[0] for r in merged.read(batch_id + 1, batch_id).collect()]
        for k in sorted(r[0] for r in full.select(scan).collect()):
            if k in done:
                continue
            rows = waiting().where((F.col(scan) == k) & (F.col(BATCH) <= batch_id)).drop(scan, BATCH)
            merge_scan(registry, to_listings(rows), scan_date, scanned_groups(rows) if scanned_groups else None)
            done.append(k)
            merged.write(spark.createDataFrame([(x,) for x in done], "scan string"), batch_id)

    return run_batches(scans, step, checkpoint, trigger)


def merge_scan(registry: BucketTable, listings: DataFrame, scan_date: Column, scanned_groups: DataFrame | None = None) -> list[int]:
    """Merge one scan into the registry; the buckets that were rewritten.

    These are the buckets of the scanned groups and those in which listings of the scan are now, for a listing that moves
    to another group.
    """
    listings = cut_lineage(listings)  # read once to find the buckets and once to merge
    groups = listings.select("company_key").distinct()
    if scanned_groups is not None:
        groups = groups.unionByName(scanned_groups.toDF("company_key"))
    buckets = registry.touched(listings.select("key"), groups)
    prior = registry.read(buckets).drop(BUCKET)
    registry.replace(refresh_listings(listings, prior, scan_date, scanned_groups), buckets)
    return buckets


# ── open applications per company ────────────────────────────────────────


class _OpenChanges(StatefulProcessor):
    """Per application: its company, whether it is open and its position; emits +1 and -1 when that changes."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "group string, open boolean, us long, tie long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        best = known
        for pdf in rows:
            newest = pdf.sort_values(["us", "tie"], kind="stable").iloc[-1]
            if best is None or (newest.us, newest.tie) >= (best[2], best[3]):
                best = (None if pd.isna(newest.group) else newest.group, bool(newest.open), int(newest.us), int(newest.tie))
        if best is None or best == known:
            return
        self.last.update(best)
        before = known[0] if known is not None and known[1] else None
        after = best[0] if best[1] else None
        moves = [(g, d) for g, d in ((before, -1), (after, 1)) if g is not None] if before != after else []
        # A change that leaves the count as it is still touches its company.
        if not moves and best[0] is not None:
            moves = [(best[0], 0)]
        if moves:
            yield pd.DataFrame(moves, columns=["group", "delta"])

    def close(self) -> None:
        pass


class _OpenCounts(StatefulProcessor):
    """Per company: the number of open applications; emits it with its version whenever it is touched."""

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, version = self.count.get() if self.count.exists() else (0, 0)
        n += sum(int(pdf["delta"].sum()) for pdf in rows)
        self.count.update((n, version + 1))
        yield pd.DataFrame([(key[0], n, version + 1)], columns=["group", "open_count", "version"])

    def close(self) -> None:
        pass


def open_count_changes(changes: DataFrame, key: str, group: str, ts: str, tie: str) -> DataFrame:
    """Stream of status changes → the open count of every company a micro-batch touches (group, open_count, version).

    A closed application frees its slot and a moved one changes companies, so the state holds the last status of each
    application and the count of each company: a batch costs what it brings, whatever the age of the stream. Events may
    come in any order; of an application the one latest in (``ts``, ``tie``) counts, one without a time before all others.
    Events without an application are left out, and applications without a company count nowhere. The state store has
    to be RocksDB (:func:`rocksdb_state`).
    """
    events = changes.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.nullif(F.col(group).cast("string"), F.lit("")).alias("group"), is_open(F.col("status")).alias("open"),
        F.coalesce(F.unix_micros(F.col(ts)), F.lit(-(2**62))).alias("us"), F.col(tie).cast("long").alias("tie"),
    )
    moved = events.groupBy("key").transformWithStateInPandas(_OpenChanges(), "group string, delta long", "append", "none")
    return moved.groupBy("group").transformWithStateInPandas(_OpenCounts(), "group string, open_count long, version long", "append", "none").select(
        F.col("group").alias(group), "open_count", "version"
    )


def latest_counts(changes: DataFrame, group: str) -> DataFrame:
    """The open counts of all companies that have any, from the rows of :func:`open_count_changes`."""
    last = changes.groupBy(group).agg(F.max_by("open_count", "version").alias("open_count"))
    return last.where("open_count > 0")


def open_counts(spark: SparkSession, checkpoint: str, group: str) -> DataFrame:
    """The same from the state of the last batch of :func:`open_count_changes`."""
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "count").load(checkpoint)
    return state.where("value.n > 0").select(F.col("key.group").alias(group), F.col("value.n").alias("open_count"))
