"""Streams over the event table, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keywords import title_passes
from ..session import shared_dir
from ..sinks.tables import BatchTable, BucketTable
from ..streaming.ingest import ingest, latest_counts, open_count_changes, open_counts, outcome_schema, refresh_stream, scan_stream
from ..streaming.state import rocksdb_state
from ..streaming.submissions import accepted_submissions, status_change_stream, timeline_so_far, upsert_stream
from .history import REFRESH_SQL, registry_inputs_of
from .registry import query, table
from .standins import STATUS_SQL, event_status, facets, facets_of


def _stream_of(spark, sf, name):
    """A table as a stream of its files, whether it is one file or a folder of them.

    Reading the schema fails when there is no such table. The last letter as a pattern makes Spark
    resolve the path, which may then be a file.
    """
    schema = table(spark, sf, name).schema
    return scan_stream(spark, f"{sf}/{name}.parque[t]", schema, "parquet", 1)


def _event_stream(spark, sf):
    return _stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(rows, spark, purpose):
    """Run a stream into a table in the shared folder and read it back; also its checkpoint."""
    root = shared_dir(spark, purpose)
    with rocksdb_state(spark):
        started = (
            rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
        started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out"), f"{root}/checkpoint"


@query(
    "stream_ingest",
    """WITH e AS (SELECT event_id, NOT contains(event_type, 'error') AS ok,
 CASE WHEN event_id % 5 <> 0 THEN 'u' || (event_id // 2) ELSE 'U' || (user_id % 20) || ' ' || event_type END AS taken FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY taken, ok ORDER BY event_id) AS copy FROM e)
SELECT event_id, CASE WHEN NOT ok THEN 'skipped_title' WHEN copy > 1 THEN 'skipped_dup' ELSE 'added' END AS outcome FROM r""",
)
def stream_ingest(spark, sf):
    """Events as listings: four of five share a URL with their neighbour and have a role of their own, the fifth has
    no URL and a role that comes back all the time."""
    root = shared_dir(spark, "ingest")
    fifth = F.col("event_id") % 5 == 0
    number = F.col("event_id").cast("string")
    events = _event_stream(spark, sf).select(
        "event_id", F.when(~fifth, F.concat(F.lit("u"), F.floor(F.col("event_id") / 2).cast("string"))).alias("url"),
        F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("company"),
        F.when(fifth, F.col("event_type")).otherwise(F.concat_ws(" ", "event_type", number)).alias("role"),
    )
    history = BatchTable(spark, f"{root}/history", outcome_schema(events))
    pending = BatchTable(spark, f"{root}/pending", events.select("url", "company", "role").schema)
    roles = spark.createDataFrame([], "company_lc string, role_lc string")
    ingest(
        events, history, roles, title_passes(F.col("role"), [], ["error"]), F.lit(True), "url", "company", "role", "event_id", f"{root}/checkpoint", pending
    ).awaitTermination()
    return history.read().select("event_id", "outcome")


@query(
    "stream_submissions",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
nxt AS (SELECT a.user_id, a.event_id, a.rn, a.t, min(b.rn) AS next_rn FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t >= a.t + 14400000000 GROUP BY ALL),
walk AS (SELECT user_id, event_id, next_rn FROM nxt WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.next_rn FROM walk w JOIN nxt n ON n.user_id = w.user_id AND n.rn = w.next_rn)
SELECT event_id FROM walk""",
)
def stream_submissions(spark, sf):
    events = _event_stream(spark, sf).select("event_id", "user_id", "ts")
    return _run(accepted_submissions(events, "user_id", "ts", "event_id", 4 * 3600, "1 hour", "4 hours"), spark, "submissions")[0].select("event_id")


@query(
    "stream_submission_upsert",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
nxt AS (SELECT a.user_id, a.event_id, a.rn, a.ts, a.t, min(b.rn) AS next_rn FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t >= a.t + 14400000000 GROUP BY ALL),
walk AS (SELECT user_id, event_id, ts, next_rn FROM nxt WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.ts, n.next_rn FROM walk w JOIN nxt n ON n.user_id = w.user_id AND n.rn = w.next_rn),
f AS (SELECT 'u' || user_id AS key, min(ts) AS first_ts, arg_max(event_id, (ts, event_id)) AS last_event FROM walk GROUP BY 1)
SELECT key, CAST(row_number() OVER (ORDER BY first_ts, key) AS INT) AS tracker_num, 'Applied' AS status, 'event ' || last_event AS title, CAST(first_ts AS DATE) AS date_applied FROM f""",
)
def stream_submission_upsert(spark, sf):
    """Accepted submissions become applications, each counted once."""
    root = shared_dir(spark, "submission-upsert")
    events = _event_stream(spark, sf).select("event_id", "user_id", "ts")
    accepted = accepted_submissions(events, "user_id", "ts", "event_id", 4 * 3600, "1 hour", "4 hours")
    none = spark.createDataFrame([], "key string, tracker_num int, title string, status string, date_applied date, recruiter struct<name:string,email:string,phone:string,notes:string>, last_updated date")
    applications = BucketTable(spark, f"{root}/applications", "key", "key", none.schema, 8)
    applications.create(none)
    null = F.lit(None).cast("string")

    def to_events(rows):
        return rows.select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "event_id", "ts", F.lit("Applied").alias("status"), F.lit(None).cast("date").alias("date"),
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), null.alias("note"),
            F.struct(null.alias("name"), null.alias("email"), null.alias("phone"), null.alias("notes")).alias("recruiter"),
        )

    upsert_stream(accepted, applications, to_events, "ts", "event_id", F.lit("2024-02-01").cast("date"), f"{root}/checkpoint").awaitTermination()
    return applications.read().select("key", "tracker_num", "status", "title", "date_applied")


@query(
    "stream_timeline",
    f"SELECT event_id, status FROM (SELECT event_id, {STATUS_SQL} AS status, lag({STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM status",
)
def stream_timeline(spark, sf):
    events = _event_stream(spark, sf).select("event_id", "user_id", "ts", event_status().alias("status"))
    names = ("user_id", "ts", "event_id", "status")
    emitted, checkpoint = _run(status_change_stream(events, *names, "1 hour"), spark, "timeline")
    return timeline_so_far(emitted, checkpoint, *names).select("event_id", "status")


def _open_counts(spark, sf):
    events = _event_stream(spark, sf).select(
        "user_id", F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("company_key"), event_status().alias("status"), "ts", "event_id"
    )
    return _run(open_count_changes(events, "user_id", "company_key", "ts", "event_id"), spark, "open-counts")


@query(
    "stream_open_counts",
    f"SELECT company_key, count(*) AS open_count FROM (SELECT user_id, 'g' || (user_id % 7) AS company_key, arg_max({STATUS_SQL}, (ts, event_id)) AS status FROM events GROUP BY 1, 2) WHERE status <> 'Rejected' GROUP BY 1",
)
def stream_open_counts(spark, sf):
    """The counts as the stream's state has them."""
    return open_counts(spark, _open_counts(spark, sf)[1], "company_key")


@query(
    "stream_open_counts_touched",
    f"SELECT company_key, count(*) AS open_count FROM (SELECT user_id, 'g' || (user_id % 7) AS company_key, arg_max({STATUS_SQL}, (ts, event_id)) AS status FROM events GROUP BY 1, 2) WHERE status <> 'Rejected' GROUP BY 1",
)
def stream_open_counts_touched(spark, sf):
    """The counts from the changes that the stream emitted."""
    return latest_counts(_open_counts(spark, sf)[0], "company_key")


@query("stream_registry_refresh", REFRESH_SQL)
def stream_registry_refresh(spark, sf):
    """A scan that arrives in any number of files is merged into the registry once it is complete."""
    root = shared_dir(spark, "registry")
    scans = _stream_of(spark, sf, "part").withColumn("scan", F.lit("1998-06-01"))
    meta = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("1998-06-01").alias("scan"), "n_rows")
    prior = registry_inputs_of(facets(spark, sf))[0]
    registry = BucketTable(spark, f"{root}/registry", "key", "company_key", prior.schema, 16)
    registry.create(prior)
    refresh_stream(
        scans, "scan", meta, f"{root}/arrived", registry, lambda rows: registry_inputs_of(facets_of(rows))[1],
        F.lit("1998-06-01").cast("date"), f"{root}/checkpoint",
    ).awaitTermination()
    return registry.read().select(
        "key", "company_key", "title", "apply_url", "date_posted", F.col("comp.min").alias("pay"), "has_body", "live", "first_seen", "last_seen"
    )
