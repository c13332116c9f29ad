"""Files in, files out, and streams fed with several files."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.keywords import title_passes
from vacantia.functions.status import OPEN
from vacantia.operators.registry import scan_to_listings
from vacantia.operators.sequence import status_changes
from vacantia.sinks.counters import BatchCounters, value_counts, write_counted
from vacantia.sinks.tables import BatchTable, BucketTable, append_history, history_rows, write_jsonl, write_scan, write_tracker
from vacantia.sources import documents, landed
from vacantia.streaming.ingest import ingest, latest_counts, merge_scan, open_count_changes, open_counts, outcome_schema, refresh_stream, scan_stream
from vacantia.streaming.state import rocksdb_state
from vacantia.streaming.submissions import accepted_submissions, status_change_stream, timeline_so_far


def test_text_sources(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"url":"u1","title":"A"}\n\n{"url":"u2","ti\n{"title":"no url"}\n{"_meta":{"scanned_at":"2024-01-01","companies":["X"],"partial":true}}\n')
    good, bad = landed.read_jsonl(spark, str(tmp_path / "rows.jsonl"), landed.RAW_SCAN)
    assert good.count() == 3 and bad.count() == 1
    rows, meta = landed.read_scan(spark, str(tmp_path / "rows.jsonl"))
    assert [r.url for r in rows.collect()] == ["u1"] and meta.first().companies == ["X"]
    (tmp_path / "history.tsv").write_text("url\tfirst_seen\tportal\ttitle\tcompany\tstatus\tlocation\nu1\t2024-01-01\tp\tt\tc\tadded\tBerlin\nu2\t2024-01-01\tp\tt\tc\tadded\n")
    assert [(r.url, r.location) for r in landed.read_history(spark, str(tmp_path / "history.tsv")).collect()] == [("u1", "Berlin"), ("u2", None)]
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "lever.csv").write_text('name,slug,url\n"Acme, Inc",acme,https://jobs.lever.co/acme\nbroken\n')
    assert [tuple(r) for r in landed.read_company_csvs(spark, str(folder)).collect()] == [("lever", "Acme, Inc", "acme", "https://jobs.lever.co/acme")]
    (tmp_path / "cache.json").write_text(json.dumps({"fetched_at": "x", "jobs": [{"title": "A", "url": "u", "company": None}, {"title": "", "url": "v"}]}, indent=1))
    assert [(r.title, r.company) for r in landed.read_json_jobs(spark, str(tmp_path / "cache.json")).collect()] == [("A", "")]
    (tmp_path / "state.tsv").write_text("id\turl\tstatus\tstarted_at\tcompleted_at\treport_num\tscore\terror\tretries\n1\tu\tfailed\tx\t-\t-\t-\tboom\t2\n")
    state = landed.batch_state_types(landed.read_batch_table(spark, str(tmp_path / "state.tsv"), landed.BATCH_STATE)).first()
    assert (state.score, state.retries, state.error) == (None, 2, "boom")
    (tmp_path / "patch.json").write_text('[{"key":"a","rank":3},{"key":"b","dim_scores":{"x":2}}]')
    assert landed.read_patch(spark, str(tmp_path / "patch.json")).count() == 2


def test_document_sources(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "lever-acme.md").write_text("# Acme — research\nProvider/key: lever:acme | company_type: product\nWhat they do: Tools.\nSources: acme.com\n")
    note = documents.parse_notes(documents.read_texts(spark, str(notes))).first()
    assert (note.file, note.title, note.key, note.company_type, note.what_they_do, note.remote_policy) == ("lever-acme.md", "Acme", "lever:acme", "product", "Tools.", None)
    reports = tmp_path / "reports"
    reports.mkdir()
    (reports / "012-acme.md").write_text("# R\n**URL:** https://www.x.org/jobs/1?utm_source=a\n")
    (reports / "013-none.md").write_text("# R\n")
    assert [tuple(r) for r in documents.parse_reports(documents.read_texts(spark, str(reports))).collect()] == [("012-acme.md", "012", "https://x.org/jobs/1")]


def test_sinks(spark, tmp_path):
    offers = spark.createDataFrame([("u", "s", "t", "c", None)], "url string, source string, title string, company string, location string")
    day = F.lit("2024-01-01").cast("date")
    for status in ("added", "skipped_expired"):
        append_history(history_rows(offers, day, F.lit(status)), str(tmp_path / "h"))
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "h")).collect()) == ["added", "skipped_expired"]
    lines = spark.createDataFrame([(2, "| 2 |"), (1, "| 1 |"), (10, "| 10 |")], "tracker_num int, line string")
    write_tracker(lines, str(tmp_path / "tracker"))
    parts = sorted((tmp_path / "tracker").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:3] == ["| 1 |", "| 2 |", "| 10 |"]
    write_scan(offers, spark.createDataFrame([("2024-01-01", True)], "scanned_at string, partial boolean"), str(tmp_path / "scan"))
    assert spark.read.parquet(str(tmp_path / "scan" / "rows")).count() == 1
    assert spark.read.json(str(tmp_path / "scan" / "meta")).first().partial is True
    write_jsonl(offers, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


LISTING = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("url", "company", "title")])


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def brute_ingest(rows, roles):
    """One pass over all listings: what was added takes its URL and its role."""
    urls, taken, out = set(), set(roles), {}
    for r in sorted(rows, key=lambda r: r["id"]):
        role = (r["company"].lower(), r["title"].lower()) if r["company"] is not None and r["title"] is not None else None
        if "engineer" not in (r["title"] or "").lower():
            out[r["id"]] = "skipped_title"
        elif (r["url"] is not None and r["url"] in urls) or (role is not None and role in taken):
            out[r["id"]] = "skipped_dup"
        else:
            out[r["id"]] = "added"
            urls.add(r["url"])
            taken.add(role)
    return out


@pytest.mark.parametrize("files", [1, 3, 5])
def test_ingest_does_not_depend_on_files(spark, tmp_path, files):
    rng = random.Random(3)
    rows = [
        {"id": k, "url": rng.choice([None, *(f"u{x}" for x in range(25))]), "company": rng.choice(["A", "a", "B", "C", "Old Co"]), "title": rng.choice(["Engineer", "engineer II", "Cook", "Data Engineer", None])}
        for k in range(90)
    ]
    source = tmp_path / "in"
    known = {("old co", "data engineer")}
    size = -(-len(rows) // files)
    empty = spark.createDataFrame([], outcome_schema(spark.createDataFrame([], LISTING)))
    history = BatchTable(spark, str(tmp_path / "history"), empty.schema)
    pending = BatchTable(spark, str(tmp_path / "pending"), empty.select("url", "company", "title").schema)
    roles = spark.createDataFrame(list(known), "company_lc string, role_lc string")
    for k in range(files):
        put(source, f"{k}.json", rows[k * size : (k + 1) * size])
        stream = scan_stream(spark, str(source), LISTING, files_per_trigger=1)
        ingest(stream, history, roles, title_passes(F.col("title"), ["engineer"]), F.lit(True), "url", "company", "title", "id", str(tmp_path / "cp"), pending).awaitTermination()
    want = brute_ingest(rows, known)
    assert {r.id: r.outcome for r in history.read().collect()} == want
    assert set(want.values()) == {"added", "skipped_dup", "skipped_title"}
    assert pending.read().count() == sum(o == "added" for o in want.values())


def test_ingest_forgets_after_a_number_of_batches(spark, tmp_path):
    source = tmp_path / "in"
    history = BatchTable(spark, str(tmp_path / "h"), outcome_schema(spark.createDataFrame([], LISTING)))
    roles = spark.createDataFrame([], "company_lc string, role_lc string")
    for k in range(4):
        put(source, f"{k}.json", [{"id": k, "url": "u", "company": f"c{k}", "title": "engineer"}])
        stream = scan_stream(spark, str(source), LISTING, files_per_trigger=1)
        ingest(stream, history, roles, F.lit(True), F.lit(True), "url", "company", "title", "id", str(tmp_path / "cp"), keep_batches=2).awaitTermination()
    assert {r.id: r.outcome for r in history.read().collect()} == {0: "added", 1: "skipped_dup", 2: "skipped_dup", 3: "added"}


REGISTRY = "key string, company_key string, company string, title string, url string, apply_url string, location string, department string, provider string, date_posted string, comp struct<min:double,max:double,currency:string,equity:boolean>, employment_type_raw string, first_seen date, last_seen date, live boolean, has_body boolean, extracted struct<seniority:string>"


def offer(n, title, board="a"):
    return {"url": f"https://x.org/{n}", "title": title, "company": board.upper(), "provider": "lever", "careers_url": f"https://jobs.lever.co/{board}", "description": "<p>x</p>"}


def files_of(folder):
    """Data files by bucket."""
    return {p.name: sorted(f.name for f in p.glob("part-*")) for p in folder.glob("bucket=*")}


def test_registry_refresh_stream(spark, tmp_path):
    source = tmp_path / "scans"
    prior = spark.createDataFrame([], REGISTRY)
    companies = spark.createDataFrame([], "key string, careers_url string")
    registry = BucketTable(spark, str(tmp_path / "registry"), "key", "company_key", prior.schema, 8)
    registry.create(prior)
    to_listings = lambda batch: scan_to_listings(batch.withColumn("ord", F.lit(0)), companies, "ord")
    meta = spark.createDataFrame([("1", 3), ("2", 1), ("3", 1)], "scan string, n_rows long")
    seen = []
    # The first scan is two files and so two micro-batches: nothing may expire between them.
    scans = (
        ("1", "2024-01-01", [[offer(1, "A")], [offer(2, "B"), offer(3, "C", "b")]]),
        ("2", "2024-02-01", [[offer(2, "B2")]]),
        ("3", "2024-03-01", [[offer(3, "C3", "a")]]),  # moves to another company
    )
    for name, day, files in scans:
        for k, rows in enumerate(files):
            put(source, f"{name}-{k}.json", rows)
        number = F.regexp_extract(F.input_file_name(), r"(\d+)-\d+\.json", 1)
        stream = scan_stream(spark, str(source), landed.RAW_SCAN, files_per_trigger=1).withColumn("scan", number)
        refresh_stream(stream, "scan", meta, str(tmp_path / "arrived"), registry, to_listings, F.lit(day).cast("date"), str(tmp_path / "cp")).awaitTermination()
        seen.append((files_of(tmp_path / "registry"), {r.key[-1]: (r.title, r.live, str(r.first_seen), str(r.last_seen), r.company_key[-1]) for r in registry.read().collect()}))
    assert seen[0][1] == {"1": ("A", True, "2024-01-01", "2024-01-01", "a"), "2": ("B", True, "2024-01-01", "2024-01-01", "a"), "3": ("C", True, "2024-01-01", "2024-01-01", "b")}
    assert seen[1][1] == {"1": ("A", False, "2024-01-01", "2024-01-01", "a"), "2": ("B2", True, "2024-01-01", "2024-02-01", "a"), "3": ("C", True, "2024-01-01", "2024-01-01", "b")}
    assert seen[2][1]["3"] == ("C3", True, "2024-01-01", "2024-03-01", "a") and len(seen[2][1]) == 3
    bucket = {r.company_key[-1]: f"bucket={r.b}" for r in spark.createDataFrame([("lever:a",), ("lever:b",)], "company_key string").withColumn("b", registry.bucket_of(F.col("company_key"))).collect()}
    keys = {r.company_key for r in registry.read().collect()}
    assert keys == {"lever:a"}
    changed = [{b for b in seen[k][0] if seen[k][0][b] != seen[k + 1][0][b]} for k in (0, 1)]
    assert changed[0] == {bucket["a"]}  # a scan of one company leaves the other files as they are
    assert changed[1] == {bucket["a"], bucket["b"]}


def test_scan_without_an_id_waits_and_repeats_change_nothing(spark, tmp_path):
    prior = spark.createDataFrame([], REGISTRY)
    registry = BucketTable(spark, str(tmp_path / "registry"), "key", "company_key", prior.schema, 4)
    registry.create(prior)
    companies = spark.createDataFrame([], "key string, careers_url string")
    to_listings = lambda batch: scan_to_listings(batch.withColumn("ord", F.lit(0)), companies, "ord")
    put(tmp_path / "in", "0.json", [offer(1, "A") | {"scan": None}, offer(2, "B") | {"scan": "s"}])
    schema = T.StructType([*landed.RAW_SCAN.fields, T.StructField("scan", T.StringType())])
    stream = scan_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    meta = spark.createDataFrame([("s", 1), (None, 1)], "scan string, n_rows long")
    day = F.lit("2024-01-01").cast("date")
    refresh_stream(stream, "scan", meta, str(tmp_path / "arrived"), registry, to_listings, day, str(tmp_path / "cp")).awaitTermination()
    before = sorted(map(tuple, registry.read().collect()))
    assert [r[0][-1] for r in before] == ["2"]
    scan = to_listings(spark.read.schema(schema).json(str(tmp_path / "in")).where("scan = 's'").drop("scan"))
    merge_scan(registry, scan, day)
    assert sorted(map(tuple, registry.read().collect())) == before


def test_batch_table(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "b"), spark.range(0).schema)
    assert table.read().count() == 0
    for k in range(4):
        table.write(spark.range(k, k + 1), k)
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        table.write(broken, 4)
    assert sorted(r.id for r in table.read(4).collect()) == [0, 1, 2, 3]
    table.write(spark.range(9, 10), 1)  # the batch runs again
    assert sorted(r.id for r in table.read().collect()) == [0, 2, 3, 9] and [r.id for r in table.read(1).collect()] == [0]
    small = table.compacted(str(tmp_path / "c"), 3)
    assert sorted((r.batch, r.id) for r in small.read().collect()) == [(2, 0), (2, 2), (2, 9), (3, 3)]


def test_bucket_table(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("string").alias("g"), F.lit(0).alias("v"))
    table = BucketTable(spark, str(tmp_path / "t"), "k", "g", rows.schema, 16)
    table.create(rows)
    table.create(rows.limit(0))  # a table that is there stays
    assert table.read().count() == 100
    keys, groups = rows.where("k = '7'").select("k"), rows.where("g = '3'").select("g").distinct()
    touched = table.touched(keys, groups)
    assert 1 <= len(touched) <= 2
    table.replace(table.read(touched).withColumn("v", F.when(F.col("g") == "3", 1).otherwise(F.col("v"))).where("k <> '7'"), touched)
    got = table.read().collect()
    assert len(got) == 99 and {r.g for r in got if r.v == 1} == {"3"}
    table.replace(rows.limit(0), list(range(16)))  # buckets can be emptied
    assert table.read().count() == 0


def test_submission_stream_equals_table(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType())])
    source = tmp_path / "events"
    times = [[0, 3, 6], [7, 20], [24, 27, 31]]
    n, out, cp = 0, str(tmp_path / "out"), str(tmp_path / "cp")
    for f, batch in enumerate(times):
        rows = []
        for s in reversed(batch):
            rows.append({"id": n, "k": "a", "ts": (start + dt.timedelta(seconds=s)).isoformat() + "Z"})
            n += 1
        put(source, f"{f}.json", rows)
        stream = scan_stream(spark, str(source), schema, files_per_trigger=1)
        accepted = accepted_submissions(stream, "k", "ts", "id", 4, "1 minute", "1 minute")
        accepted.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    seconds = sorted(int((r.ts - start).total_seconds()) for r in spark.read.parquet(out).collect())
    assert seconds == [0, 6, 20, 24, 31]


@pytest.mark.parametrize("name", ["stream_ingest", "stream_submissions", "stream_timeline", "stream_open_counts", "stream_open_counts_touched", "stream_registry_refresh"])
def test_streams_read_folders(spark, sf, tmp_path, name):
    """A table that is a folder of several files gives the same result as one file."""
    from vacantia.catalog.registry import QUERIES, load_all

    load_all()
    for table in ("events", "part"):
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        key = "event_id" if table == "events" else "p_partkey"
        # A listing's outcome depends on those before it: files come in the order of the ids.
        order = ["ts", key] if table == "events" and name != "stream_ingest" else [key]
        for k, (lo, hi) in enumerate(((0.0, 0.3), (0.3, 0.7), (0.7, 1.1))):
            n = rows.count()
            ranked = rows.toPandas().sort_values(order, kind="stable").iloc[int(lo * n) : int(hi * n)]
            (tmp_path / f"{table}.parquet").mkdir(exist_ok=True)
            ranked.to_parquet(tmp_path / f"{table}.parquet" / f"{k}.parquet", index=False, coerce_timestamps="us")
    whole = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr)
    parts = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert whole == parts and whole


EVENTS = "event_id long, key string, ts timestamp, status string, place string"


def run_timeline(spark, folder, late):
    stream = scan_stream(spark, str(folder / "in"), spark.createDataFrame([], EVENTS).schema, "parquet", 1)
    out = status_change_stream(stream, "key", "ts", "event_id", "status", late)
    with rocksdb_state(spark):
        out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(str(folder / "out"))


@pytest.mark.parametrize("late", ["20 minutes", "10 days"])
def test_timeline_of_events_out_of_order(spark, tmp_path, late):
    """Files in scrambled order, as long as nothing is later than the watermark allows; null states, null times."""
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, rng.choice("abc"), start + dt.timedelta(seconds=60 * k + rng.randrange(60)), rng.choice(["Applied", "Offer", None]), rng.choice(["x", None])) for k in range(60)]
    rows += [(100, "d", None, "Applied", "y"), (101, None, start, "Applied", "y"), (61, "a", rows[40][2], "Offer", "t"), (62, "a", rows[40][2], None, "t")]
    order = list(range(0, 60, 10)) if late == "20 minutes" else [20, 0, 50, 10, 40, 30]
    # Neighbouring files change places: within 20 minutes of the newest event.
    order = [10, 0, 30, 20, 50, 40] if late == "20 minutes" else order
    for k, at in enumerate(order):
        part = rows[at : at + 10] + (rows[60:] if at == 40 else [])
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        emitted = run_timeline(spark, tmp_path, late)
    placed = spark.createDataFrame([r for r in rows if r[1] is not None and r[2] is not None], EVENTS)
    want = sorted(status_changes(placed, "key", "ts", "event_id", "status").collect(), key=lambda r: r.event_id)
    so_far = timeline_so_far(emitted, str(tmp_path / "cp"), "key", "ts", "event_id", "status")
    assert sorted(so_far.collect(), key=lambda r: r.event_id) == want
    done = emitted.collect()
    assert {r.event_id for r in done} <= {r.event_id for r in want}
    assert (len(done) > 10) == (late == "20 minutes")


def test_timeline_drops_what_is_behind_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    for part in ([(1, "a", at(0), "Applied", "")], [(2, "a", at(100), "Offer", "")], [(3, "a", at(5), "Rejected", ""), (4, "a", at(95), "Interview", "")]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        emitted = run_timeline(spark, tmp_path, "10 minutes")
    assert [r.event_id for r in emitted.collect()] == [1]
    so_far = timeline_so_far(emitted, str(tmp_path / "cp"), "key", "ts", "event_id", "status")
    assert sorted((r.event_id, r.status) for r in so_far.collect()) == [(1, "Applied"), (2, "Offer"), (4, "Interview")]


def test_open_counts_follow_moves_and_old_events(spark, tmp_path):
    """Any order of events; applications that close, come back and change companies."""
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, rng.randrange(8), rng.choice(["g", "h", "", None]), start + dt.timedelta(minutes=rng.randrange(50)), rng.choice(["Applied", "Rejected", None])) for k in range(80)]
    rows += [(90, 3, "g", None, "Applied"), (91, None, "g", start, "Applied"), (92, 77, "h", None, "Applied")]
    rng.shuffle(rows)
    schema = "id long, app long, company string, ts timestamp, status string"
    sizes = []
    for k in range(0, len(rows), 21):
        spark.createDataFrame(rows[k : k + 21], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = scan_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "parquet", 1)
        changes = open_count_changes(stream, "app", "company", "ts", "id")
        with rocksdb_state(spark):
            changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(changes.schema).parquet(str(tmp_path / "out"))
        last = {}
        for r in sorted((r for r in rows[: k + 21] if r[1] is not None), key=lambda r: (r[3] is not None, r[3] or start, r[0])):
            last[r[1]] = r
        want = {}
        for r in last.values():
            if r[4] in OPEN and r[2]:
                want[r[2]] = want.get(r[2], 0) + 1
        assert {r.company: r.open_count for r in latest_counts(got, "company").collect()} == want
        assert {r.company: r.open_count for r in open_counts(spark, str(tmp_path / "cp"), "company").collect()} == want
        sizes.append(got.count())
    assert all(b - a <= 2 for a, b in zip(sizes, sizes[1:]))  # a batch emits a row per touched company at most


def test_counters_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("added",)] * 3 + [("skipped_dup",), (None,), ("odd",)], "outcome string")
    seen = write_counted(rows, str(tmp_path / "o"), "outcome", ["added", "skipped_dup", "skipped_title"])
    assert seen == {"added": 3, "skipped_dup": 1, "skipped_title": 0, "other": 2}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 6


def test_counters_of_a_stream(spark, tmp_path):
    for part in (["added", "added"], ["skipped_dup"]):
        spark.createDataFrame([(x,) for x in part], "outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counters = BatchCounters("outcomes")
    spark.streams.addListener(counters)
    try:
        stream = scan_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "outcome string").schema, "parquet", 1)
        watched = stream.observe("outcomes", *value_counts("outcome", ["added", "skipped_dup"]))
        watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if counters.totals().get("skipped_dup"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals() == {"added": 2, "skipped_dup": 1, "other": 0}
