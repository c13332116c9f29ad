"""Application upserts, caps, lifecycle and key matching."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.applications import (
    applications_view, capped_companies, merge_additions, open_per_company, search_applications, sync_decisions,
    timeline_events, tracker_rows, upsert_applications, with_cap, with_company_key,
)
from ..operators.matching import (
    PROVIDER_ORDER, enabled_companies, lifecycle_tables, match_submissions, resolve_by_name, resolve_by_url, resolve_keys,
    route_companies, with_lifecycle,
)
from ..session import shared_dir
from ..sinks.bucketed import BucketedRegistry
from ..sinks.tables import tracker_in_order
from ..sources.landed import tracker_applications, tracker_pairs, tracker_status_by_number
from .registry import query, table
from .standins import APPS_SQL, STATUS_SQL, apps, event_status
from .urls import customer_board, customer_slug

# ── upsert: users' events on applications; users of building customers are known before ──

_NO_TEXT = "CAST(NULL AS VARCHAR)"
_EVENTS_SQL = f"""ev AS (SELECT 'u' || user_id AS key, ts, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE {STATUS_SQL} END AS status,
 CASE WHEN event_type = 'click' THEN 'Title ' || event_id END AS title, CASE WHEN event_type = 'error' THEN 'note ' || event_id ELSE NULL END AS notes,
 CASE WHEN event_type = 'purchase' THEN 'Rec ' || event_id END AS rname, CASE WHEN event_type = 'signup' THEN event_id || '@x.org' END AS rmail, CASE WHEN event_type = 'click' THEN value END AS score FROM events),
old AS (SELECT 'u' || c_custkey AS key, c_custkey + 5 AS tracker_num, c_name AS title, 'Applied' AS status, CASE WHEN c_acctbal > 0 THEN DATE '2023-12-01' END AS date_applied, 'Kim' AS rname FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _events(spark, sf):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    null = F.lit(None).cast("string")
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(kind != "view", event_status()).alias("status"), F.lit(None).cast("date").alias("date"), null.alias("note"),
        F.when(kind == "click", F.concat(F.lit("Title "), number)).alias("title"), F.when(kind == "error", F.concat(F.lit("note "), number)).alias("notes"),
        F.struct(
            F.when(kind == "purchase", F.concat(F.lit("Rec "), number)).alias("name"), F.when(kind == "signup", F.concat(number, F.lit("@x.org"))).alias("email"),
            null.alias("phone"), null.alias("notes"),
        ).alias("recruiter"),
        F.when(kind == "click", F.col("value")).alias("score"),
    )


def _old_applications(spark, sf):
    null = F.lit(None).cast("string")
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"), (F.col("c_custkey") + 5).cast("int").alias("tracker_num"), F.col("c_name").alias("title"),
        F.lit("Applied").alias("status"), F.when(F.col("c_acctbal") > 0, F.lit("2023-12-01").cast("date")).alias("date_applied"),
        F.struct(F.lit("Kim").alias("name"), null.alias("email"), null.alias("phone"), null.alias("notes")).alias("recruiter"),
        F.lit(None).cast("double").alias("score"), null.alias("notes"), F.lit(None).cast("date").alias("last_updated"),
    )


@query(
    "application_upsert",
    f"""WITH {_EVENTS_SQL}, f AS (SELECT key, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status, arg_max(title, (ts, event_id)) FILTER (WHERE title IS NOT NULL) AS title,
 arg_max(notes, (ts, event_id)) FILTER (WHERE notes IS NOT NULL) AS notes, arg_max(rname, (ts, event_id)) FILTER (WHERE rname IS NOT NULL) AS rname, arg_max(rmail, (ts, event_id)) FILTER (WHERE rmail IS NOT NULL) AS rmail,
 arg_max(score, (ts, event_id)) FILTER (WHERE score IS NOT NULL) AS score, min(ts) AS first_ts FROM ev GROUP BY key),
n AS (SELECT key, (SELECT max(tracker_num) FROM old) + row_number() OVER (ORDER BY first_ts, key) AS num FROM f WHERE key NOT IN (SELECT key FROM old))
SELECT coalesce(f.key, o.key) AS key, CAST(coalesce(o.tracker_num, n.num) AS INT) AS tracker_num, coalesce(f.status, o.status, 'Applied') AS status, coalesce(f.title, o.title, CASE WHEN o.key IS NULL THEN '' END) AS title,
 coalesce(f.notes, CASE WHEN o.key IS NULL THEN '' END) AS notes, coalesce(f.rname, o.rname) AS recruiter_name, f.rmail AS recruiter_email, f.score,
 coalesce(o.date_applied, CAST(f.first_ts AS DATE)) AS date_applied, CASE WHEN f.key IS NOT NULL THEN DATE '2024-02-01' END AS last_updated FROM f FULL JOIN old o ON f.key = o.key LEFT JOIN n ON f.key = n.key""",
)
def application_upsert(spark, sf):
    merged = upsert_applications(_old_applications(spark, sf), _events(spark, sf), "ts", "event_id", F.lit("2024-02-01").cast("date"))
    return merged.select(
        "key", "tracker_num", "status", "title", "notes", F.col("recruiter.name").alias("recruiter_name"), F.col("recruiter.email").alias("recruiter_email"),
        "score", "date_applied", "last_updated",
    )


@query(
    "application_timeline",
    f"""WITH {_EVENTS_SQL}, x AS (SELECT e.*, o.key IS NOT NULL AS known, row_number() OVER (PARTITION BY e.key ORDER BY ts, event_id) AS rn FROM ev e LEFT JOIN old o ON e.key = o.key),
y AS (SELECT *, CASE WHEN status IS NULL AND NOT known AND rn = 1 THEN 'Applied' ELSE status END AS st FROM x),
z AS (SELECT *, lag(st) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM y WHERE st IS NOT NULL)
SELECT key, event_id, st AS status, CAST(ts AS DATE) AS date FROM z WHERE CASE WHEN before IS NULL THEN NOT known OR st <> 'Applied' ELSE before <> st END""",
)
def application_timeline(spark, sf):
    rows = timeline_events(_events(spark, sf), _old_applications(spark, sf), "ts", "event_id")
    return rows.select("key", "event_id", "status", "date")


# ── cap ──────────────────────────────────────────────────────────────

_OPEN_SQL = f"{APPS_SQL}, open AS (SELECT company_key, count(*) AS open_count FROM apps WHERE status IN ('Applied', 'Responded', 'Interview', 'Offer') GROUP BY 1)"


@query("open_per_group", f"WITH {_OPEN_SQL} SELECT company_key, open_count FROM open")
def open_per_group(spark, sf):
    return open_per_company(apps(spark, sf))


@query("capped_groups", f"WITH {_OPEN_SQL} SELECT company_key, open_count FROM open WHERE open_count >= 17")
def capped_groups(spark, sf):
    return capped_companies(open_per_company(apps(spark, sf)), 17)


@query(
    "cap_flags",
    f"WITH {_OPEN_SQL} SELECT o_orderkey, coalesce(open_count, 0) AS open_count, coalesce(open_count, 0) >= 17 AS capped FROM orders LEFT JOIN open ON company_key = 'g' || (o_custkey % 9)",
)
def cap_flags(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("g"), (F.col("o_custkey") % 9).cast("string")).alias("company_key"))
    return with_cap(rows, open_per_company(apps(spark, sf)), 17).select("o_orderkey", "open_count", "capped")


# ── lifecycle: listings are orders; applications, reports and the tracker follow from them ──

_LISTING_URL = "'https://jobs.example.org/' || CASE WHEN o_orderstatus = 'F' THEN 'jobs/' ELSE 'pos/' END || o_orderkey"
_LIFE_SQL = f"""l AS (SELECT o_orderkey, o_custkey, o_orderpriority AS pri, o_totalprice AS price, {_LISTING_URL} AS key, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS id FROM orders),
a AS (SELECT CASE WHEN pri = '1-URGENT' THEN key ELSE 'https://other.example.org/apply?token=' || o_orderkey END AS url, CASE WHEN pri = '1-URGENT' THEN id ELSE CAST(o_orderkey AS VARCHAR) END AS id,
 CASE WHEN price > 250000 THEN 'Interview' ELSE 'Applied' END AS status, 'r' || o_orderkey || '.md' AS report, o_orderkey AS ord FROM l WHERE pri IN ('1-URGENT', '2-HIGH')),
r AS (SELECT l.key AS url, id, CASE WHEN price > 100000 THEN 'Rejected' ELSE 'Evaluated' END AS status, o_orderkey || '-x.md' AS report, o_orderkey AS ord FROM l WHERE pri IN ('3-MEDIUM', '1-URGENT') AND key NOT IN (SELECT url FROM a)),
s AS (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 FROM r),
by_url AS (SELECT url, arg_max(status, (src, ord)) AS status, arg_max(report, (src, ord)) AS report FROM s GROUP BY 1),
by_id AS (SELECT id, arg_max(status, (src, ord)) AS status, arg_max(report, (src, ord)) AS report FROM s WHERE id <> '' GROUP BY 1)"""


def _order_listings(spark, sf):
    number = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderstatus") == "F", "jobs/").otherwise("pos/")
    return table(spark, sf, "orders").withColumn("key", F.concat(F.lit("https://jobs.example.org/"), kind, number))


def _lifecycle(spark, sf):
    rows, number = _order_listings(spark, sf), F.col("o_orderkey").cast("string")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    applications = rows.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(
        F.when(urgent, F.concat("key", F.lit("?utm_source=mail"))).otherwise(F.concat(F.lit("https://other.example.org/apply?token="), number)).alias("key"),
        F.when(F.col("o_totalprice") > 250000, "Interview").otherwise("Applied").alias("status"),
        F.concat(F.lit("[1](reports/r"), number, F.lit(".md)")).alias("report"), F.col("o_orderkey").alias("ord"),
    )
    reports = rows.where("o_orderpriority IN ('3-MEDIUM', '1-URGENT')").select(
        F.concat(number, F.lit("-x.md")).alias("file"), number.alias("num"), F.col("key").alias("url"), F.col("o_orderkey").alias("ord")
    )
    tracker = rows.where("o_totalprice > 100000").select(number.alias("num"), F.lit("Rejected").alias("status"))
    return lifecycle_tables(applications, reports, tracker, "ord")


@query(
    "lifecycle_join",
    f"WITH {_LIFE_SQL} SELECT o_orderkey, coalesce(u.status, i.status) AS status, CASE WHEN u.url IS NOT NULL THEN u.report ELSE i.report END AS report FROM l LEFT JOIN by_url u ON l.key = u.url LEFT JOIN by_id i ON l.id = i.id",
)
def lifecycle_join(spark, sf):
    by_url, by_id = _lifecycle(spark, sf)
    return with_lifecycle(_order_listings(spark, sf), by_url, by_id).select("o_orderkey", "status", "report")


@query(
    "lifecycle_join_bucketed",
    f"WITH {_LIFE_SQL} SELECT o_orderkey, coalesce(u.status, i.status) AS status, CASE WHEN u.url IS NOT NULL THEN u.report ELSE i.report END AS report FROM l LEFT JOIN by_url u ON l.key = u.url LEFT JOIN by_id i ON l.id = i.id",
)
def lifecycle_join_bucketed(spark, sf):
    """The same with the registry as bucketed tables that hold its ids."""
    by_url, by_id = _lifecycle(spark, sf)
    registry = BucketedRegistry(spark, f"registry_{uuid.uuid4().hex}", shared_dir(spark, "bucketed"), "key", 8)
    return registry.write(_order_listings(spark, sf)).with_lifecycle(by_url, by_id).select("o_orderkey", "status", "report")


@query("report_status_join", f"WITH {_LIFE_SQL} SELECT url, status, report FROM by_url")
def report_status_join(spark, sf):
    return _lifecycle(spark, sf)[0].select("url", "by_url.status", "by_url.report")


@query(
    "priority_match",
    """WITH l AS (SELECT p_partkey AS ord, 'k' || p_partkey AS k, CASE WHEN p_type = 'SMALL' THEN p_partkey END AS id, CASE WHEN p_size > 25 THEN p_partkey ELSE p_partkey // 2 END AS ap FROM part),
s AS (SELECT o_orderkey, o_custkey AS n, o_orderstatus AS st FROM orders),
hits AS (SELECT o_orderkey, ord FROM s JOIN l ON st = 'F' AND ord = n UNION ALL SELECT o_orderkey, ord FROM s JOIN l ON st = 'O' AND ap = n UNION ALL SELECT o_orderkey, ord FROM s JOIN l ON st = 'P' AND id = n)
SELECT s.o_orderkey, 'https://jobs.example.org/pos/' || min(ord) AS matched_key FROM s LEFT JOIN hits h ON s.o_orderkey = h.o_orderkey GROUP BY 1""",
)
def priority_match(spark, sf):
    number, half = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 2).cast("string")
    base = "https://jobs.example.org/pos/"
    listings = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit(base), number).alias("key"),
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("https://co.example.org/?gh_jid="), number)).alias("url"),
        F.concat(F.lit("https://apply.example.org/"), F.when(F.col("p_size") > 25, number).otherwise(half)).alias("apply_url"),
    )
    n, state = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    submitted = table(spark, sf, "orders").select("o_orderkey", F.when(state == "F", F.concat(F.lit(base), n, F.lit("/#form"))).when(
        state == "O", F.concat(F.lit("https://www.apply.example.org/"), n, F.lit("?src=x"))
    ).otherwise(F.concat(F.lit("https://form.example.org/embed?token="), n)).alias("apply_url"))
    matched = match_submissions(submitted, listings, "ord", "o_orderkey")
    return matched.select("o_orderkey", "matched_key")


@query(
    "free_text_keys",
    """WITH t(text, i) AS (VALUES ('Blue Widget', 1), ('brand#9 red', 2), ('p12', 3), ('Customer#000000003', 4), ('https://WWW.x.org/a/?utm_x=1', 5), ('nothing like it', 6)),
l AS (SELECT t.text, min(p_partkey) AS k FROM t JOIN part ON contains(lower(p_brand), lower(text)) OR contains(p_name, lower(text)) OR contains(lower(p_brand) || ' ' || p_name, lower(text)) GROUP BY 1),
a AS (SELECT t.text, min(c_custkey) AS k FROM t JOIN customer ON contains(lower(c_name), lower(text)) GROUP BY 1)
SELECT t.text, CASE WHEN i = 5 THEN 'https://x.org/a' WHEN i = 3 THEN 'p12' ELSE coalesce('p' || l.k, 'p' || a.k, '') END AS key FROM t LEFT JOIN l ON t.text = l.text LEFT JOIN a ON t.text = a.text""",
)
def free_text_keys(spark, sf):
    listings = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord")
    )
    applications = table(spark, sf, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("company"), F.lit("").alias("title"), F.col("c_custkey").alias("ord")
    )
    texts = ["Blue Widget", "brand#9 red", "p12", "Customer#000000003", "https://WWW.x.org/a/?utm_x=1", "nothing like it"]
    return resolve_keys(texts, listings, applications, "ord")


@query(
    "free_text_keys_table",
    """WITH t AS (SELECT DISTINCT trim(x) AS text FROM (SELECT upper(substr(p_brand || ' ' || p_name, 4, 9)) AS x FROM part WHERE p_partkey % 3 = 0 UNION SELECT substr(c_name, 12) FROM customer WHERE c_custkey % 7 = 0 UNION SELECT 'p' || p_partkey FROM part WHERE p_size = 9
 UNION SELECT 'https://www.x.org/jobs/' || s_suppkey || '/' FROM supplier) WHERE trim(x) <> ''),
l AS (SELECT lower(p_brand) || ' ' || lower(p_name) AS n, min(p_partkey) AS k FROM part GROUP BY 1), a AS (SELECT lower(c_name) AS n, min(c_custkey) AS k FROM customer GROUP BY 1),
li AS (SELECT text, min(k) AS k FROM t JOIN l ON contains(n, lower(text)) GROUP BY 1), ai AS (SELECT text, min(k) AS k FROM t JOIN a ON contains(n, lower(text)) GROUP BY 1)
SELECT text, CASE WHEN text LIKE 'https://%' THEN 'https://x.org/jobs/' || split_part(text, '/', 5) WHEN text IN (SELECT 'p' || c_custkey FROM customer) THEN text ELSE coalesce('p' || li.k, 'p' || ai.k, '') END AS key
 FROM t LEFT JOIN li USING (text) LEFT JOIN ai USING (text)""",
)
def free_text_keys_table(spark, sf):
    """Typed texts that are rows of a table, as many as there are."""
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    number = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    listings = part.select(number("p_partkey").alias("key"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    applications = customer.select(number("c_custkey").alias("key"), F.col("c_name").alias("company"), F.lit("").alias("title"), F.col("c_custkey").alias("ord"))
    typed = [
        part.where("p_partkey % 3 = 0").select(F.upper(F.substring(F.concat_ws(" ", "p_brand", "p_name"), 4, 9)).alias("text")),
        customer.where("c_custkey % 7 = 0").select(F.substring("c_name", F.lit(12), F.lit(99)).alias("text")),
        part.where("p_size = 9").select(number("p_partkey").alias("text")),
        table(spark, sf, "supplier").select(F.concat(F.lit("https://www.x.org/jobs/"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("text")),
    ]
    return resolve_keys(reduce(DataFrame.unionByName, typed), listings, applications, "ord")


# ── boards of companies ──────────────────────────────────────────────


@query(
    "first_provider_hit",
    """WITH b AS (SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN 'lever' WHEN s_nationkey < 16 THEN 'ashby' ELSE 'breezy' END AS provider, CASE WHEN s_acctbal < 3000 THEN 'customer' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0')
 WHEN s_acctbal < 6000 THEN 'customer-' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') ELSE 'customer' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') || 'labs' END AS slug, s_nationkey AS n FROM supplier),
b2 AS (SELECT provider, slug, max(n) AS n FROM b GROUP BY 1, 2),
g AS (SELECT c_name, x.slug, x.pos FROM (SELECT c_name, unnest([{'slug': lower(replace(c_name, '#', '')) || 'labs', 'pos': 1}, {'slug': lower(replace(c_name, '#', '-')) || '-labs', 'pos': 2}, {'slug': lower(replace(c_name, '#', '')), 'pos': 3}]) AS x FROM customer)),
h AS (SELECT c_name, provider, b2.slug, row_number() OVER (PARTITION BY c_name ORDER BY CASE provider WHEN 'ashby' THEN 2 WHEN 'lever' THEN 3 ELSE 9 END, pos) AS rn FROM g JOIN b2 ON g.slug = b2.slug WHERE n > 0)
SELECT c.c_name || ' Labs' AS name, provider, slug, provider IS NOT NULL AS resolved FROM customer c LEFT JOIN h ON c.c_name = h.c_name AND rn = 1""",
)
def first_provider_hit(spark, sf):
    digits = F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    boards = table(spark, sf, "supplier").select(
        F.when(nation < 8, "lever").when(nation < 16, "ashby").otherwise("breezy").alias("provider"),
        F.when(balance < 3000, F.concat(F.lit("customer"), digits)).when(balance < 6000, F.concat(F.lit("customer-"), digits)).otherwise(F.concat(F.lit("customer"), digits, F.lit("labs"))).alias("slug"),
        F.lit("https://x").alias("careers_url"), nation.alias("count"),
    ).groupBy("provider", "slug").agg(F.max("careers_url").alias("careers_url"), F.max("count").alias("count"))
    names = table(spark, sf, "customer").select(F.concat("c_name", F.lit(" Labs")).alias("name"))
    return resolve_by_name(names, boards, "name").select("name", "provider", "slug", "resolved")


@query(
    "resolve_by_url",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' WHEN 'HOUSEHOLD' THEN 'recruitee' WHEN 'FURNITURE' THEN NULL ELSE 'lever' END AS provider,
 c_mktsegment <> 'FURNITURE' AND c_acctbal > 1000 AND c_mktsegment <> 'MACHINERY' AS resolved FROM customer""",
)
def resolve_by_url_query(spark, sf):
    slug = customer_slug()
    segment = F.col("c_mktsegment")
    provider = F.when(segment == "BUILDING", "greenhouse").when(segment == "MACHINERY", "ashby").when(segment == "HOUSEHOLD", "recruitee").otherwise("lever")
    rows = table(spark, sf, "customer")
    boards = rows.where(F.col("c_acctbal") > 1000).select(provider.alias("provider"), slug.alias("slug"), F.lit(3).alias("count"))
    named = rows.select("c_custkey", customer_board().alias("url"))
    # Slugs are compared as they are written in the URL, and Ashby URLs here are upper case.
    return resolve_by_url(named, boards, "url").select("c_custkey", "provider", "resolved")


@query(
    "provider_routing",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'explicit' WHEN c_acctbal < 500 THEN 'unknown_provider' WHEN c_acctbal < 1500 THEN 'parser' WHEN c_mktsegment = 'FURNITURE' THEN 'unmatched' ELSE 'detected' END AS route,
 CASE WHEN c_acctbal < 0 THEN 'gem' WHEN c_acctbal < 500 THEN NULL WHEN c_acctbal < 1500 THEN 'local-parser' WHEN c_mktsegment = 'BUILDING' THEN 'greenhouse' WHEN c_mktsegment = 'MACHINERY' THEN 'ashby'
 WHEN c_mktsegment = 'HOUSEHOLD' THEN 'recruitee' WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'lever' END AS provider_id FROM customer WHERE c_nationkey <> 7""",
)
def provider_routing(spark, sf):
    balance = F.col("c_acctbal")
    entries = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_nationkey") == 7, False).alias("enabled"), customer_board().alias("careers_url"), F.lit("").alias("api"),
        F.when(balance < 0, "gem").when(balance < 500, "acme").alias("provider"), F.when(balance < 1500, "python3").alias("parser_command"),
    )
    return route_companies(enabled_companies(entries, "customer#"), PROVIDER_ORDER).select("c_custkey", "route", "provider_id")


# ── tracker ──────────────────────────────────────────────────────────

_TRACKER_LINE = """'| ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | Cust ' || o_custkey || ' | ' || o_orderpriority || ' | ' || CASE WHEN o_orderstatus = 'P' THEN '—' WHEN o_orderstatus = 'F' THEN '4.5/5' ELSE '3/5' END
 || ' | ' || CASE WHEN o_totalprice > 250000 THEN 'Offer' ELSE 'Applied' END || ' | ' || CASE WHEN o_orderstatus = 'O' THEN '✅' ELSE '❌' END || ' | [' || o_orderkey || '](../reports/' || o_orderkey || '-x.md) | ' || lower(o_orderstatus) || ' / n |'"""


def _tracker(spark, sf):
    state, number = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    applications = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("tracker_num"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_applied"),
        F.concat(F.lit("Cust "), F.col("o_custkey").cast("string")).alias("company"), F.col("o_orderpriority").alias("title"),
        F.when(state == "F", "4.5/5").when(state == "O", "3").alias("score"), F.when(F.col("o_totalprice") > 250000, "Offer").otherwise("Applied").alias("status"),
        F.lit("").alias("pdf"), F.when(state == "O", "cv.pdf").alias("cv_pdf"), F.concat(F.lit("["), number, F.lit("](reports/"), number, F.lit("-x.md)")).alias("report"),
        F.concat(F.lower(state), F.lit(" |\tn\n")).alias("notes"),
    )
    return tracker_rows(applications, "../")


@query("tracker_export", f"SELECT CAST(o_orderkey AS INT) AS tracker_num, {_TRACKER_LINE} AS line FROM orders")
def tracker_export(spark, sf):
    return _tracker(spark, sf)


@query("tracker_first_lines", f"SELECT CAST(o_orderkey AS INT) AS tracker_num, {_TRACKER_LINE} AS line FROM orders ORDER BY 1 LIMIT 40")
def tracker_first_lines(spark, sf):
    """The beginning of the tracker as it is written: lines in order of their number."""
    return tracker_in_order(_tracker(spark, sf)).limit(40)


def _tracker_lines(spark, sf):
    header = spark.createDataFrame([("# Applications",), ("| # | Date | Company | Role | Score | Status | PDF | Report | Notes |",), ("|---|------|---------|------|-------|--------|-----|--------|-------|",)], "value string")
    return header.unionByName(_tracker(spark, sf).select(F.col("line").alias("value")))


@query("tracker_pairs", "SELECT DISTINCT 'cust ' || o_custkey AS company_lc, lower(o_orderpriority) AS role_lc FROM orders")
def tracker_pairs_query(spark, sf):
    return tracker_pairs(_tracker_lines(spark, sf))


@query(
    "tracker_import",
    """SELECT CAST(o_orderkey AS INT) AS tracker_num, strftime(o_orderdate, '%Y-%m-%d') AS date_applied, 'Cust ' || o_custkey AS company, o_orderpriority AS title,
 CASE WHEN o_orderstatus = 'F' THEN '4.5/5' WHEN o_orderstatus = 'O' THEN '3/5' END AS score, CASE WHEN o_totalprice > 250000 THEN 'Offer' ELSE 'Applied' END AS status FROM orders WHERE o_orderkey > 0 AND o_orderdate >= TIMESTAMP '1996-01-01'""",
)
def tracker_import(spark, sf):
    known = table(spark, sf, "orders").where("o_orderdate < TIMESTAMP '1996-01-01'").select(F.col("o_orderkey").cast("int").alias("tracker_num"))
    rows = tracker_applications(_tracker_lines(spark, sf), known)
    return rows.select("tracker_num", "date_applied", "company", "title", "score", "status")


@query("tracker_status_by_number", "SELECT CAST(o_orderkey AS VARCHAR) AS num, CASE WHEN o_totalprice > 250000 THEN 'Offer' ELSE 'Applied' END AS status FROM orders")
def tracker_status_query(spark, sf):
    return tracker_status_by_number(_tracker_lines(spark, sf))


@query(
    "tracker_addition_merge",
    """WITH a AS (SELECT lower(c_name) AS c, o_orderpriority AS t, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS k, max(o_totalprice) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
o AS (SELECT lower(c_name) AS c, c_custkey, c_acctbal * 30 AS score FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT coalesce(o.c, a.c) AS company_lc, coalesce(a.t, '1-URGENT') AS title, o.c_custkey AS tracker_num, CASE WHEN o.c IS NULL OR a.score > o.score THEN a.score ELSE o.score END AS score,
 CASE WHEN a.c IS NOT NULL AND (o.c IS NULL OR a.score > o.score) THEN 'order ' || a.k ELSE 'old' END AS notes FROM o FULL JOIN a ON o.c = a.c AND a.t = '1-URGENT'""",
)
def tracker_addition_merge(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    additions = rows.select(
        F.upper("c_name").alias("company"), F.col("o_orderpriority").alias("title"), F.lit("Evaluated").alias("status"), F.col("o_totalprice").alias("score"),
        F.lit("").alias("report"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("notes"), F.col("o_orderkey").alias("ord"),
    )
    applications = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("tracker_num"), F.concat(F.lit(" "), "c_name").alias("company"), F.lit("1-urgent").alias("title"),
        F.lit("Evaluated").alias("status"), (F.col("c_acctbal") * 30).alias("score"), F.lit("").alias("report"), F.lit("old").alias("notes"),
    )
    merged = merge_additions(additions, applications, "ord")
    return merged.select(F.trim(F.lower("company")).alias("company_lc"), F.when(F.col("title") == "1-urgent", "1-URGENT").otherwise(F.col("title")).alias("title"), "tracker_num", "score", "notes")


# ── views ────────────────────────────────────────────────────────────


def _app_tables(spark, sf):
    null = F.lit(None).cast("string")
    number = F.col("o_custkey").cast("string")
    registry = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.lower("c_mktsegment").alias("company_key"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("title"),
        F.lit("").alias("apply_url"), F.concat(F.lit("https://x.org/"), F.col("c_custkey").cast("string")).alias("url"), F.lit("lever").alias("provider"),
        null.alias("location"), (F.col("c_acctbal") > 0).alias("has_body"),
    )
    applications = table(spark, sf, "orders").select(
        number.alias("key"), F.col("o_orderkey").alias("tracker_num"), F.when(F.col("o_orderpriority") == "1-URGENT", "own:key").otherwise("").alias("company_key"),
        F.when(F.col("o_orderstatus") == "P", "Own Co").otherwise("").alias("company"), null.alias("title"),
        F.when(F.col("o_totalprice") > 300000, "Interview").when(F.col("o_totalprice") > 100000, "Applied").otherwise("Rejected").alias("status"),
        F.to_date("o_orderdate").alias("date_applied"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://jobs.lever.co/f/"), number)).alias("apply_url"),
        F.lit("[3](reports/3-a.md)").alias("report"), F.struct(F.lit("Kim").alias("name"), null.alias("email")).alias("recruiter"), F.lit("").alias("confirmation"),
        F.col("o_orderpriority").alias("notes"),
    )
    return applications, registry


_VIEW_SQL = """v AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS tracker_num, CASE WHEN o_orderstatus = 'P' THEN 'Own Co' ELSE c_name END AS company, c_mktsegment AS title,
 CASE WHEN o_totalprice > 300000 THEN 'Interview' WHEN o_totalprice > 100000 THEN 'Applied' ELSE 'Rejected' END AS status, CAST(o_orderdate AS DATE) AS date_applied,
 CASE WHEN o_orderstatus = 'F' THEN 'https://jobs.lever.co/f/' || o_custkey ELSE 'https://x.org/' || o_custkey END AS apply_url, '3-a.md' AS report, c_acctbal > 0 AS has_body, o_orderpriority AS notes FROM orders JOIN customer ON o_custkey = c_custkey)"""
_VIEW_COLUMNS = ("key", "tracker_num", "company", "title", "status", "date_applied", "apply_url", "report", "has_body")


@query("applications_view", f"WITH {_VIEW_SQL} SELECT {', '.join(_VIEW_COLUMNS)} FROM v")
def applications_view_query(spark, sf):
    return applications_view(*_app_tables(spark, sf)).select(*_VIEW_COLUMNS)


@query("applications_newest", f"WITH {_VIEW_SQL} SELECT tracker_num, date_applied FROM v ORDER BY date_applied DESC NULLS LAST, tracker_num DESC LIMIT 50")
def applications_newest(spark, sf):
    """The first page of the view: its order decides which rows these are."""
    return applications_view(*_app_tables(spark, sf)).limit(50).select("tracker_num", "date_applied")


@query("application_search", f"WITH {_VIEW_SQL} SELECT tracker_num, status FROM v WHERE status IN ('Applied', 'Interview') AND contains(lower(company || ' ' || title || ' ' || status || ' ' || notes || ' Kim'), 'own co')")
def application_search(spark, sf):
    return search_applications(applications_view(*_app_tables(spark, sf)), "open", None, " OWN co ").select("tracker_num", "status")


@query("application_statuses", f"WITH {_VIEW_SQL} SELECT DISTINCT status FROM v")
def application_statuses(spark, sf):
    return _app_tables(spark, sf)[0].select("status").distinct().orderBy("status")


@query(
    "application_company_key",
    "SELECT o_orderkey AS tracker_num, CASE WHEN o_orderpriority = '1-URGENT' THEN 'own:key' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = o_custkey) WHEN o_orderstatus = 'F' THEN 'lever:f' ELSE 'unknown:' || o_custkey END AS company_key FROM orders",
)
def application_company_key(spark, sf):
    applications, registry = _app_tables(spark, sf)
    return with_company_key(applications, registry.where("has_body")).select("tracker_num", "company_key")


@query(
    "decision_sync",
    """SELECT p_partkey, CASE WHEN p_partkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') THEN 'applied' ELSE 'undecided' END AS decision FROM part""",
)
def decision_sync(spark, sf):
    number, customer = F.col("p_partkey").cast("string"), F.col("o_custkey").cast("string")
    personal = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("https://x.org/jobs/"), number).alias("key"), F.lit("undecided").alias("decision"), F.lit("").alias("last_reviewed"))
    applications = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://x.org/jobs/"), customer)).otherwise(F.concat(F.lit("https://other.org/?gh_jid="), customer)).alias("key"),
        F.when(F.col("o_orderstatus") == "P", "Evaluated").otherwise("Applied").alias("status"),
    )
    return sync_decisions(personal, applications).select("p_partkey", "decision")
