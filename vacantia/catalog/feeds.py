"""Feeds to candidate companies, batches of work, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keywords import clean_exclusions
from ..operators import feeds as fd
from ..operators.matching import search_grid
from ..operators.patches import upsert
from ..sinks.tables import essay_rows, history_rows, pending_lines, snapshots
from ..sources.landed import batch_state_types, names_in_list
from .registry import query, table
from .standins import COMPANIES_SQL, companies

# Feed rows: order lines joined with their parts; the company is the supplier.
_FEED_SQL = """feed AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN upper(s_name) ELSE s_name END AS company_name, p_name AS title, l_returnflag AS description, p_type AS location, l_linestatus AS tag
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
cand AS (SELECT *, CASE WHEN contains(lower(company_name), '0007') OR contains(title, '0007') THEN '0007' WHEN contains(title, 'blue pin') THEN 'Blue Pin' WHEN contains(lower(tag), 'zz') THEN 'zz' END AS matched FROM feed
 WHERE (contains(title, 'pin') OR contains(title, 'gear')) AND NOT contains(title, 'old') AND location <> 'PROMO'
 AND lower(company_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_acctbal < 500) AND lower(company_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_acctbal > 8500))"""


def _candidates(spark, sf):
    suppliers = table(spark, sf, "supplier")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = lines.join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(
        suppliers.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    feed = rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_returnflag") == "R", F.upper("s_name")).otherwise(F.col("s_name")).alias("company_name"),
        F.col("p_name").alias("title"), F.col("l_returnflag").alias("description"), F.col("p_type").alias("location"), F.lit("https://x").alias("url"), F.array("l_linestatus").alias("tags"),
    )
    existing = suppliers.where("s_acctbal < 500").select(F.col("s_name").alias("name"))
    skipped = suppliers.where("s_acctbal > 8500").select(F.col("s_name").alias("name"), F.lit("skip").alias("decision"))
    exclusions = clean_exclusions(["0007", "[FILL IN]", "Blue Pin", None, "zz"])
    return fd.candidate_jobs(feed, ["pin", "gear"], ["old"], {"block": ["promo"]}, exclusions, existing, skipped)


@query("feed_candidates", f"WITH {_FEED_SQL} SELECT ord, title, matched AS exclusion_matched FROM cand")
def feed_candidates(spark, sf):
    return _candidates(spark, sf).select("ord", "title", "exclusion_matched")


@query(
    "feed_companies",
    f"WITH {_FEED_SQL} SELECT lower(company_name) AS company_lc, arg_min(company_name, ord) AS name, count(*) AS n_jobs, min(ord) AS first_seen_at FROM cand WHERE matched IS NULL GROUP BY 1",
)
def feed_companies(spark, sf):
    return fd.group_companies(_candidates(spark, sf).where("exclusion_matched IS NULL"), "ord")[0]


@query(
    "feed_company_limit",
    f"WITH {_FEED_SQL}, g AS (SELECT lower(company_name) AS company_lc, min(ord) AS o, count(*) AS n_jobs FROM cand WHERE matched IS NULL GROUP BY 1) SELECT company_lc, n_jobs FROM g ORDER BY o LIMIT 15",
)
def feed_company_limit(spark, sf):
    found = fd.group_companies(_candidates(spark, sf).where("exclusion_matched IS NULL"), "ord")[0]
    return found.orderBy("first_seen_at").limit(15).select("company_lc", "n_jobs")


@query(
    "feed_first_jobs",
    f"WITH {_FEED_SQL} SELECT ord, lower(company_name) AS company_lc, CAST(rn AS INT) AS job_rank FROM (SELECT *, row_number() OVER (PARTITION BY lower(company_name) ORDER BY ord) AS rn FROM cand WHERE matched IS NULL) WHERE rn <= 2",
)
def feed_first_jobs(spark, sf):
    return fd.group_companies(_candidates(spark, sf).where("exclusion_matched IS NULL"), "ord")[1].select("ord", "company_lc", "job_rank")


@query(
    "exclusion_log",
    f"WITH {_FEED_SQL} SELECT arg_min(company_name, ord) AS name, arg_min(matched, ord) AS exclusion_matched, DATE '2024-02-01' AS date_added FROM cand WHERE matched IS NOT NULL AND lower(company_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_nationkey = 3) GROUP BY lower(company_name)",
)
def exclusion_log(spark, sf):
    log = table(spark, sf, "supplier").where("s_nationkey = 3").select(F.upper("s_name").alias("name"))
    return fd.log_exclusions(log, _candidates(spark, sf), "ord", F.lit("2024-02-01").cast("date"))


@query("feed_union", "SELECT 'part' AS feed, p_name AS title, CAST(NULL AS VARCHAR) AS remote FROM part UNION ALL SELECT 'order', o_orderpriority, o_orderstatus FROM orders")
def feed_union(spark, sf):
    first = table(spark, sf, "part").select(F.lit("part").alias("feed"), F.col("p_name").alias("title"))
    second = table(spark, sf, "orders").select(F.lit("order").alias("feed"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("remote"))
    return fd.union_feeds(first, second)


@query("new_company_names", "SELECT c_name AS name FROM customer WHERE lower(c_name) NOT IN (SELECT lower('customer#' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 9, '0')) FROM supplier)")
def new_company_names(spark, sf):
    existing = table(spark, sf, "supplier").select(F.concat(F.lit(" CUSTOMER#"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")).alias("name"))
    return fd.new_companies(table(spark, sf, "customer").select(F.col("c_name").alias("name")), existing)


@query("names_in_list", "SELECT DISTINCT lower(p_brand) AS name FROM part")
def names_in_list_query(spark, sf):
    lines = table(spark, sf, "part").select(F.concat(F.lit('  - name: "'), "p_brand", F.lit('"  ')).alias("value"))
    return names_in_list(lines.unionByName(table(spark, sf, "part").select(F.concat(F.lit("    notes: "), "p_name").alias("value"))))


@query(
    "company_entries",
    f"""WITH {COMPANIES_SQL} SELECT name, careers_url, rank IS NOT NULL AS enabled, CASE WHEN rank IS NOT NULL THEN 'added by board lookup (' || provider || ', ' || remote_relevant || ' live jobs' || coalesce(', fit ' || CAST(fit AS VARCHAR) || '/5', '') || ')'
 WHEN careers_url IS NULL THEN 'added from feeds (unresolved, no careers page)' ELSE 'added from feeds (unsupported: unsupported, careers page saved)' END AS notes FROM companies WHERE (fit IS NULL OR fit >= 3) AND c_mktsegment <> 'BUILDING'""",
)
def company_entries(spark, sf):
    rows = companies(spark, sf)
    resolved = rows.withColumns({"resolved": F.col("rank").isNotNull(), "count": F.col("remote_relevant")})
    existing = rows.where("c_mktsegment = 'BUILDING'").select(F.lower("name").alias("name"))
    return fd.company_entries(resolved, existing, 3.0).drop("provider")


@query("min_fit_gate", f"WITH {COMPANIES_SQL} SELECT key FROM companies WHERE fit IS NULL OR fit >= 4")
def min_fit_gate(spark, sf):
    return companies(spark, sf).where(fd.fit_passes(F.col("fit"), 4.0)).select("key")


@query("uncovered_hits", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def uncovered_hits(spark, sf):
    hits = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" ")).alias("company"))
    parsed = table(spark, sf, "customer").where("c_acctbal > 3000").select(F.upper("c_name").alias("name"))
    return fd.uncovered_hits(hits, parsed).select("o_orderkey")


@query("search_grid", "SELECT n_name AS site, unnest(['backend', 'data']) AS term, l.x AS location FROM nation, (SELECT unnest(['Remote', 'Toronto', 'Berlin']) AS x) l")
def search_grid_query(spark, sf):
    return search_grid(["backend", "data"], ["Remote", "Toronto", "Berlin"], table(spark, sf, "nation").select(F.col("n_name").alias("site")))


# ── batches ──────────────────────────────────────────────────────────
# Input: orders as items to work on. State: lines of those orders.

_STATE_SQL = """st AS (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 40) THEN 'failed' WHEN bool_or(l_discount > 0.08) THEN 'completed' ELSE 'processing' END AS status,
 count(*) FILTER (WHERE l_returnflag = 'R') AS retries, max(CASE WHEN l_tax > 0.04 THEN l_quantity / 10 END) AS score FROM lineitem GROUP BY 1)"""


def _state(spark, sf):
    flag = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.when(F.bool_or(flag & (F.col("l_quantity") > 40)), "failed").when(F.bool_or(F.col("l_discount") > 0.08), "completed").otherwise("processing").alias("status"),
        F.count_if(flag).alias("retries"), F.max(F.when(F.col("l_tax") > 0.04, F.col("l_quantity") / 10)).alias("score"),
    )


def _todo(spark, sf):
    number = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("x"), number)).otherwise(number).alias("id"),
        F.when(F.col("o_totalprice") > 20000, F.concat(F.lit("https://x.org/"), number)).alias("url"), "o_orderkey",
    )


_TODO_WHERE = "o_orderpriority <> '5-LOW' AND o_totalprice > 20000 AND o_orderkey >= 1000"


@query("pending_selection", f"WITH {_STATE_SQL} SELECT o_orderkey FROM orders LEFT JOIN st ON l_orderkey = o_orderkey WHERE {_TODO_WHERE} AND coalesce(status, '') <> 'completed' AND NOT coalesce(status = 'failed' AND retries >= 2, false)")
def pending_selection(spark, sf):
    return fd.pending_work(_todo(spark, sf), _state(spark, sf), 2, start_from=1000).select("o_orderkey")


@query("pending_retry_selection", f"WITH {_STATE_SQL} SELECT o_orderkey FROM orders JOIN st ON l_orderkey = o_orderkey WHERE {_TODO_WHERE} AND status = 'failed' AND retries < 3")
def pending_retry_selection(spark, sf):
    return fd.pending_work(_todo(spark, sf), _state(spark, sf), 3, retry_failed=True, start_from=1000).select("o_orderkey")


@query(
    "batch_summary",
    f"""WITH {_STATE_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'processing') AS pending,
 count(score) FILTER (WHERE status = 'completed') AS scored, round(avg(score) FILTER (WHERE status = 'completed'), 6) AS mean_score FROM st""",
)
def batch_summary(spark, sf):
    return fd.batch_summary(_state(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query("score_gate", f"WITH {_STATE_SQL} SELECT l_orderkey, CASE WHEN score < 3 THEN 'skipped' ELSE 'completed' END AS status FROM st")
def score_gate(spark, sf):
    return _state(spark, sf).select(F.col("id").cast("long").alias("l_orderkey"), fd.gate_score(F.col("score"), 3.0).alias("status"))


@query("next_number", "SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(c_custkey) FROM customer)) + 1 AS next_number")
def next_number(spark, sf):
    return fd.next_number((table(spark, sf, "orders"), "o_orderkey"), (table(spark, sf, "customer").withColumn("t", F.col("c_custkey").cast("string")), "t"))


@query(
    "batch_state_upsert",
    f"""WITH {_STATE_SQL} SELECT coalesce(CAST(l_orderkey AS VARCHAR), id) AS id, coalesce(status, 'completed') AS status, CAST(coalesce(retries, 0) AS INT) AS retries, coalesce(st.score, 4.5e0) AS score
FROM st FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT') o ON o.id = CAST(l_orderkey AS VARCHAR) WHERE id IS NOT NULL OR score IS NOT NULL""",
)
def batch_state_upsert(spark, sf):
    old = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("completed").alias("status"), F.lit("-").alias("retries"), F.lit("4.5").alias("score")
    )
    state = batch_state_types(old.withColumn("retries", F.nullif("retries", F.lit("-"))))
    merged = upsert(state.withColumn("known", F.lit(True)), _state(spark, sf).withColumn("retries", F.col("retries").cast("int")), "id")
    return merged.where("known OR score IS NOT NULL").select("id", "status", F.coalesce("retries", F.lit(0)).alias("retries"), F.coalesce("score", F.lit(4.5)).alias("score"))


# ── exports ──────────────────────────────────────────────────────────


def _page_offers(spark, sf):
    return table(spark, sf, "pages").select("url", F.lit("lever-api").alias("source"), F.lit("Engineer").alias("title"), F.concat(F.lit("Co "), F.col("page_id").cast("string")).alias("company"), F.lit(None).cast("string").alias("location"))


@query("history_rows", "SELECT url, DATE '2024-03-01' AS first_seen, 'lever-api' AS portal, 'Engineer' AS title, 'Co ' || page_id AS company, CASE WHEN contains(url, '/en/') THEN 'added' ELSE 'skipped_expired' END AS status, '' AS location FROM pages")
def history_rows_query(spark, sf):
    status = F.when(F.col("url").contains("/en/"), "added").otherwise("skipped_expired")
    return history_rows(_page_offers(spark, sf), F.lit("2024-03-01").cast("date"), status)


@query("pending_lines", "SELECT '- [ ] ' || url || ' | Co ' || page_id || ' | Engineer' AS value FROM pages")
def pending_lines_query(spark, sf):
    return pending_lines(_page_offers(spark, sf))


def _submissions(spark, sf):
    value = F.when(F.col("turn") > 0, F.col("text"))
    answer = lambda label, kind, v: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"), v.alias("value"))
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.lit("Acme").alias("company"), F.lit("Engineer").alias("title"),
        F.array(answer("First name", "text", F.col("role")), answer("Why us?", "text", value), answer("Notes", "textarea", F.col("role"))).alias("fields"),
        F.when(F.col("role") == "user", F.col("text")).alias("snapshot"), F.lit("2024-01-05").alias("submitted_at"),
    )


@query(
    "essay_answers",
    """SELECT conv_id || '-' || turn AS key, 'Why us?' AS question, text AS answer FROM conversations WHERE turn > 0 AND trim(text) <> '' UNION ALL SELECT conv_id || '-' || turn, 'Notes', role FROM conversations""",
)
def essay_answers(spark, sf):
    return essay_rows(_submissions(spark, sf), F.lit("2024-01-05").cast("date")).select("key", "question", "answer")


@query("submission_snapshots", "SELECT conv_id || '-' || turn AS key, text AS snapshot FROM conversations WHERE role = 'user' AND text <> ''")
def submission_snapshots(spark, sf):
    return snapshots(_submissions(spark, sf)).select("key", "snapshot")
