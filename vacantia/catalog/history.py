"""Dedup against history, registry merges, patches, timelines and other ordered rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keywords import location_passes, title_passes
from ..functions.urls import bare_host
from ..operators.dedup import OUTCOMES, first_wins_two_keys, scan_outcomes, seen_roles, seen_urls, unseen
from ..operators.patches import (
    LISTING_DECISIONS, apply_edits, check_edits, latest_values, merge_maps, merge_structs, patch_companies, upsert,
)
from ..operators.registry import (
    NEW, NEW_OR_PRIOR, PRIOR, PRIOR_TEXT_OR_NEW, merge_companies, merge_snapshot, refresh_listings, refresh_personal,
    register_companies, registry_counts, scan_to_listings,
)
from ..operators.sequence import far_from_accepted, far_from_previous, repost_signal, status_changes
from ..session import shared_dir
from ..sinks.bucketed import BucketedRegistry
from ..sinks.counters import write_counted
from ..sinks.tables import write_scan
from .registry import query, table
from .standins import COMPANIES_SQL, FACETS_SQL, STATUS_SQL, companies, event_status, facets
from .urls import HOST

# ── seen filters ─────────────────────────────────────────────────────

_LISTED_SQL = """listed AS (SELECT o_orderkey, 'u' || o_custkey AS url, upper(c_mktsegment) AS company, o_orderpriority || '/' || c_nationkey AS role, CAST(o_orderdate AS DATE) AS day, o_orderstatus
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _listed(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        "o_orderkey", F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.upper("c_mktsegment").alias("company"),
        F.concat_ws("/", "o_orderpriority", F.col("c_nationkey").cast("string")).alias("role"), F.to_date("o_orderdate").alias("day"), "o_orderstatus",
    )


def _history(spark, sf):
    old = _listed(spark, sf).where("day < DATE '1995-06-01'")
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    urls = seen_urls(old.where("o_orderstatus = 'F'").select("url"), poor)
    roles = seen_roles(old.where("o_orderstatus = 'P'"), "company", "role")
    return urls, roles


_HISTORY_SQL = f"""{_LISTED_SQL},
seen AS (SELECT url FROM listed WHERE day < DATE '1995-06-01' AND o_orderstatus = 'F' UNION SELECT 'u' || c_custkey FROM customer WHERE c_acctbal < 0),
roles AS (SELECT DISTINCT lower(company) AS c, lower(role) AS r FROM listed WHERE day < DATE '1995-06-01' AND o_orderstatus = 'P')"""


@query(
    "seen_filter",
    f"WITH {_HISTORY_SQL} SELECT o_orderkey, url FROM listed WHERE day >= DATE '1995-06-01' AND url NOT IN (SELECT url FROM seen) AND (lower(company), lower(role)) NOT IN (SELECT (c, r) FROM roles)",
)
def seen_filter(spark, sf):
    urls, roles = _history(spark, sf)
    new = _listed(spark, sf).where("day >= DATE '1995-06-01'")
    return unseen(new, urls, roles, "url", "company", "role").select("o_orderkey", "url")


@query("seen_sources_union", f"WITH {_HISTORY_SQL} SELECT url FROM seen")
def seen_sources_union(spark, sf):
    return _history(spark, sf)[0]


@query("seen_roles", f"WITH {_HISTORY_SQL} SELECT c AS company_lc, r AS role_lc FROM roles")
def seen_roles_query(spark, sf):
    return _history(spark, sf)[1]


_OUTCOME_SQL = """tagged AS (SELECT p_partkey, p_brand, p_name, p_type, p_retailprice, NOT (contains(p_name, 'old') OR contains(p_name, 'pin')) AS title_ok, p_type <> 'PROMO' AS place_ok,
 p_retailprice < 905 OR (p_brand, p_name) IN (SELECT (p_brand, p_name) FROM part WHERE p_size = 50) AS known FROM part),
ranked AS (SELECT *, title_ok AND place_ok AND NOT known AS open, row_number() OVER (PARTITION BY p_brand, p_name, title_ok AND place_ok AND NOT known ORDER BY p_partkey) AS rn FROM tagged),
outcomes AS (SELECT p_partkey, CASE WHEN NOT title_ok THEN 'skipped_title' WHEN NOT place_ok THEN 'skipped_location' WHEN known OR rn > 1 THEN 'skipped_dup' ELSE 'added' END AS outcome FROM ranked)"""


def _outcomes(spark, sf):
    part = table(spark, sf, "part").withColumn("url", F.col("p_partkey").cast("string"))
    urls = seen_urls(part.where("p_retailprice < 905").select("url"))
    roles = seen_roles(part.where("p_size = 50"), "p_brand", "p_name")
    return scan_outcomes(
        part, title_passes(F.col("p_name"), [], ["old", "pin"]), location_passes(F.col("p_type"), block=["promo"]),
        urls, roles, "url", "p_brand", "p_name", "p_partkey",
    )


@query("scan_outcomes", f"WITH {_OUTCOME_SQL} SELECT p_partkey, outcome FROM outcomes")
def scan_outcomes_query(spark, sf):
    return _outcomes(spark, sf).select("p_partkey", "outcome")


@query("scan_outcome_counts", f"WITH {_OUTCOME_SQL} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def scan_outcome_counts(spark, sf):
    """Counted by the job that writes the outcomes; nothing is read again."""
    counts = write_counted(_outcomes(spark, sf), f"{shared_dir(spark, 'outcomes')}/rows", "outcome", OUTCOMES)
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "outcome string, n long")


@query("scan_round_trip", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS n_rows, '1998-06-01' AS scanned_at FROM part")
def scan_round_trip(spark, sf):
    """A scan and its record, written side by side and read back."""
    path = f"{shared_dir(spark, 'scan')}/raw"
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    write_scan(rows, rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("scanned_at", F.lit("1998-06-01")), path)
    meta = spark.read.schema("n_rows long, scanned_at string").json(f"{path}/meta")
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    return back.withColumns({c: meta.select(c).scalar() for c in ("n_rows", "scanned_at")})


@query(
    "two_key_dedup",
    f"""WITH RECURSIVE r AS (SELECT page_id, {HOST.replace("{0}", "url")} AS u, substr(url, length(url) - 5, 2) AS k, row_number() OVER (ORDER BY page_id) AS rn FROM pages),
walk AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS us, []::VARCHAR[] AS ks, []::BIGINT[] AS kept UNION ALL
 SELECT r.rn, CASE WHEN hit THEN us ELSE list_append(us, u) END, CASE WHEN hit THEN ks ELSE list_append(ks, k) END, CASE WHEN hit THEN kept ELSE list_append(kept, page_id) END
 FROM (SELECT r.*, w.us, w.ks, w.kept, list_contains(w.us, r.u) OR list_contains(w.ks, r.k) AS hit FROM walk w JOIN r ON r.rn = w.rn + 1) r)
SELECT unnest(kept) AS page_id FROM walk WHERE rn = (SELECT count(*) FROM pages)""",
)
def two_key_dedup(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", bare_host(F.col("url")).alias("u"), F.substring("url", F.length("url") - 5, F.lit(2)).alias("k"))
    return first_wins_two_keys(rows, "u", ["k"], "page_id").select("page_id")


# ── snapshot merges ──────────────────────────────────────────────────
# Prior registry: orders up to 1997. Scan: orders from 1996 on, all of them urgent or high ones in
# the partial scan. A group is a customer's order priority together with the market segment.

_SNAP_SQL = """o AS (SELECT o_orderkey, c_mktsegment AS grp, o_orderpriority, o_totalprice, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey),
prior AS (SELECT o_orderkey, grp, o_totalprice AS price, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'old' END AS note, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'undecided' END AS decision,
 o_orderstatus <> 'O' AS live, day AS first_seen, DATE '1997-06-30' AS last_seen FROM o WHERE day < DATE '1997-07-01'),
scan AS (SELECT o_orderkey, grp, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice + 1 END AS price, 'new' AS note FROM o WHERE day >= DATE '1996-01-01' AND {0})"""
_MERGE_SQL = """SELECT coalesce(s.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(s.grp, p.grp) AS grp, CASE WHEN s.o_orderkey IS NULL THEN p.price ELSE coalesce(s.price, p.price) END AS price,
 CASE WHEN s.o_orderkey IS NULL THEN p.note ELSE coalesce(nullif(p.note, ''), s.note) END AS note, p.decision,
 CASE WHEN s.o_orderkey IS NOT NULL THEN true WHEN p.grp IN ({1}) THEN false ELSE p.live END AS live,
 CASE WHEN s.o_orderkey IS NULL THEN p.first_seen ELSE coalesce(p.first_seen, DATE '1997-12-31') END AS first_seen, CASE WHEN s.o_orderkey IS NULL THEN p.last_seen ELSE DATE '1997-12-31' END AS last_seen
 FROM prior p FULL JOIN scan s ON p.o_orderkey = s.o_orderkey"""


def _snapshots(spark, sf, scanned):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day, state = F.to_date("o_orderdate"), F.col("o_orderstatus")
    prior = o.where(day < F.lit("1997-07-01").cast("date")).select(
        "o_orderkey", F.col("c_mktsegment").alias("grp"), F.col("o_totalprice").alias("price"), F.when(state == "P", "").otherwise("old").alias("note"),
        F.when(state == "F", "kept").otherwise("undecided").alias("decision"), (state != "O").alias("live"), day.alias("first_seen"),
        F.lit("1997-06-30").cast("date").alias("last_seen"),
    )
    scan = o.where((day >= F.lit("1996-01-01").cast("date")) & scanned).select(
        "o_orderkey", F.col("c_mktsegment").alias("grp"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") + 1).alias("price"), F.lit("new").alias("note")
    )
    return prior, scan


_POLICY = {"grp": NEW, "price": NEW_OR_PRIOR, "note": PRIOR_TEXT_OR_NEW, "decision": PRIOR}


def _merge(spark, sf, scanned, groups=None):
    prior, scan = _snapshots(spark, sf, scanned)
    scanned_groups = None
    if groups:
        scanned_groups = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp")).where(F.col("grp").isin(*groups)).distinct()
    return merge_snapshot(prior, scan, "o_orderkey", "grp", _POLICY, scanned_groups, F.lit("1997-12-31").cast("date"))


@query("snapshot_merge", "WITH " + _SNAP_SQL.replace("{0}", "true") + _MERGE_SQL.replace("{1}", "SELECT grp FROM scan"))
def snapshot_merge(spark, sf):
    return _merge(spark, sf, F.lit(True))


@query("snapshot_merge_bucketed", "WITH " + _SNAP_SQL.replace("{0}", "true") + _MERGE_SQL.replace("{1}", "SELECT grp FROM scan"))
def snapshot_merge_bucketed(spark, sf):
    """The same with the registry as a bucketed table."""
    prior, scan = _snapshots(spark, sf, F.lit(True))
    root = shared_dir(spark, "bucketed")
    registry = BucketedRegistry(spark, f"registry_{uuid.uuid4().hex}", root, "o_orderkey", 8).write(prior, url_keys=False)
    return registry.merged(scan, "grp", _POLICY, scan_date=F.lit("1997-12-31").cast("date"))


@query(
    "snapshot_merge_partial",
    "WITH " + _SNAP_SQL.replace("{0}", "grp IN ('BUILDING', 'MACHINERY') AND o_orderpriority IN ('1-URGENT', '2-HIGH')") + _MERGE_SQL.replace("{1}", "SELECT grp FROM scan"),
)
def snapshot_merge_partial(spark, sf):
    urgent = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return _merge(spark, sf, urgent)


@query(
    "snapshot_merge_empty_board",
    "WITH " + _SNAP_SQL.replace("{0}", "grp = 'BUILDING'") + _MERGE_SQL.replace("{1}", "'BUILDING', 'FURNITURE'"),
)
def snapshot_merge_empty_board(spark, sf):
    """Furniture was scanned and came back empty: its rows expire, too."""
    return _merge(spark, sf, F.col("c_mktsegment") == "BUILDING", ["BUILDING", "FURNITURE"])


# The listing registry with all its columns. Prior: cheaper parts; scan: bigger parts, some twice.
_REG_SQL = f"""{FACETS_SQL},
reg_prior AS (SELECT 'https://x.example.org/' || p_partkey AS key, company_key, lower(title) AS title, 'https://apply.example.org/' || p_partkey AS apply_url, '1998-01-01' AS date_posted,
  CASE WHEN p_size > 25 THEN p_retailprice END AS pay, p_size > 10 AS has_body, p_type <> 'PROMO' AS live, DATE '1998-01-02' AS first_seen, DATE '1998-03-01' AS last_seen FROM facets WHERE p_retailprice < 960),
reg_scan AS (SELECT 'https://x.example.org/' || p_partkey AS key, CASE WHEN p_type = 'LARGE' THEN 'reg:' || company_key ELSE 'lever:' || lower(replace(company_key, '#', '')) END AS company_key, title,
  CASE WHEN p_size > 30 THEN 'https://new.example.org/' || p_partkey ELSE '' END AS apply_url, CASE WHEN p_type <> 'SMALL' THEN '1998-05-05' ELSE '' END AS date_posted,
  CASE WHEN p_size < 40 THEN p_retailprice * 2 END AS pay, p_size > 35 AS has_body FROM facets WHERE p_size > 15),
reg AS (SELECT coalesce(s.key, p.key) AS key, CASE WHEN s.key IS NULL THEN p.company_key ELSE s.company_key END AS company_key, coalesce(s.title, p.title) AS title,
  coalesce(nullif(s.apply_url, ''), p.apply_url, s.key) AS apply_url, coalesce(nullif(s.date_posted, ''), p.date_posted, '') AS date_posted, coalesce(s.pay, p.pay) AS pay,
  coalesce(s.has_body, false) OR coalesce(p.has_body, false) AS has_body, CASE WHEN s.key IS NOT NULL THEN true WHEN p.company_key IN (SELECT company_key FROM reg_scan) THEN false ELSE p.live END AS live,
  CASE WHEN s.key IS NULL THEN p.first_seen ELSE coalesce(p.first_seen, DATE '1998-06-01') END AS first_seen, CASE WHEN s.key IS NULL THEN p.last_seen ELSE DATE '1998-06-01' END AS last_seen
  FROM reg_prior p FULL JOIN reg_scan s ON p.key = s.key)"""

_COMP = "struct<min:double,max:double,currency:string,equity:boolean>"


def _registry_inputs(spark, sf):
    return registry_inputs_of(facets(spark, sf))


def registry_inputs_of(rows):
    """Prior registry and scanned listings made from parts with facets."""
    number, size, brand = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("company_key")
    url = F.concat(F.lit("https://x.example.org/"), number)
    pay = lambda v: F.struct(v.alias("min"), F.lit(None).cast("double").alias("max"), F.lit("CAD").alias("currency"), F.lit(None).cast("boolean").alias("equity"))
    prior = rows.where("p_retailprice < 960").select(
        url.alias("key"), brand.alias("company_key"), brand.alias("company"), F.lower("title").alias("title"), url.alias("url"),
        F.concat(F.lit("https://apply.example.org/"), number).alias("apply_url"), F.lit("").alias("location"), F.lit("").alias("department"),
        F.lit("lever").alias("provider"), F.lit("1998-01-01").alias("date_posted"), F.when(size > 25, pay(F.col("p_retailprice"))).alias("comp"),
        F.lit("").alias("employment_type_raw"), F.lit("1998-01-02").cast("date").alias("first_seen"), F.lit("1998-03-01").cast("date").alias("last_seen"),
        (F.col("p_type") != "PROMO").alias("live"), (size > 10).alias("has_body"), F.struct("seniority").alias("extracted"),
    )
    slug = F.lower(F.replace(brand, F.lit("#"), F.lit("")))
    board = F.concat(F.lit("https://jobs.lever.co/"), slug)
    board = F.when(F.col("p_type") == "LARGE", F.concat(F.lit("https://"), slug, F.lit(".example.com"))).otherwise(board)
    current = rows.where("p_size > 15").select(
        url.alias("url"), F.when(size > 30, F.concat(F.lit("https://new.example.org/"), number)).alias("apply_url"), "title", brand.alias("company"),
        F.lit(None).cast("string").alias("location"), F.when(size > 35, "<p>Body</p>").otherwise(" ").alias("description"), F.lit("R&D").alias("department"),
        F.when(F.col("p_type") != "SMALL", "1998-05-05").alias("date_posted"), F.when(size < 40, pay(F.col("p_retailprice") * 2)).alias("comp"),
        F.lit("full").alias("employment_type"), F.lit("lever").alias("provider"), board.alias("careers_url"), F.lit(1).alias("ord"),
    )
    stale = current.where("title LIKE '%gear'").withColumns({"title": F.lit("stale"), "ord": F.lit(0)})
    known = rows.where("p_type = 'LARGE'").select(
        F.concat(F.lit("reg:"), brand).alias("key"), F.concat(F.lit("https://"), slug, F.lit(".example.com")).alias("careers_url")
    ).distinct()
    return prior, scan_to_listings(current.unionByName(stale), known, "ord")


_DAY = "1998-06-01"


REFRESH_SQL = f"WITH {_REG_SQL} SELECT key, company_key, title, apply_url, date_posted, pay, has_body, live, first_seen, last_seen FROM reg"


@query("registry_refresh", REFRESH_SQL)
def registry_refresh(spark, sf):
    prior, listings = _registry_inputs(spark, sf)
    merged = refresh_listings(listings, prior, F.lit(_DAY).cast("date"))
    return merged.select("key", "company_key", "title", "apply_url", "date_posted", F.col("comp.min").alias("pay"), "has_body", "live", "first_seen", "last_seen")


_PERSONAL_SQL = f"""{_REG_SQL}, pp AS (SELECT key, 0.75e0 AS relevance_score, CASE WHEN has_body THEN 'shortlist' ELSE '' END AS decision FROM reg_prior),
applied AS (SELECT key FROM reg_scan WHERE title LIKE 'red%'),
fit AS (SELECT 'lever:' || lower(replace(company_key, '#', '')) AS company_key, max(company_fit) AS f FROM facets WHERE company_fit IS NOT NULL GROUP BY 1),
pers AS (SELECT r.key, CASE WHEN s.key IS NULL THEN pp.relevance_score ELSE 1e0 + 0e0 + CASE WHEN s.date_posted = '' THEN 0e0 ELSE 0.25e0 END + CASE WHEN f.f >= 4 THEN 0.5e0 WHEN f.f >= 3 THEN 0.25e0 ELSE 0e0 END END AS relevance_score,
 CASE WHEN r.key IN (SELECT key FROM applied) THEN 'applied' ELSE coalesce(nullif(pp.decision, ''), 'undecided') END AS decision
 FROM reg r LEFT JOIN reg_scan s ON r.key = s.key LEFT JOIN pp ON r.key = pp.key LEFT JOIN fit f ON s.company_key = f.company_key)"""


def _personal(spark, sf):
    prior, listings = _registry_inputs(spark, sf)
    registry = refresh_listings(listings, prior, F.lit(_DAY).cast("date"))
    before = prior.select(
        "key", F.lit(0.75).alias("relevance_score"), F.lit(None).cast("double").alias("rank"), F.lit(False).alias("hard_excluded"),
        F.when(F.col("has_body"), "shortlist").otherwise("").alias("decision"),
    )
    applications = listings.where("title LIKE 'red%'").select("key", F.lit("Applied").alias("status"))
    brands = facets(spark, sf).where("company_fit IS NOT NULL").groupBy("company_key").agg(F.max("company_fit").alias("company_fit"))
    fits = brands.select(F.concat(F.lit("lever:"), F.lower(F.replace("company_key", F.lit("#"), F.lit("")))).alias("company_key"), "company_fit")
    return registry, refresh_personal(registry, listings, before, applications, fits, F.lit(_DAY).cast("date"))


@query("personal_refresh", f"WITH {_PERSONAL_SQL} SELECT key, relevance_score, decision FROM pers")
def personal_refresh(spark, sf):
    return _personal(spark, sf)[1].select("key", "relevance_score", "decision")


@query(
    "registry_counters",
    f"WITH {_PERSONAL_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE NOT live) AS expired, count(*) FILTER (WHERE has_body) AS with_body, count(*) FILTER (WHERE decision = 'undecided') AS undecided FROM reg JOIN pers ON reg.key = pers.key",
)
def registry_counters(spark, sf):
    return registry_counts(*_personal(spark, sf))


# ── companies ────────────────────────────────────────────────────────

_SURVEY_SQL = """survey AS (SELECT lower(c_mktsegment) AS provider, c_custkey AS slug, CASE WHEN c_nationkey = 9 THEN 'Acme Consulting ' || c_custkey ELSE c_name END AS name, count(*) AS total,
 count(*) FILTER (WHERE o_totalprice > 200000) AS relevant, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) AS remote, c_nationkey = 11 AS broken, bool_or(o_orderstatus = 'P') AS lead
 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
cur AS (SELECT provider || ':' || slug AS key, *, CASE WHEN name LIKE 'Acme%' THEN 'consulting' ELSE 'unknown' END AS kind, remote + 0.5e0 * CASE WHEN lead THEN 1 ELSE 0 END + 0.01e0 * relevant AS rel FROM survey WHERE NOT broken AND relevant > 0),
before AS (SELECT lower(c_mktsegment) || ':' || c_custkey AS key, c_name AS name, CASE WHEN c_acctbal > 5000 THEN 'keep' WHEN c_acctbal < 0 THEN 'skip' ELSE 'undecided' END AS decision, CASE WHEN c_acctbal > 5000 THEN 4e0 END AS fit FROM customer WHERE c_nationkey > 7)"""


def _survey(spark, sf):
    o = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    big = F.col("o_totalprice") > 200000
    name = F.when(F.col("c_nationkey") == 9, F.concat(F.lit("Acme Consulting "), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return o.groupBy(F.lower("c_mktsegment").alias("provider"), F.col("c_custkey").cast("string").alias("slug"), name.alias("name"), "c_nationkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(big).alias("relevant"), F.count_if(big & (F.col("o_orderpriority") == "1-URGENT")).alias("remote_relevant"),
        F.array(F.when(F.bool_or(F.col("o_orderstatus") == "P"), "Lead engineer").otherwise("Engineer")).alias("samples"),
    ).withColumn("error", F.when(F.col("c_nationkey") == 11, "timeout")).drop("c_nationkey")


def _before(spark, sf):
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").where("c_nationkey > 7").select(
        F.concat_ws(":", F.lower("c_mktsegment"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("provider"),
        F.lit("").alias("careers_url"), F.lit(1.0).alias("relevance_score"), F.lit(False).alias("excluded_by_type"),
        F.when(balance > 5000, "keep").when(balance < 0, "skip").otherwise("undecided").alias("decision"), F.when(balance > 5000, 4.0).alias("fit"),
    )


def _company_merge(spark, sf):
    survey = _survey(spark, sf)
    urls = survey.select("provider", "slug", F.concat(F.lit("https://"), "slug", F.lit(".example.com")).alias("careers_url"))
    return merge_companies(survey, urls, _before(spark, sf))


@query(
    "company_merge",
    f"""WITH {_SURVEY_SQL} SELECT coalesce(c.key, b.key) AS key, coalesce(c.name, b.name) AS name, coalesce('https://' || c.slug || '.example.com', '') AS careers_url, coalesce(c.rel, 0e0) AS relevance_score,
 coalesce(c.kind = 'consulting', false) AS excluded_by_type, coalesce(b.decision, 'undecided') AS decision, b.fit, c.key IS NULL AS stale FROM cur c FULL JOIN before b ON c.key = b.key WHERE c.key IS NOT NULL OR b.decision <> 'undecided'""",
)
def company_merge(spark, sf):
    return _company_merge(spark, sf)[1].drop("provider")


@query("company_registry", f"WITH {_SURVEY_SQL} SELECT key, name, total, relevant, remote AS remote_relevant, kind AS company_type FROM cur")
def company_registry(spark, sf):
    return _company_merge(spark, sf)[0].select("key", "name", "total", "relevant", "remote_relevant", "company_type")


@query("company_type_counts", f"WITH {_SURVEY_SQL} SELECT kind AS company_type, count(*) AS n FROM cur GROUP BY 1")
def company_type_counts(spark, sf):
    return _company_merge(spark, sf)[0].groupBy("company_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "company_bulk_import",
    """WITH f AS (SELECT lower(n_name) AS provider, 's' || (s_suppkey // 2) AS slug, s_name AS name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT lower(n_name) || ':s' || (s_suppkey // 2) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 2000)
SELECT provider || ':' || slug AS key, arg_min(name, s_suppkey) AS name, 50e0 AS relevance_score, 'undecided' AS decision FROM f WHERE provider || ':' || slug NOT IN (SELECT key FROM k) GROUP BY 1""",
)
def company_bulk_import(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    slug = F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 2).cast("string"))
    found = s.select(F.lower("n_name").alias("provider"), slug.alias("slug"), F.col("s_name").alias("name"), F.lit("https://x").alias("careers_url"), "s_suppkey", "s_acctbal")
    known = found.where("s_acctbal < 2000").select(F.concat_ws(":", "provider", "slug").alias("key")).distinct()
    return register_companies(found, known, "s_suppkey")[0].select("key", "name", "relevance_score", "decision")


@query(
    "patch_merge",
    f"""WITH {COMPANIES_SQL}, q AS (SELECT 'c' || o_custkey AS key, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS rank, max(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS fit,
 CASE WHEN bool_or(o_totalprice > 480000) THEN 'staffing' WHEN bool_or(o_totalprice > 460000) THEN 'product' ELSE '' END AS kind FROM orders GROUP BY 1)
SELECT c.key, coalesce(q.rank, c.rank) AS rank, coalesce(q.fit, c.fit) AS fit, CASE WHEN coalesce(q.kind, '') = '' THEN excluded_by_type ELSE q.kind = 'staffing' END AS excluded_by_type FROM companies c LEFT JOIN q ON c.key = q.key""",
)
def patch_merge(spark, sf):
    price, urgency = F.col("o_totalprice"), F.col("o_orderpriority")
    patch = table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key")).agg(
        F.max(F.when(urgency == "1-URGENT", price)).alias("rank"), F.max(F.when(urgency == "2-HIGH", price)).alias("fit"),
        F.when(F.bool_or(price > 480000), "staffing").when(F.bool_or(price > 460000), "product").otherwise("").alias("company_type"),
    )
    rows = companies(spark, sf)
    research = rows.select("key", F.lit("unknown").alias("company_type"))
    return patch_companies(rows, research, patch)[0].select("key", "rank", "fit", "excluded_by_type")


@query(
    "facet_map_merge",
    """SELECT p_partkey, CASE WHEN p_size > 20 THEN CAST(p_size AS DOUBLE) WHEN p_type <> 'PROMO' THEN 1e0 END AS scope, CASE WHEN p_type <> 'PROMO' THEN 2e0 END AS wlb, CASE WHEN p_size > 20 AND p_size > 40 THEN 9e0 END AS level FROM part""",
)
def facet_map_merge(spark, sf):
    size = F.col("p_size").cast("double")
    old = F.when(F.col("p_type") != "PROMO", F.create_map(F.lit("scope"), F.lit(1.0), F.lit("wlb"), F.lit(2.0)))
    new = F.when(F.col("p_size") > 20, F.create_map(F.lit("scope"), size, F.lit("level"), F.when(F.col("p_size") > 40, 9.0)))
    rows = table(spark, sf, "part").select("p_partkey", merge_maps(old, new).alias("m"))
    return rows.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("scope", "wlb", "level")])


@query(
    "facet_struct_merge",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS seniority, CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size > 25 THEN p_size END ELSE p_size END AS yoe FROM part",
)
def facet_struct_merge(spark, sf):
    size = F.col("p_size")
    old = F.struct(F.col("p_brand").alias("seniority"), F.when(F.col("p_type") != "PROMO", size).alias("yoe"))
    new = F.struct(F.when(size > 25, F.col("p_type")).alias("seniority"), F.when((F.col("p_type") == "PROMO") & (size > 25), size).alias("yoe"))
    rows = table(spark, sf, "part").select("p_partkey", merge_structs(old, new, ["seniority", "yoe"]).alias("m"))
    return rows.select("p_partkey", "m.seniority", "m.yoe")


@query(
    "state_upsert",
    """WITH l AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS score FROM events GROUP BY 1),
s AS (SELECT c_custkey AS id, 'pending' AS status, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT coalesce(l.id, s.id) AS id, coalesce(l.status, s.status) AS status, coalesce(l.score, s.score) AS score FROM l FULL JOIN s ON l.id = s.id""",
)
def state_upsert(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("score"), "ts", "event_id")
    state = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit("pending").alias("status"), F.col("c_acctbal").alias("score"))
    return upsert(state, latest_values(events, ["id"], ["ts", "event_id"], ["status", "score"]), "id")


_EDITS_SQL = """edits AS (SELECT user_id AS k, event_id, CASE event_type WHEN 'click' THEN 'manual_score' WHEN 'error' THEN 'manual_score' ELSE 'decision' END AS field,
 CASE event_type WHEN 'signup' THEN 'shortlist' WHEN 'view' THEN 'skip' WHEN 'purchase' THEN 'bought' WHEN 'error' THEN '' ELSE CAST(CAST(floor(value) AS INT) AS VARCHAR) END AS value, value AS amount FROM events),
checked AS (SELECT *, CASE WHEN field = 'decision' THEN value IN ('shortlist', 'skip', 'applied', 'undecided') ELSE value = '' OR coalesce(TRY_CAST(value AS INT), -1) BETWEEN 0 AND 5 END AS ok FROM edits)"""


def _edits(spark, sf):
    kind = F.col("event_type")
    edits = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), "event_id", F.when(kind.isin("click", "error"), "manual_score").otherwise("decision").alias("field"),
        F.when(kind == "signup", "shortlist").when(kind == "view", "skip").when(kind == "purchase", "bought").when(kind == "error", "")
        .otherwise(F.floor("value").cast("int").cast("string")).alias("value"),
    )
    return check_edits(edits, LISTING_DECISIONS)


@query(
    "decision_edits",
    f"""WITH {_EDITS_SQL}, f AS (SELECT k, field, arg_max(value, event_id) AS value FROM checked WHERE ok GROUP BY 1, 2)
SELECT CAST(c_custkey AS VARCHAR) AS key, coalesce(d.value, 'undecided') AS decision, CASE WHEN m.k IS NULL THEN 1e0 WHEN m.value = '' THEN NULL ELSE CAST(m.value AS DOUBLE) END AS manual_score
FROM customer LEFT JOIN f d ON d.k = c_custkey AND d.field = 'decision' LEFT JOIN f m ON m.k = c_custkey AND m.field = 'manual_score'""",
)
def decision_edits(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit("undecided").alias("decision"), F.lit(1.0).alias("manual_score"))
    return apply_edits(rows, _edits(spark, sf)[0], ["event_id"])


@query("rejected_edits", f"WITH {_EDITS_SQL} SELECT event_id, field, value FROM checked WHERE NOT ok")
def rejected_edits(spark, sf):
    return _edits(spark, sf)[1].select("event_id", "field", "value")


@query(
    "upsert_last_write",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
)
def upsert_last_write(spark, sf):
    return latest_values(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


# ── ordered rules ────────────────────────────────────────────────────


@query(
    "status_timeline",
    f"""SELECT user_id, event_id, status FROM (SELECT user_id, event_id, {STATUS_SQL} AS status, lag({STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM status""",
)
def status_timeline(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", event_status().alias("status"))
    return status_changes(rows, "user_id", "ts", "event_id", "status").select("user_id", "event_id", "status")


@query(
    "duplicate_gap",
    "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) >= 14400000000",
)
def duplicate_gap(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return far_from_previous(rows, ["user_id"], "ts", "event_id", 4 * 3600).select("event_id")


@query(
    "duplicate_gap_accepted",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
nxt AS (SELECT a.user_id, a.event_id, a.rn, a.t, min(b.rn) AS next_rn FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t >= a.t + 14400000000 GROUP BY ALL),
walk AS (SELECT user_id, event_id, next_rn FROM nxt WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.next_rn FROM walk w JOIN nxt n ON n.user_id = w.user_id AND n.rn = w.next_rn)
SELECT event_id FROM walk""",
)
def duplicate_gap_accepted(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return far_from_accepted(rows, ["user_id"], "ts", "event_id", 4 * 3600).select("event_id")


@query(
    "repost_signal",
    """WITH d AS (SELECT c_mktsegment, c_nationkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS on_day FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w AS (SELECT *, CAST(sum(on_day) OVER (PARTITION BY c_mktsegment, c_nationkey, o_orderpriority ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM d)
SELECT *, in_window >= 2 AS reposted FROM w""",
)
def repost_signal_query(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return repost_signal(rows, ["c_mktsegment", "c_nationkey", "o_orderpriority"], F.to_date("o_orderdate"))


@query("first_last_seen", "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_seen, CAST(max(o_orderdate) AS DATE) AS last_seen FROM orders GROUP BY 1")
def first_last_seen(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_seen"), F.to_date(F.max("o_orderdate")).alias("last_seen"))
