"""Source readers and provider normalisers over payloads made from the given tables.

Each payload is one row's own small JSON document, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import landed
from ..sources import providers as pv
from .registry import query, table


def _text(c):
    return F.col(c).cast("string")


def _part_payloads(spark, sf, payload, careers_url):
    return table(spark, sf, "part").select(F.col("p_brand").alias("company"), careers_url.alias("careers_url"), payload.alias("payload"))


@query(
    "jsonl_scan",
    "SELECT o_orderkey, o_orderpriority AS title, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'",
)
def jsonl_scan(spark, sf):
    """Rows of JSON lines; orders with status P are cut lines, so they are kept apart."""
    line = F.to_json(F.struct("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price")))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("title", T.StringType()), T.StructField("price", T.DoubleType())])
    return landed.parse_jsonl(rows, schema)[0]


@query("jsonl_quarantine", "SELECT count(*) AS bad FROM orders WHERE o_orderstatus = 'P'")
def jsonl_quarantine(spark, sf):
    line = F.to_json(F.struct("o_orderkey"))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    bad = landed.parse_jsonl(rows, T.StructType([T.StructField("o_orderkey", T.LongType())]))[1]
    return bad.agg(F.count(F.lit(1)).alias("bad"))


@query("scan_with_meta", "SELECT url, 'Page ' || page_id AS title, 10.5e0 AS pay, DATE '2024-05-01' AS scanned_at FROM pages WHERE NOT contains(url, '/fr/')")
def scan_with_meta(spark, sf):
    """A raw scan: its meta record is one line among the rows; rows without a URL do not count."""
    row = F.struct(
        F.when(~F.col("url").contains("/fr/"), F.col("url")).alias("url"), F.concat(F.lit("Page "), _text("page_id")).alias("title"),
        F.struct(F.lit(10.5).alias("min")).alias("comp"),
    )
    meta = spark.createDataFrame([('{"_meta": {"scanned_at": "2024-05-01", "companies": ["A"], "partial": false}}',)], "value string")
    rows, meta = landed.split_scan(table(spark, sf, "pages").select(F.to_json(row).alias("value")).unionByName(meta))
    # One meta record per scan: a scalar, not a join.
    day = meta.agg(F.max("scanned_at")).scalar()
    return rows.select("url", "title", F.col("comp.min").alias("pay"), F.to_date(day).alias("scanned_at"))


@query(
    "history_scan",
    "SELECT o_orderkey, 'https://x.org/' || o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN 'Berlin' END AS location FROM orders",
)
def history_scan(spark, sf):
    """History lines with six or seven columns."""
    number = _text("o_orderkey")
    fields = F.concat_ws("\t", F.concat(F.lit("https://x.org/"), number), F.lit("2024-01-01"), F.lit("lever"), number, F.lit("Co"), F.lit("added"), F.when(F.col("o_orderstatus") == "F", "Berlin"))
    rows = table(spark, sf, "orders").select(F.from_csv(fields, landed.HISTORY.simpleString()[7:-1].replace(":", " "), {"sep": "\t"}).alias("h")).select("h.*")
    return rows.select(F.col("title").cast("long").alias("o_orderkey"), "url", "location")


@query(
    "checklist_items",
    "SELECT page_id, url, 'Co ' || page_id AS company, contains(url, '/en/') AS done FROM pages",
)
def checklist_items(spark, sf):
    mark = F.when(F.col("url").contains("/en/"), "x").otherwise(" ")
    line = F.concat(F.lit("- ["), mark, F.lit("] "), "url", F.lit(" | Co "), _text("page_id"), F.lit(" | "), _text("page_id"))
    return landed.checklist_items(table(spark, sf, "pages").select(line.alias("value"))).select(F.col("title").cast("long").alias("page_id"), "url", "company", "done")


@query(
    "company_csv",
    "SELECT lower(c_mktsegment) AS provider, c_name || ', Inc' AS name, 's' || c_custkey AS slug, 'https://x.org/' || c_custkey AS careers_url FROM customer WHERE c_acctbal > 0",
)
def company_csv(spark, sf):
    """Lines ``name,slug,url``, names with commas; lines without a slug are dropped."""
    slug = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("s"), _text("c_custkey"))).otherwise("")
    line = F.concat(F.lit('"'), "c_name", F.lit(', Inc",'), slug, F.lit(",https://x.org/"), _text("c_custkey"))
    return landed.company_lines(table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("provider"), line.alias("value")))


@query("careers_url_lookup", "SELECT lower(c_mktsegment) AS provider, CAST(c_nationkey AS VARCHAR) AS slug, max('https://x.org/' || c_custkey) AS careers_url FROM customer GROUP BY ALL")
def careers_url_lookup(spark, sf):
    rows = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("provider"), _text("c_nationkey").alias("slug"), F.concat(F.lit("https://x.org/"), _text("c_custkey")).alias("careers_url"))
    return landed.careers_urls(rows)


@query(
    "cached_feed",
    "SELECT 'Order ' || o_orderkey AS title, 'https://x.org/' || o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Remote' END AS location FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def cached_feed(spark, sf):
    """One JSON document per order with its jobs; jobs without a title do not count."""
    title = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit(" Order "), _text("o_orderkey")))
    job = F.struct(title.alias("title"), F.concat(F.lit("https://x.org/"), _text("o_orderkey")).alias("url"), F.when(F.col("o_orderstatus") != "F", "Remote").alias("location"))
    documents = table(spark, sf, "orders").select(F.to_json(F.struct(F.lit("2024").alias("fetched_at"), F.array(job).alias("jobs"))).alias("value"))
    return pv.cached_feed(landed.explode_jobs(documents)).select("title", "url", "location")


@query(
    "patch_rows",
    "SELECT 'c' || c_custkey AS key, CAST(c_nationkey AS DOUBLE) AS rank, CASE WHEN c_acctbal > 0 THEN 'fine' END AS reason, c_acctbal AS scope FROM customer",
)
def patch_rows(spark, sf):
    entry = F.struct(
        F.concat(F.lit("c"), _text("c_custkey")).alias("key"), F.col("c_nationkey").alias("rank"), F.when(F.col("c_acctbal") > 0, "fine").alias("reason"),
        F.create_map(F.lit("scope"), F.col("c_acctbal")).alias("dim_scores"),
    )
    files = table(spark, sf, "customer").select(F.to_json(F.array(entry)).alias("value"))
    rows = files.select(F.explode(F.from_json("value", T.ArrayType(landed.PATCH))).alias("p")).select("p.*")
    return rows.select("key", "rank", "reason", F.try_element_at("dim_scores", F.lit("scope")).alias("scope"))


@query("existing_names", "SELECT DISTINCT lower(c_mktsegment) AS name FROM customer")
def existing_names(spark, sf):
    return landed.existing_names(table(spark, sf, "customer"), "c_mktsegment")


# ── provider payloads: one board document per part ───────────────────


def _company_url(kind):
    return F.concat(F.lit(kind), _text("p_partkey"))


@query(
    "provider_greenhouse",
    "SELECT p_name AS title, 'https://boards.greenhouse.io/x/jobs/' || p_partkey AS url, p_brand AS company, CASE WHEN p_size > 10 THEN p_type ELSE '' END AS location, CASE WHEN p_size > 20 THEN 'Dept ' || p_size ELSE '' END AS department, CASE WHEN p_size > 30 THEN '2024-02-02' ELSE '2024-01-01' END AS date_posted FROM part WHERE p_retailprice > 910",
)
def provider_greenhouse(spark, sf):
    size = F.col("p_size")
    job = F.struct(
        F.col("p_name").alias("title"), F.when(F.col("p_retailprice") > 910, F.concat(F.lit("https://boards.greenhouse.io/x/jobs/"), _text("p_partkey"))).alias("absolute_url"),
        F.when(size > 10, F.struct(F.col("p_type").alias("name"))).alias("location"), F.lit("&lt;p&gt;").alias("content"),
        F.when(size > 20, F.array(F.struct(F.concat(F.lit("Dept "), _text("p_size")).alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("departments"),
        F.when(size > 30, "2024-02-02").alias("updated_at"), F.lit("2024-01-01").alias("first_published"),
    )
    payloads = _part_payloads(spark, sf, F.to_json(F.struct(F.array(job).alias("jobs"))), F.lit(""))
    return pv.normalize(payloads, "greenhouse").select("title", "url", "company", "location", "department", "date_posted")


@query(
    "provider_ashby",
    "SELECT p_name AS title, 'https://jobs.ashbyhq.com/a/' || p_partkey AS url, CASE WHEN p_size > 25 THEN p_type || ', ' ELSE '' END || p_brand || ', Remote' AS location, CASE WHEN p_size > 25 THEN 'remote' END AS remote_flag, p_retailprice AS pay, 'Team' AS department FROM part",
)
def provider_ashby(spark, sf):
    job = F.struct(
        F.col("p_name").alias("title"), F.concat(F.lit("https://jobs.ashbyhq.com/a/"), _text("p_partkey")).alias("jobUrl"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("location"),
        F.array(F.struct(F.col("p_brand").alias("location")), F.struct(F.lit("").alias("location")), F.struct(F.lit("Remote").alias("location"))).alias("secondaryLocations"),
        F.lit("").alias("department"), F.lit("Team").alias("team"), F.struct(F.col("p_retailprice").alias("min")).alias("compensation"), (F.col("p_size") > 25).alias("isRemote"),
    )
    rows = pv.normalize(_part_payloads(spark, sf, F.to_json(F.struct(F.array(job).alias("jobs"))), F.lit("")), "ashby")
    return rows.select("title", "url", "location", "remote_flag", F.col("comp.min").alias("pay"), "department")


@query(
    "provider_lever",
    "SELECT o_orderpriority AS title, 'https://jobs.lever.co/l/' || o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN 'remote, Paris' ELSE 'Berlin, remote, Paris' END AS location, strftime(o_orderdate, '%Y-%m-%d') AS date_posted FROM orders",
)
def provider_lever(spark, sf):
    place = F.when(F.col("o_orderstatus") != "F", "Berlin")
    job = F.struct(
        F.col("o_orderpriority").alias("text"), F.concat(F.lit("https://jobs.lever.co/l/"), _text("o_orderkey")).alias("hostedUrl"), F.lit("remote").alias("workplaceType"),
        F.struct(place.alias("location"), F.array(F.lit("Paris"), place, F.lit("remote")).alias("allLocations")).alias("categories"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createdAt"),
    )
    payloads = table(spark, sf, "orders").select(F.lit("L").alias("company"), F.lit("").alias("careers_url"), F.to_json(F.array(job)).alias("payload"))
    return pv.normalize(payloads, "lever").select("title", "url", "location", "date_posted")


@query(
    "provider_gem",
    "SELECT p_name AS title, 'https://jobs.gem.com/b' || p_partkey || '/e' || p_size AS url, p_type || ' • ' || p_brand AS location, 'Dept' AS department, 'full_time' AS employment_type FROM part",
)
def provider_gem(spark, sf):
    posting = F.struct(
        F.concat(F.lit("e"), _text("p_size")).alias("extId"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name"))).alias("locations"),
        F.struct(F.lit("full_time").alias("employmentType"), F.struct(F.lit("Dept").alias("name")).alias("department")).alias("job"),
    )
    payload = F.to_json(F.array(F.struct(F.struct(F.struct(F.array(posting).alias("jobPostings")).alias("oatsExternalJobPostings")).alias("data"))))
    rows = pv.normalize(_part_payloads(spark, sf, payload, _company_url("https://jobs.gem.com/b")), "gem")
    return rows.select("title", "url", "location", "department", "employment_type")


@query(
    "provider_bamboohr",
    "SELECT p_name AS title, 'https://co' || p_partkey || '.bamboohr.com/careers/' || p_size AS url, concat_ws(', ', CASE WHEN p_size > 25 THEN p_type END, 'CA') || CASE WHEN p_size > 40 OR p_type = 'PROMO' THEN ' Remote' ELSE '' END AS location FROM part WHERE p_retailprice > 910",
)
def provider_bamboohr(spark, sf):
    job = F.struct(
        F.col("p_size").alias("id"), F.when(F.col("p_retailprice") > 910, F.col("p_name")).otherwise("").alias("jobOpeningName"),
        F.struct(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("city"), F.lit("CA").alias("state")).alias("location"),
        F.when(F.col("p_size") > 40, "yes").otherwise("no").alias("isRemote"), F.struct((F.col("p_type") == "PROMO").alias("isRemote")).alias("atsLocation"),
    )
    careers = F.concat(F.lit("https://co"), _text("p_partkey"), F.lit(".bamboohr.com/careers"))
    return pv.normalize(_part_payloads(spark, sf, F.to_json(F.struct(F.array(job).alias("result"))), careers), "bamboohr").select("title", "url", "location")


@query(
    "provider_breezy",
    "SELECT p_name AS title, CASE WHEN p_size > 25 THEN 'https://own.org/' || p_partkey ELSE 'https://co.breezy.hr/p/f' || p_partkey END AS url, CASE WHEN p_size > 40 THEN 'HQ' ELSE p_type || ', DE' END || CASE WHEN p_size < 10 THEN ' Remote' ELSE '' END AS location FROM part",
)
def provider_breezy(spark, sf):
    size = F.col("p_size")
    job = F.struct(
        F.col("p_name").alias("name"), F.concat(F.lit("f"), _text("p_partkey")).alias("friendly_id"), F.when(size > 25, F.concat(F.lit("https://own.org/"), _text("p_partkey"))).alias("url"),
        F.struct(
            F.when(size > 40, "HQ").alias("name"), F.struct(F.col("p_type").alias("name")).alias("city"), F.struct(F.lit("DE").alias("name")).alias("country"), (size < 10).alias("is_remote"),
        ).alias("location"),
    )
    return pv.normalize(_part_payloads(spark, sf, F.to_json(F.array(job)), F.lit("https://co.breezy.hr")), "breezy").select("title", "url", "location")


@query(
    "provider_recruitee",
    "SELECT p_name AS title, CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN 'https://co.recruitee.com/o/' || p_partkey ELSE 'https://alt.recruitee.com/' END AS url, CASE WHEN p_type = 'PROMO' THEN 'Anywhere' ELSE concat_ws(', ', p_brand, CASE WHEN p_size < 30 THEN 'Remote' END) END AS location FROM part",
)
def provider_recruitee(spark, sf):
    size = F.col("p_size")
    own = F.when(size > 40, "http://evil.org/o").when(size > 20, F.concat(F.lit("https://co.recruitee.com/o/"), _text("p_partkey")))
    offer = F.struct(
        F.col("p_name").alias("title"), own.alias("careers_url"), F.lit("https://ALT.recruitee.com").alias("url"), F.col("p_brand").alias("city"), F.lit("").alias("country"),
        (size < 30).alias("remote"), F.when(F.col("p_type") == "PROMO", "Anywhere").alias("location"),
    )
    return pv.normalize(_part_payloads(spark, sf, F.to_json(F.struct(F.array(offer).alias("offers"))), F.lit("")), "recruitee").select("title", "url", "location")


@query(
    "provider_smartrecruiters",
    r"""SELECT p_name AS title, CASE WHEN p_size > 25 THEN 'https://jobs.smartrecruiters.com/co/postings/' || p_partkey WHEN p_size > 5 THEN 'https://jobs.smartrecruiters.com/' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') || '/' || p_partkey || '-' || replace(p_name, ' ', '-') ELSE '' END AS url,
 CASE WHEN p_type = 'PROMO' THEN 'Paris, France' ELSE p_type || ', CH' END || CASE WHEN p_size < 20 THEN ', Remote' ELSE '' END AS location FROM part""",
)
def provider_smartrecruiters(spark, sf):
    size, number = F.col("p_size"), _text("p_partkey")
    job = F.struct(
        F.when(size > 5, number).alias("id"), F.col("p_name").alias("name"),
        F.when(size > 25, F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/co/postings/"), number)).when(size > 15, "https://evil.org/v1/companies/x").alias("ref"),
        F.struct(F.when(F.col("p_type") == "PROMO", "Paris, France").alias("fullLocation"), F.col("p_type").alias("city"), F.lit("").alias("region"), F.lit("CH").alias("country"), (size < 20).alias("remote")).alias("location"),
    )
    return pv.normalize(_part_payloads(spark, sf, F.to_json(F.struct(F.array(job).alias("content"))), F.lit("")), "smartrecruiters").select("title", "url", "location")


@query(
    "provider_workable",
    "SELECT p_name AS title, 'https://apply.workable.com/co/jobs/view/' || p_partkey AS url, p_type AS location FROM part WHERE p_size BETWEEN 6 AND 40",
)
def provider_workable(spark, sf):
    number = _text("p_partkey")
    site = F.when(F.col("p_size") > 40, "https://evil.org").otherwise("https://apply.workable.com")
    cell = F.when(F.col("p_size") > 5, "[View]").otherwise("[Look]")
    line = F.concat(F.lit("| "), "p_name", F.lit(" | Dept | "), "p_type", F.lit(" | Full | | today | "), cell, F.lit("("), site, F.lit("/co/jobs/view/"), number, F.lit(".md) |"))
    payload = F.concat(F.lit("# Jobs\n| Title | Department | Location | Type | Salary | Posted | Details [View](x) |\n|---|---|\n"), line)
    return pv.normalize(_part_payloads(spark, sf, payload, F.lit("")), "workable").select("title", "url", "location")


@query(
    "provider_workday",
    "SELECT c_name AS company, arg_min(title, pos) AS title, 'https://t.wd1.myworkdayjobs.com/en-US/Site/job/' || path AS url FROM (SELECT c_name, o_custkey, o_orderpriority AS path, 'T' || o_orderkey AS title, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY c_name, path",
)
def provider_workday(spark, sf):
    """Pages of a board overlap: a path counts once, as its first page shows it."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    job = F.struct(F.concat(F.lit("T"), _text("o_orderkey")).alias("title"), F.concat(F.lit("/job/"), "o_orderpriority").alias("externalPath"), F.lit("Remote").alias("locationsText"))
    payload = F.to_json(F.struct(F.lit(1).alias("total"), F.array(job, F.struct(F.lit("x").alias("title"), F.lit("").alias("externalPath"), F.lit("").alias("locationsText"))).alias("jobPostings")))
    payloads = rows.select(F.col("c_name").alias("company"), F.lit("https://t.wd1.myworkdayjobs.com/en-US/Site").alias("careers_url"), payload.alias("payload"), F.col("o_orderkey").alias("page"))
    return pv.normalize(payloads, "workday").select("company", "title", "url")


@query(
    "provider_rippling",
    "SELECT p_name AS title, CASE WHEN p_size > 25 THEN 'https://ats.rippling.com/co/jobs/' || p_partkey ELSE 'https://own.org/' || p_partkey END AS url, p_type || ', US Remote; Berlin' AS location FROM part WHERE p_size > 5",
)
def provider_rippling(spark, sf):
    number, size = _text("p_partkey"), F.col("p_size")
    place = lambda city, country, kind: F.struct(city.alias("city"), F.lit("").alias("state"), country.alias("country"), kind.alias("workplaceType"))
    null = F.lit(None).cast("string")
    item = F.struct(
        F.when(size > 5, F.col("p_name")).alias("name"), F.when(size > 25, F.concat(F.lit("/co/jobs/"), number)).otherwise(F.concat(F.lit("https://own.org/"), number)).alias("url"),
        F.array(place(F.col("p_type"), F.lit("US"), F.lit("REMOTE")), place(F.lit("Berlin"), null, F.lit("ONSITE"))).alias("locations"),
    )
    wrap = lambda items: F.struct(F.struct(F.struct(items.alias("items")).alias("data")).alias("state"))
    empty = F.filter(F.array(item), lambda x: x["name"] == "-")
    queries = F.array(wrap(empty), wrap(F.array(item)))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(queries.alias("queries")).alias("dehydratedState")).alias("pageProps")).alias("props")))
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))
    return pv.normalize(_part_payloads(spark, sf, page, F.lit("https://ats.rippling.com/co/jobs")), "rippling").select("title", "url", "location")


@query(
    "provider_local_parser",
    "SELECT p_name AS title, CASE WHEN p_size > 25 THEN 'https://own.org/jobs/' || p_partkey ELSE 'https://abs.org/' || p_partkey END AS url, CASE WHEN p_size > 40 THEN 'Inc' ELSE p_brand END AS company, CASE WHEN p_size > 25 THEN p_type ELSE p_type || ', Remote' END AS location FROM part",
)
def provider_local_parser(spark, sf):
    number, size = _text("p_partkey"), F.col("p_size")
    one = F.to_json(F.array(F.struct(F.concat(F.lit(" "), "p_name").alias("title"), F.concat(F.lit("/jobs/"), number).alias("url"), F.when(size > 40, "Inc").alias("company"), F.col("p_type").alias("location"))))
    other = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("https://abs.org/"), number).alias("apply_url"), F.array(F.col("p_type"), F.lit("Remote")).alias("locations"))).alias("results")))
    payloads = _part_payloads(spark, sf, F.when(size > 25, one).otherwise(other), F.lit("https://own.org/careers"))
    return pv.normalize(payloads, "local-parser").select("title", "url", "company", "location")


@query(
    "provider_normalize",
    "SELECT CASE WHEN p_size > 25 THEN 'breezy' ELSE 'recruitee' END AS provider, count(*) AS n FROM part GROUP BY 1",
)
def provider_normalize(spark, sf):
    """A mixed payload table: every row goes to its own provider's normaliser."""
    breezy = F.to_json(F.array(F.struct(F.col("p_name").alias("name"), _text("p_partkey").alias("friendly_id"))))
    recruitee = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"))).alias("offers")))
    big = F.col("p_size") > 25
    rows = table(spark, sf, "part").select(
        F.when(big, "breezy").otherwise("recruitee").alias("provider"), F.col("p_brand").alias("company"), F.lit("https://co.breezy.hr").alias("careers_url"),
        F.when(big, breezy).otherwise(recruitee).alias("payload"),
    )
    return pv.normalize_all(rows).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query(
    "public_feeds",
    "SELECT s_name AS company_name, 'Remote only' AS title, n_name AS location FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, 'General', CASE WHEN s_acctbal > 5000 THEN n_name || ' Remote' WHEN s_acctbal > 3000 THEN 'Remote' ELSE n_name END FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def public_feeds(spark, sf):
    from ..operators.feeds import union_feeds

    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    first = F.struct(F.col("s_name").alias("company_name"), F.lit("Remote only").alias("title"), F.col("n_name").alias("candidate_required_location"))
    balance = F.col("s_acctbal")
    place = F.when((balance > 5000) | (balance <= 3000), F.col("n_name"))
    second = F.struct(F.col("s_name").alias("company_name"), F.lit("General").alias("title"), place.alias("location"), (balance > 3000).alias("remote"))
    a = pv.remote_feed(rows.select(F.to_json(F.struct(F.array(first).alias("jobs"))).alias("payload")))
    b = pv.flagged_feed(rows.select(F.to_json(F.struct(F.array(second).alias("data"))).alias("payload")))
    return union_feeds(a, b).select("company_name", "title", "location")


@query("directory_feed", "SELECT c_name || ' & Sons' AS name, 'https://d.org/' || c_custkey AS url FROM customer")
def directory_feed(spark, sf):
    rendered = F.concat("c_name", F.when(F.col("c_acctbal") > 0, " &#038; Sons").otherwise(" &amp; Sons "))
    entry = F.struct(F.struct(rendered.alias("rendered")).alias("title"), F.concat(F.lit("https://d.org/"), _text("c_custkey")).alias("link"))
    return pv.directory(table(spark, sf, "customer").select(F.to_json(F.array(entry)).alias("payload")))
