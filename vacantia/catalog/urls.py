"""URL normalisation, keys, dedup and guards over pages and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators.dedup import first_wins, last_wins
from ..operators.feeds import counts_by
from ..sinks.tables import body_file
from ..sources.landed import checklist_urls, urls_in_lines
from .registry import query, table

# The pages' URLs have a fragment, one query and no port, which keeps this form readable.
CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '#.*$', ''), '://www\.', '://'), '([?&])(utm_[a-z]*|ref)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/+$', '')"""
HOST = r"regexp_replace(lower(regexp_extract({0}, '^https?://([^/?#]+)', 1)), '^www\.', '')"


def canon(c: str) -> str:
    return CANON.replace("{0}", c)


def host(c: str) -> str:
    return HOST.replace("{0}", c)


@query("canonical_url", f"SELECT page_id, {canon('url')} AS canonical FROM pages")
def canonical_url(spark, sf):
    return u.with_url_keys(table(spark, sf, "pages").select("page_id", "url"), {"canonical": F.col("url")}).select("page_id", "canonical")


# All steps at once: upper-case host, default port, tracking parameter first and last, form page.
_NOISY = (
    "'HTTPS://WWW.' || upper(regexp_extract(url, '^https?://([^/?#]+)', 1)) || ':443' || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) "
    "|| CASE WHEN right(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), 1) = '/' THEN '' ELSE '/' END || 'apply/?utm_medium=x&gh_jid=' || CAST(page_id AS VARCHAR) || '&source=y#apply'"
)


@query(
    "canonical_url_steps",
    f"SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') "
    "|| '?gh_jid=' || CAST(page_id AS VARCHAR) AS canonical, CAST(page_id AS VARCHAR) AS listing_id FROM pages",
)
def canonical_url_steps(spark, sf):
    site = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    route = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    slash = F.when(route.endswith("/"), "").otherwise("/")
    noisy = F.concat(
        F.lit("HTTPS://WWW."), F.upper(site), F.lit(":443"), route, slash, F.lit("apply/?utm_medium=x&gh_jid="),
        F.col("page_id").cast("string"), F.lit("&source=y#apply"),
    )
    rows = table(spark, sf, "pages").select("page_id", noisy.alias("noisy"))
    return u.with_url_keys(rows, {"canonical": F.col("noisy")}, {"listing_id": F.col("noisy")}).select("page_id", "canonical", "listing_id")


@query(
    "embedded_form_url",
    "SELECT p_partkey, 'https://job-boards.greenhouse.io/' || lower(replace(p_brand, '#', '')) || '/jobs/' || CAST(p_partkey AS VARCHAR) AS canonical FROM part",
)
def embedded_form_url(spark, sf):
    raw = F.concat(
        F.lit("https://boards.greenhouse.io/embed/job_app?for="), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("&token="),
        F.col("p_partkey").cast("string"), F.lit("&utm_source=feed"),
    )
    return table(spark, sf, "part").select("p_partkey", u.canonical_url(raw).alias("canonical"))


@query(
    "listing_id",
    r"SELECT page_id, CASE WHEN contains(url, '/en/') THEN regexp_extract(url, '/en/(\d+)', 1) ELSE '' END AS listing_id FROM pages",
)
def listing_id(spark, sf):
    job_url = F.regexp_replace("url", "/en/", "/jobs/")
    return table(spark, sf, "pages").select("page_id", u.listing_id(job_url).alias("listing_id"))


@query("url_host_profile", f"SELECT {host('url')} AS host, CASE WHEN contains({host('url')}, 'm.th') THEN 'mobile' ELSE 'unsupported' END AS platform, count(*) AS n FROM pages GROUP BY ALL")
def url_host_profile(spark, sf):
    hosts = (*u.PLATFORM_HOSTS, ("m.th", "mobile"))
    rows = table(spark, sf, "pages").select(u.bare_host(F.col("url")).alias("host"), u.platform(F.regexp_replace("url", r"://www\.", "://"), hosts).alias("platform"))
    return rows.groupBy("host", "platform").agg(F.count(F.lit(1)).alias("n"))


@query("url_dedup_latest", f"SELECT {host('url')} AS host, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM pages GROUP BY 1")
def url_dedup_latest(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", u.bare_host(F.col("url")).alias("host"))
    return last_wins(rows, ["host"], ["page_id"])


@query("url_dedup_first", f"SELECT {canon('url')} AS canonical, min(page_id) AS page_id FROM pages GROUP BY 1")
def url_dedup_first(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", u.canonical_url(F.col("url")).alias("canonical"))
    return first_wins(rows, ["canonical"], ["page_id"])


# Board URLs for every customer, by market segment.
_BOARD_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN 'https://job-boards.greenhouse.io/' || slug || '/jobs' WHEN 'MACHINERY' THEN 'https://jobs.ashbyhq.com/' || upper(slug)
 WHEN 'HOUSEHOLD' THEN 'https://' || slug || '.recruitee.com/' WHEN 'FURNITURE' THEN 'https://www.' || slug || '.example.com/careers' ELSE 'https://jobs.lever.co/' || slug END"""
_SLUG_SQL = "replace(lower(c_name), '#', '-')"


def customer_slug():
    return F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))


def customer_board(slug=None):
    slug = customer_slug() if slug is None else slug
    segment = F.col("c_mktsegment")
    return (
        F.when(segment == "BUILDING", F.concat(F.lit("https://job-boards.greenhouse.io/"), slug, F.lit("/jobs")))
        .when(segment == "MACHINERY", F.concat(F.lit("https://jobs.ashbyhq.com/"), F.upper(slug)))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("https://"), slug, F.lit(".recruitee.com/")))
        .when(segment == "FURNITURE", F.concat(F.lit("https://www."), slug, F.lit(".example.com/careers")))
        .otherwise(F.concat(F.lit("https://jobs.lever.co/"), slug))
    )


@query(
    "company_key_derive",
    f"""WITH s AS (SELECT c_custkey, c_mktsegment, {_SLUG_SQL} AS slug FROM customer)
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse:' || slug WHEN 'MACHINERY' THEN 'ashby:' || slug WHEN 'HOUSEHOLD' THEN 'recruitee:' || slug
 WHEN 'FURNITURE' THEN 'unknown:' || slug || '.example.com' ELSE 'lever:' || slug END AS company_key,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse:' || slug ELSE 'greenhouse:' || CASE c_mktsegment WHEN 'MACHINERY' THEN 'jobs.ashbyhq.com' WHEN 'HOUSEHOLD' THEN slug || '.recruitee.com'
 WHEN 'FURNITURE' THEN slug || '.example.com' ELSE 'jobs.lever.co' END END AS stated_key FROM s""",
)
def company_key_derive(spark, sf):
    board = customer_board()
    return table(spark, sf, "customer").select(
        "c_custkey", u.company_key(F.lit(None).cast("string"), board).alias("company_key"),
        u.company_key(F.lit("greenhouse"), board).alias("stated_key"),
    )


@query(
    "platform_detect",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' WHEN 'HOUSEHOLD' THEN 'recruitee' WHEN 'FURNITURE' THEN 'unsupported' ELSE 'lever' END AS platform FROM customer",
)
def platform_detect(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", u.platform(customer_board()).alias("platform"))


@query(
    "slug_candidates",
    r"""
WITH s AS (SELECT s_suppkey, lower(replace(s_name, '#', ' ') || ' labs') AS n FROM supplier),
c AS (SELECT s_suppkey, [regexp_replace(n, '[^a-z0-9]+', '', 'g'), regexp_replace(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'),
  regexp_replace(string_split(n, ' ')[1], '[^a-z0-9]', '', 'g'), regexp_replace(regexp_replace(n, '[^a-z0-9]+', '', 'g'), '(inc|llc|ltd|corp|technologies|labs|ai|io)$', '')] AS l FROM s),
e AS (SELECT s_suppkey, unnest(l) AS slug, generate_subscripts(l, 1) AS pos FROM c)
SELECT s_suppkey, slug, row_number() OVER (PARTITION BY s_suppkey ORDER BY min(pos)) AS rank FROM e WHERE length(slug) >= 2 GROUP BY s_suppkey, slug""",
)
def slug_candidates(spark, sf):
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" Labs"))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.posexplode(u.slug_candidates(name)).alias("pos", "slug"))
    return rows.select("s_suppkey", "slug", (F.col("pos") + 1).cast("long").alias("rank"))


@query(
    "workday_parts",
    """SELECT s_suppkey, 'tenant' || s_nationkey AS tenant, CASE WHEN s_acctbal < 4000 THEN 'wd1' ELSE 'wd5' END AS data_centre,
 CASE WHEN s_acctbal < 2000 THEN 'en-US' ELSE '' END AS locale, 'Careers' || s_suppkey AS site FROM supplier""",
)
def workday_parts(spark, sf):
    dc = F.when(F.col("s_acctbal") < 4000, "wd1").otherwise("wd5")
    locale = F.when(F.col("s_acctbal") < 2000, "en-US/").otherwise("")
    url = F.concat(F.lit("https://tenant"), F.col("s_nationkey").cast("string"), F.lit("."), dc, F.lit(".myworkdayjobs.com/"), locale, F.lit("Careers"), F.col("s_suppkey").cast("string"), F.lit("/jobs"))
    parts = u.workday_parts(url)
    return table(spark, sf, "supplier").select("s_suppkey", *[parts[c].alias(c) for c in ("tenant", "data_centre", "locale", "site")])


@query(
    "valid_careers_url",
    "SELECT page_id, NOT contains(url, 'example.net') AND starts_with(url, 'http') AS valid FROM (SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'ftp' || url ELSE url END AS url FROM pages)",
)
def valid_careers_url(spark, sf):
    # Pages under example.net stand for an aggregator, French ones for another protocol.
    raw = F.when(F.col("url").contains("/fr/"), F.concat(F.lit("ftp"), "url")).otherwise(F.regexp_replace("url", r"[a-z.-]*\.example\.net", "jobs.remotive.com"))
    return table(spark, sf, "pages").select("page_id", u.valid_careers_url(raw).alias("valid"))


@query("host_allow_list", r"SELECT page_id, starts_with(url, 'https:') AND regexp_matches(url, '^https?://(blog|www)\.[a-z-]+\.example\.(com|org)[/?#]') AS allowed FROM pages")
def host_allow_list(spark, sf):
    allowed = u.https_on_host(F.col("url"), r"(?:blog|www)\.[a-z-]+\.example\.(?:com|org)")
    return table(spark, sf, "pages").select("page_id", allowed.alias("allowed"))


@query(
    "url_guard",
    """SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'blocked_host' WHEN contains(url, '/fr/') THEN 'unsupported_protocol' WHEN contains(url, '/es/') THEN 'invalid_url' END AS code FROM pages""",
)
def url_guard(spark, sf):
    url = F.col("url")
    route = F.regexp_extract(url, r"^https?://[^/?#]+(.*)$", 1)
    raw = (
        F.when(url.contains("/de/"), F.concat(F.lit("http://192.168."), F.pmod(F.col("page_id"), F.lit(250)).cast("string"), F.lit(".7"), route))
        .when(url.contains("/fr/"), F.concat(F.lit("ftp://"), F.regexp_replace(url, "^https?://", "")))
        .when(url.contains("/es/"), F.regexp_replace(url, "^https?://", ""))
        .otherwise(url)
    )
    return table(spark, sf, "pages").select("page_id", u.url_guard(raw).alias("code"))


@query(
    "link_extract",
    """SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'https://jobs.lever.co/acme' || page_id WHEN contains(url, '/de/') THEN 'https://site' || page_id || '.example.org/careers/open' END AS board_url FROM pages""",
)
def link_extract(spark, sf):
    number = F.col("page_id").cast("string")
    notice = (
        F.when(F.col("url").contains("/en/"), F.concat(F.lit(" apply at https://jobs.lever.co/acme"), number, F.lit("), or https://x.example.org/jobs. ")))
        .when(F.col("url").contains("/de/"), F.concat(F.lit(" see https://site"), number, F.lit(".example.org/careers/open. ")))
        .otherwise(" no link ")
    )
    return table(spark, sf, "pages").select("page_id", u.board_url_in_text(F.concat("html", notice)).alias("board_url"))


@query(
    "website_link",
    "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'https://own' || page_id || '.example.org' WHEN contains(url, '/de/') THEN 'https://visit.example.org/' || page_id END AS site FROM pages",
)
def website_link(spark, sf):
    number = F.col("page_id").cast("string")
    extra = (
        F.when(F.col("url").contains("/en/"), F.concat(F.lit('<a class="company__logo-link" href="https://own'), number, F.lit('.example.org">')))
        .when(F.col("url").contains("/de/"), F.concat(F.lit('<a href="https://visit.example.org/'), number, F.lit('" target="_blank">Visit Website</a>')))
        .otherwise("")
    )
    return table(spark, sf, "pages").select("page_id", u.website_in_page(F.concat("html", extra)).alias("site"))


@query("urls_in_text", r"SELECT page_id, unnest(regexp_extract_all('| [x](' || url || ') | https://b.example/' || page_id || ' |', 'https?://[^\s|)]+')) AS url FROM pages")
def urls_in_text(spark, sf):
    line = F.concat(F.lit("| [x]("), "url", F.lit(") | https://b.example/"), F.col("page_id").cast("string"), F.lit(" |"))
    return table(spark, sf, "pages").select("page_id", F.explode(u.first_urls(line)).alias("url"))


@query("checklist_urls", "SELECT url, contains(url, 'https') AS done FROM pages")
def checklist_urls_query(spark, sf):
    mark = F.when(F.col("url").contains("https"), "x").otherwise(" ")
    lines = table(spark, sf, "pages").select(F.concat(F.lit("- ["), mark, F.lit("] "), "url", F.lit(" | Acme | Engineer")).alias("value"))
    return checklist_urls(lines)


@query("urls_in_lines", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def urls_in_lines_query(spark, sf):
    lines = table(spark, sf, "pages").select(F.concat(F.lit("see ("), "url", F.lit(") now")).alias("value"))
    return counts_by(urls_in_lines(lines), "url")


@query(
    "resolve_relative_link",
    r"""SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) || '/jobs/' || page_id AS rooted,
 regexp_extract(url, '^(https?://[^/?#]+/(?:[^?#]*/)?)', 1) || 'job-' || page_id AS sibling FROM pages""",
)
def resolve_relative_link(spark, sf):
    number = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id", u.resolve_link(F.concat(F.lit("/jobs/"), number), F.col("url")).alias("rooted"),
        u.resolve_link(F.concat(F.lit(" job-"), number), F.col("url")).alias("sibling"),
    )


@query("body_per_key", "SELECT " + canon("url") + " AS key, '# ' || page_id || ' — page' || chr(10) || url || chr(10) || chr(10) || 'text' || chr(10) AS body FROM pages")
def body_per_key(spark, sf):
    body = body_file(F.col("page_id").cast("string"), F.lit("page"), F.col("url"), F.lit("text"))
    return table(spark, sf, "pages").select(u.canonical_url(F.col("url")).alias("key"), body.alias("body"))
