"""The given tables read as listings, companies and applications.

Each stand-in exists twice: as a DataFrame and as a SQL common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import table

STAGE_OF_BRAND = {
    "public": ("Brand#1", "Brand#2", "Brand#3"), "late_stage": ("Brand#4", "Brand#5"), "growth": ("Brand#6", "Brand#7"),
    "startup": ("Brand#8", "Brand#9", "Brand#10"), "seed": ("Brand#11", "Brand#12"),
}
FIT_OF_BRAND = {4.5: ("Brand#1", "Brand#5", "Brand#9"), 3.0: ("Brand#2", "Brand#6", "Brand#13"), 1.5: ("Brand#3", "Brand#14")}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FACETS_SQL = (
    """facets AS (SELECT p_partkey, 'p' || p_partkey AS key, p_brand AS company_key, p_name AS title, p_brand AS company, p_type, p_size, p_retailprice,
 CASE p_type WHEN 'SMALL' THEN 'Junior' WHEN 'MEDIUM' THEN 'mid' WHEN 'STANDARD' THEN 'mid-senior' WHEN 'LARGE' THEN 'senior' WHEN 'ECONOMY' THEN 'unclear' WHEN 'PROMO' THEN 'manager' END AS seniority,
 CASE WHEN p_size > 10 THEN p_size // 5 END AS yoe_min,
 string_split(p_name, ' ') AS languages, CASE WHEN p_size > 45 THEN [] ELSE [p_type, p_brand, p_type] END AS technologies,
 CASE WHEN p_size <= 10 THEN 'onsite' WHEN p_size <= 20 THEN 'hybrid' WHEN p_size <= 40 THEN 'remote' END AS remote_policy,
 CASE p_type WHEN 'SMALL' THEN 'us_only' WHEN 'LARGE' THEN 'canada' WHEN 'MEDIUM' THEN 'global' ELSE 'unclear' END AS geo_eligibility,
 CASE WHEN p_retailprice > 950 THEN 'America/Denver' END AS timezone,
 CASE p_type WHEN 'SMALL' THEN 'High' WHEN 'MEDIUM' THEN 'medium' WHEN 'LARGE' THEN 'low' END AS autonomy,
 CASE WHEN p_size <= 15 THEN 'sustainable' WHEN p_size <= 30 THEN 'balanced' WHEN p_size <= 45 THEN 'hustle' ELSE 'unclear' END AS culture,
 CASE p_type WHEN 'PROMO' THEN true WHEN 'ECONOMY' THEN false END AS on_call,
 CASE """
    + " ".join(f"WHEN p_brand IN {_in(v)} THEN '{k}'" for k, v in STAGE_OF_BRAND.items())
    + """ END AS company_stage,
 CASE WHEN p_size <= 30 THEN p_retailprice * 200 END AS pay_max, CASE WHEN p_size <= 40 THEN p_retailprice * 160 END AS pay_min,
 CASE WHEN p_type = 'PROMO' THEN 'USD' ELSE 'CAD' END AS currency,
 CASE """
    + " ".join(f"WHEN p_brand IN {_in(v)} THEN {k}e0" for k, v in FIT_OF_BRAND.items())
    + """ END AS company_fit,
 CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN CAST(p_size // 10 AS DOUBLE) END AS rank FROM part)"""
)


def facets(spark, sf):
    """Parts as listings with extracted facets."""
    return facets_of(table(spark, sf, "part"))


def facets_of(parts):
    size, kind, brand, price = F.col("p_size"), F.col("p_type"), F.col("p_brand"), F.col("p_retailprice")

    def by_brand(groups):
        rules = F
        for value, brands in groups.items():
            rules = rules.when(brand.isin(*brands), value)
        return rules

    return parts.select(
        "p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), brand.alias("company_key"),
        F.col("p_name").alias("title"), brand.alias("company"), "p_type", "p_size", "p_retailprice",
        F.when(kind == "SMALL", "Junior").when(kind == "MEDIUM", "mid").when(kind == "STANDARD", "mid-senior")
        .when(kind == "LARGE", "senior").when(kind == "ECONOMY", "unclear").when(kind == "PROMO", "manager").alias("seniority"),
        F.when(size > 10, F.floor(size / 5)).cast("int").alias("yoe_min"),
        F.split("p_name", " ").alias("languages"),
        F.when(size > 45, F.array().cast("array<string>")).otherwise(F.array(kind, brand, kind)).alias("technologies"),
        F.when(size <= 10, "onsite").when(size <= 20, "hybrid").when(size <= 40, "remote").alias("remote_policy"),
        F.when(kind == "SMALL", "us_only").when(kind == "LARGE", "canada").when(kind == "MEDIUM", "global").otherwise("unclear").alias("geo_eligibility"),
        F.when(price > 950, "America/Denver").alias("timezone"), F.array(brand).alias("location_hints"),
        F.when(kind == "SMALL", "High").when(kind == "MEDIUM", "medium").when(kind == "LARGE", "low").alias("autonomy"),
        F.when(size <= 15, "sustainable").when(size <= 30, "balanced").when(size <= 45, "hustle").otherwise("unclear").alias("culture"),
        F.when(kind == "PROMO", True).when(kind == "ECONOMY", False).alias("on_call"),
        by_brand(STAGE_OF_BRAND).alias("company_stage"),
        F.struct(
            F.when(size <= 40, price * 160).alias("min"), F.when(size <= 30, price * 200).alias("max"),
            F.when(kind == "PROMO", "USD").otherwise("CAD").alias("currency"),
        ).alias("comp"),
        by_brand(FIT_OF_BRAND).cast("double").alias("company_fit"),
        F.when(kind.isin("ECONOMY", "STANDARD"), F.floor(size / 10)).cast("double").alias("rank"),
    )


STATUS_OF_EVENT = {"signup": "Applied", "view": "Responded", "click": "Interview", "purchase": "Offer", "error": "Rejected"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF_EVENT.items()) + " END"


def event_status():
    rules = F
    for kind, status in STATUS_OF_EVENT.items():
        rules = rules.when(F.col("event_type") == kind, status)
    return rules


# A user's last event decides their application's status; its company is a market segment.
APPS_SQL = (
    "apps AS (SELECT user_id, arg_max(" + STATUS_SQL + ", struct_pack(t := ts, e := event_id)) AS status, "
    "'g' || (user_id % 7) AS company_key, CAST(min(ts) AS DATE) AS date_applied FROM events GROUP BY user_id)"
)


def apps(spark, sf):
    """Users as applications with the status of their last event."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", event_status().alias("status"))
    last = events.groupBy("user_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.to_date(F.min("ts")).alias("date_applied")
    )
    return last.withColumn("company_key", F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")))


# Customers as companies with decisions, ranks and fits.
COMPANIES_SQL = """companies AS (SELECT 'c' || c_custkey AS key, c_custkey, c_name AS name, c_mktsegment,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ashby' WHEN 'HOUSEHOLD' THEN 'workday' WHEN 'FURNITURE' THEN 'taleo' ELSE 'lever' END AS provider,
 CASE WHEN c_acctbal > -500 THEN 'https://jobs.example.com/' || c_custkey END AS careers_url,
 CASE WHEN c_acctbal < 500 THEN 'skip' WHEN c_acctbal > 8000 THEN 'keep' ELSE 'undecided' END AS decision,
 c_nationkey IN (3, 4, 5) AS excluded_by_type, c_acctbal AS relevance_score,
 CASE WHEN c_nationkey < 15 THEN CAST(c_nationkey % 6 AS DOUBLE) END AS rank,
 CASE WHEN c_nationkey < 8 THEN CAST((c_nationkey + 2) % 6 AS DOUBLE) END AS fit,
 CAST(c_nationkey % 5 AS INT) AS remote_relevant FROM customer)"""


def companies(spark, sf):
    balance, nation, segment = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), "c_custkey", F.col("c_name").alias("name"), "c_mktsegment",
        F.when(segment == "BUILDING", "greenhouse").when(segment == "MACHINERY", "ashby").when(segment == "HOUSEHOLD", "workday")
        .when(segment == "FURNITURE", "taleo").otherwise("lever").alias("provider"),
        F.when(balance > -500, F.concat(F.lit("https://jobs.example.com/"), F.col("c_custkey").cast("string"))).alias("careers_url"),
        F.when(balance < 500, "skip").when(balance > 8000, "keep").otherwise("undecided").alias("decision"),
        nation.isin(3, 4, 5).alias("excluded_by_type"), balance.alias("relevance_score"),
        F.when(nation < 15, nation % 6).cast("double").alias("rank"),
        F.when(nation < 8, (nation + 2) % 6).cast("double").alias("fit"),
        (nation % 5).cast("int").alias("remote_relevant"),
    )
