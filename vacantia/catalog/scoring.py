"""Scores: tiers, stacks, ladders, enum tables, weighted averages, filters, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facets as fc
from ..functions.keywords import title_passes
from ..operators.queues import compare_listings, comparison_table
from ..plans.rubric import Dimension, HardFilter, Rubric, band, hard_filter_result, live_score, score_rows, weighted_average
from .registry import query, table
from .standins import FACETS_SQL, facets

# ── the flagship: parts by keyword, null-aware score, hard exclusion, top 100 ──

_PRICE = "CASE WHEN p_retailprice >= 975 THEN 5e0 WHEN p_retailprice >= 950 THEN 4e0 WHEN p_retailprice >= 925 THEN 3e0 ELSE 2e0 END"
_DEMAND = "CASE WHEN qty >= 863 THEN 5e0 WHEN qty >= 754 THEN 4e0 WHEN qty >= 657 THEN 3e0 ELSE 1e0 END"
_SIZE = "CASE WHEN p_size > 40 THEN NULL WHEN p_size <= 10 THEN 5e0 WHEN p_size <= 25 THEN 3e0 ELSE 1e0 END"
_DIMS_SQL = f"""
demand AS (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey),
dims AS (SELECT p_partkey, p_name, p_type, p_size, {_PRICE} AS price_dim, {_DEMAND} AS demand_dim, {_SIZE} AS size_dim FROM part JOIN demand ON p_partkey = l_partkey)"""
_RUBRIC = Rubric((Dimension("price", 25), Dimension("demand", 15), Dimension("size", 10), Dimension("other", 50)))


def _scored_parts(spark, sf, only=None):
    """Parts with their three dimensions; total demand comes from one aggregation of the lines."""
    demand = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    parts = table(spark, sf, "part")
    parts = parts if only is None else parts.where(only)
    price, qty, size = F.col("p_retailprice"), F.col("qty"), F.col("p_size")
    return parts.join(demand, F.col("p_partkey") == F.col("l_partkey")).withColumns({
        "price_dim": F.when(price >= 975, 5.0).when(price >= 950, 4.0).when(price >= 925, 3.0).otherwise(2.0),
        "demand_dim": F.when(qty >= 863, 5.0).when(qty >= 754, 4.0).when(qty >= 657, 3.0).otherwise(1.0),
        "size_dim": F.when(size > 40, F.lit(None).cast("double")).when(size <= 10, 5.0).when(size <= 25, 3.0).otherwise(1.0),
    })


_WEIGHTS = {"price": 25.0, "demand": 15.0, "size": 10.0}


def _avg_sql(w=(25, 15, 10)) -> str:
    p, d, s = (f"{x}e0" for x in w)
    return f"({p} * price_dim + {d} * demand_dim + CASE WHEN size_dim IS NULL THEN 0e0 ELSE {s} * size_dim END) / ({p} + {d} + CASE WHEN size_dim IS NULL THEN 0e0 ELSE {s} END)"


def _average(weights=_WEIGHTS):
    return weighted_average({k: F.col(f"{k}_dim") for k in weights}, weights)


@query(
    "ranked_parts",
    f"""WITH {_DIMS_SQL} SELECT p_partkey, p_name, price_dim, demand_dim, size_dim, {_avg_sql()} AS computed_score, p_type = 'PROMO' AS hard_excluded FROM dims
WHERE (contains(p_name, 'widget') OR contains(p_name, 'gear') OR contains(p_name, 'ring')) AND NOT (contains(p_name, 'old') OR contains(p_name, 'red'))
ORDER BY hard_excluded, computed_score DESC, p_partkey LIMIT 100""",
)
def ranked_parts(spark, sf):
    rows = _scored_parts(spark, sf, title_passes(F.col("p_name"), ["widget", "gear", "ring"], ["old", "red"]))
    excluded = hard_filter_result((HardFilter("p_type", within=("PROMO",)),), F.col)
    scored = rows.select(
        "p_partkey", "p_name", "price_dim", "demand_dim", "size_dim", _average().alias("computed_score"), excluded["excluded"].alias("hard_excluded")
    )
    return scored.orderBy("hard_excluded", F.desc("computed_score"), "p_partkey").limit(100)


@query("weighted_score", f"WITH {_DIMS_SQL} SELECT p_partkey, {_avg_sql()} AS computed_score FROM dims")
def weighted_score(spark, sf):
    return _scored_parts(spark, sf).select("p_partkey", _average().alias("computed_score"))


_PROFILES = {"price first": (70, 20, 10), "demand first": (10, 80, 10), "size only": (0, 0, 10)}


@query(
    "weight_sweep",
    f"WITH {_DIMS_SQL} " + " UNION ALL ".join(
        f"SELECT p_partkey, '{name}' AS profile, CASE WHEN {w[0] + w[1]} + CASE WHEN size_dim IS NULL THEN 0 ELSE {w[2]} END = 0 THEN NULL ELSE {_avg_sql(w)} END AS score FROM dims"
        for name, w in _PROFILES.items()
    ),
)
def weight_sweep(spark, sf):
    """All weight profiles in one pass over the stored dimension scores."""
    dims = F.create_map(F.lit("price"), F.col("price_dim"), F.lit("demand"), F.col("demand_dim"), F.lit("size"), F.col("size_dim"))
    none = F.lit(None).cast("double")
    scores = [
        F.struct(F.lit(n).alias("profile"), live_score(_RUBRIC, F.col("dim_scores"), none, none, dict(zip(_WEIGHTS, map(float, w)))).alias("score"))
        for n, w in _PROFILES.items()
    ]
    rows = _scored_parts(spark, sf).select("p_partkey", dims.alias("dim_scores"))
    return rows.select("p_partkey", F.inline(F.array(*scores)))


@query("comp_tiers", "SELECT o_orderkey, CASE WHEN v IS NULL OR v = 0 THEN NULL WHEN v >= 400000 THEN 5e0 WHEN v >= 250000 THEN 4e0 WHEN v >= 120000 THEN 3e0 ELSE 1e0 END AS tier FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'F' THEN o_totalprice * 1.35e0 ELSE o_totalprice END AS v FROM orders)")
def comp_tiers(spark, sf):
    pay = F.struct(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("min"), F.lit(None).cast("double").alias("max"),
        F.when(F.col("o_orderstatus") == "F", "US$").otherwise("CAD").alias("currency"),
    )
    tiers = [{"min": 120000, "score": 3}, {"min": 400000, "score": 7}, {"min": 250000, "score": 4}]
    score = fc.comp(lambda _: F.col("pay"), {"comp_tiers": tiers})
    return table(spark, sf, "orders").withColumn("pay", pay).select("o_orderkey", score.alias("tier"))


_PREFS = {
    "languages": {"love": ["Red", "blue"], "ok": ["gear"], "avoid": ["old"], "neutral": ["bolt"]},
    "technologies": {"love": ["large"], "ok": ["medium", "Brand#7"], "avoid": ["Brand#13"]},
    "timezone_ok": ["america/", "Brand#2"], "desired_level": "senior",
    "comp_tiers": [{"min": 190000, "score": 5}, {"min": 170000, "score": 4}, {"min": 150000, "score": 2}],
}


def _stack_sql(items: str, love, ok, avoid, neutral) -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w.lower()}'" for w in words) + "]::VARCHAR[]"
    low = f"list_transform({items}, lambda z: lower(z))"
    listed = quoted([*love, *ok, *avoid, *neutral])
    return f"""CASE WHEN {items} IS NULL OR len({items}) = 0 THEN NULL WHEN list_has_any({low}, {quoted(avoid)}) THEN 1.5e0
 ELSE greatest(1e0, least(5e0, 3e0 + CASE WHEN list_has_any({low}, {quoted(love)}) THEN 1.5e0 WHEN list_has_any({low}, {quoted(ok)}) THEN 0.5e0 ELSE 0e0 END
  - least(len(list_filter({low}, lambda y: NOT list_contains({listed}, y))) * 0.3e0, 1.5e0))) END"""


_L, _T = _PREFS["languages"], _PREFS["technologies"]
_LANG_SQL = _stack_sql("languages", _L["love"], _L["ok"], _L["avoid"], _L["neutral"])
_TECH_SQL = _stack_sql("technologies", _T["love"], _T["ok"], _T["avoid"], [])
_BOTH_SQL = _stack_sql(
    "list_concat(languages, technologies)", _L["love"] + _T["love"], _L["ok"] + _T["ok"], _L["avoid"] + _T["avoid"], _L["neutral"]
)


@query("stack_score", f"WITH {FACETS_SQL} SELECT p_partkey, {_LANG_SQL} AS languages_score, {_TECH_SQL} AS technologies_score, {_BOTH_SQL} AS stack FROM facets")
def stack_score(spark, sf):
    return facets(spark, sf).select(
        "p_partkey", fc.languages(F.col, _PREFS).alias("languages_score"), fc.technologies(F.col, _PREFS).alias("technologies_score"),
        fc.tech_stack(F.col, _PREFS).alias("stack"),
    )


@query(
    "stack_score_per_order",
    """WITH i AS (SELECT l_orderkey, l_linenumber, [l_returnflag, l_linestatus, l_returnflag || l_linestatus] AS items FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN list_contains(items, 'RF') THEN 1.5e0 WHEN list_contains(items, 'A') THEN 3e0 + 1.5e0 - least(CASE WHEN list_contains(items, 'O') THEN 1 ELSE 2 END * 0.3e0, 1.5e0)
 ELSE 3e0 + CASE WHEN list_contains(items, 'O') THEN 0.5e0 ELSE 0e0 END - least(CASE WHEN list_contains(items, 'O') THEN 2 ELSE 3 END * 0.3e0, 1.5e0) END AS score FROM i""",
)
def stack_score_per_order(spark, sf):
    items = F.array("l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus"))
    score = fc.stack_score(items, {"love": ["a"], "ok": ["o"], "avoid": ["rf"]}, {})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query(
    "ladder_score",
    "SELECT o_orderkey, greatest(1e0, 5e0 - abs(CAST(substr(o_orderpriority, 1, 1) AS INT) - 2)) AS score FROM orders",
)
def ladder_score(spark, sf):
    rungs = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")
    score = fc.ladder_score(F.col("o_orderpriority"), F.lit(None).cast("int"), "2-HIGH", rungs)
    return table(spark, sf, "orders").select("o_orderkey", score.alias("score"))


_LEVEL_SQL = """CASE WHEN lower(seniority) = 'manager' THEN 1e0 ELSE greatest(1e0, 5e0 - abs(CASE lower(seniority) WHEN 'junior' THEN 1 WHEN 'mid' THEN 2 WHEN 'mid-senior' THEN 3 WHEN 'senior' THEN 4
 ELSE CASE WHEN yoe_min >= 8 THEN 5 WHEN yoe_min >= 5 THEN 4 WHEN yoe_min >= 3 THEN 3 WHEN yoe_min IS NOT NULL THEN 2 END END - 4)) END"""
# greatest() skips nulls, so an unknown rung must be kept apart.
_LEVEL_SQL = f"CASE WHEN lower(seniority) = 'unclear' AND yoe_min IS NULL THEN NULL ELSE {_LEVEL_SQL} END"


@query("level_score", f"WITH {FACETS_SQL} SELECT p_partkey, {_LEVEL_SQL} AS score FROM facets")
def level_score(spark, sf):
    return facets(spark, sf).select("p_partkey", fc.level(F.col, _PREFS).alias("score"))


_SCOPE_SQL = "CASE lower(autonomy) WHEN 'high' THEN 5e0 WHEN 'medium' THEN 3e0 WHEN 'low' THEN 1e0 END"
_WLB_SQL = "CASE WHEN culture = 'unclear' THEN NULL ELSE greatest(1e0, CASE culture WHEN 'sustainable' THEN 5e0 WHEN 'balanced' THEN 3e0 WHEN 'hustle' THEN 1e0 END - CASE WHEN on_call THEN 1e0 ELSE 0e0 END) END"
_STAGE_SQL = "CASE company_stage WHEN 'public' THEN 5e0 WHEN 'late_stage' THEN 4e0 WHEN 'growth' THEN 4e0 WHEN 'startup' THEN 2.5e0 WHEN 'seed' THEN 1.5e0 END"
_REMOTE_SQL = """CASE WHEN geo_eligibility = 'us_only' THEN 1e0 WHEN remote_policy = 'onsite' THEN 1e0 WHEN remote_policy = 'hybrid' THEN 3e0
 WHEN remote_policy = 'remote' THEN CASE WHEN geo_eligibility IN ('canada', 'global') OR coalesce(timezone, '') <> '' OR contains(lower(company_key), 'brand#2') THEN 5e0 ELSE 4e0 END END"""
_COMP_SQL = """CASE WHEN coalesce(pay_max, pay_min) IS NULL THEN NULL ELSE CASE WHEN coalesce(pay_max, pay_min) * CASE WHEN currency = 'USD' THEN 1.35e0 ELSE 1e0 END >= 190000 THEN 5e0
 WHEN coalesce(pay_max, pay_min) * CASE WHEN currency = 'USD' THEN 1.35e0 ELSE 1e0 END >= 170000 THEN 4e0 WHEN coalesce(pay_max, pay_min) * CASE WHEN currency = 'USD' THEN 1.35e0 ELSE 1e0 END >= 150000 THEN 2e0 ELSE 1e0 END END"""


@query("enum_score", f"WITH {FACETS_SQL} SELECT p_partkey, {_SCOPE_SQL} AS scope, {_WLB_SQL} AS wlb, {_STAGE_SQL} AS stability FROM facets")
def enum_score(spark, sf):
    return facets(spark, sf).select(
        "p_partkey", fc.scope(F.col, _PREFS).alias("scope"), fc.wlb(F.col, _PREFS).alias("wlb"), fc.stability(F.col, _PREFS).alias("stability")
    )


@query("remote_score", f"WITH {FACETS_SQL} SELECT p_partkey, {_REMOTE_SQL} AS score FROM facets")
def remote_score(spark, sf):
    return facets(spark, sf).select("p_partkey", fc.remote_tz(F.col, _PREFS).alias("score"))


@query("company_fit_score", f"WITH {FACETS_SQL} SELECT p_partkey, company_fit AS score FROM facets")
def company_fit_score(spark, sf):
    return facets(spark, sf).select("p_partkey", fc.company_fit(F.col, _PREFS).alias("score"))


FULL_RUBRIC = Rubric(
    dimensions=(
        Dimension("north_star", 20), Dimension("scope", 15, "scope"), Dimension("level", 15, "level"), Dimension("comp", 10, "comp"),
        Dimension("remote_tz", 10, "remote_tz"), Dimension("wlb", 10, "wlb"), Dimension("stability", 5, "stability"),
        Dimension("tech_stack", 10, "tech_stack"), Dimension("company_fit", 5, "company_fit"),
    ),
    preferences=_PREFS,
    hard_filters=(
        HardFilter("geo_eligibility", within=("us_only", "eu_only")), HardFilter("languages", within=("Old",), is_array=True),
        HardFilter("yoe_min", above=9), HardFilter("p_size", below=3),
    ),
    bands=((4.5, "Strong match"), (4.0, "Good match"), (3.5, "Decent but not ideal"), (0.0, "Weak match")),
)
FULL_DIMS = {
    "north_star": ("rank", 20), "scope": (_SCOPE_SQL, 15), "level": (_LEVEL_SQL, 15), "comp": (_COMP_SQL, 10), "remote_tz": (_REMOTE_SQL, 10),
    "wlb": (_WLB_SQL, 10), "stability": (_STAGE_SQL, 5), "tech_stack": (_BOTH_SQL, 10), "company_fit": ("company_fit", 5),
}


def average_sql(weights: dict[str, int]) -> str:
    top = " + ".join(f"CASE WHEN d_{k} IS NULL THEN 0e0 ELSE {w}e0 * d_{k} END" for k, w in weights.items())
    low = " + ".join(f"CASE WHEN d_{k} IS NULL THEN 0e0 ELSE {w}e0 END" for k, w in weights.items())
    return f"({top}) / nullif({low}, 0)"


FULL_SQL = (
    f"{FACETS_SQL}, fdims AS (SELECT *, " + ", ".join(f"{s} AS d_{k}" for k, (s, _) in FULL_DIMS.items()) + " FROM facets), "
    f"scored AS (SELECT *, {average_sql({k: w for k, (_, w) in FULL_DIMS.items()})} AS computed_score, "
    "CASE WHEN geo_eligibility IN ('us_only', 'eu_only') THEN 'geo_eligibility ∈ us_only,eu_only' WHEN list_contains(languages, 'old') THEN 'languages ∈ Old' "
    "WHEN yoe_min > 9 THEN 'yoe_min > 9' WHEN p_size < 3 THEN 'p_size < 3' ELSE '' END AS hard_reason FROM fdims)"
)


def full_scores(spark, sf):
    return score_rows(facets(spark, sf), FULL_RUBRIC, F.col, judged_all=F.col("rank"))


@query(
    "rubric_score",
    f"WITH {FULL_SQL} SELECT p_partkey, " + ", ".join(f"d_{k}" for k in FULL_DIMS) + ", computed_score, hard_reason <> '' AS hard_excluded, hard_reason FROM scored",
)
def rubric_score(spark, sf):
    dims = [F.try_element_at("dim_scores", F.lit(k)).alias(f"d_{k}") for k in FULL_DIMS]
    return full_scores(spark, sf).select("p_partkey", *dims, "computed_score", "hard_excluded", "hard_reason")


@query("judged_dimensions", f"WITH {FACETS_SQL} SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size > 20 THEN 4e0 END ELSE rank END AS d_fit FROM facets")
def judged_dimensions(spark, sf):
    """A map of judged scores per dimension, else one number for all judged dimensions."""
    judged = F.when(F.col("p_type") == "ECONOMY", F.create_map(F.lit("fit"), F.when(F.col("p_size") > 20, 4.0)))
    rubric = Rubric((Dimension("fit", 100),))
    rows = score_rows(facets(spark, sf), rubric, F.col, judged=judged, judged_all=F.col("rank"))
    return rows.select("p_partkey", F.try_element_at("dim_scores", F.lit("fit")).alias("d_fit"))


_REWEIGHTED = {"comp": 60, "level": 40}
_STAFF_SQL = _LEVEL_SQL.replace(" - 4))", " - 5))")


@query(
    "live_reweight",
    f"WITH {FULL_SQL} SELECT p_partkey, coalesce(CASE WHEN p_size = 7 THEN 2e0 END, {average_sql(_REWEIGHTED).replace('d_level', 'l')}, rank) AS score FROM (SELECT *, {_STAFF_SQL} AS l FROM scored)",
)
def live_reweight(spark, sf):
    """Other weights and another desired level, without touching the stored facets."""
    manual = F.when(F.col("p_size") == 7, 2.0)
    level = fc.ladder_score(F.col("seniority"), F.col("yoe_min"), "staff")
    score = live_score(FULL_RUBRIC, F.col("dim_scores"), manual, F.col("rank"), {k: float(v) for k, v in _REWEIGHTED.items()}, level)
    return full_scores(spark, sf).select("p_partkey", score.alias("score"))


@query(
    "score_bands",
    f"WITH {FULL_SQL} SELECT p_partkey, CASE WHEN computed_score >= 4.5 THEN 'Strong match' WHEN computed_score >= 4 THEN 'Good match' WHEN computed_score >= 3.5 THEN 'Decent but not ideal' WHEN computed_score >= 0 THEN 'Weak match' END AS label FROM scored",
)
def score_bands(spark, sf):
    return full_scores(spark, sf).select("p_partkey", band(F.col("computed_score"), FULL_RUBRIC.bands).alias("label"))


@query(
    "hard_filters",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P') THEN 'o_orderstatus ∈ p' WHEN list_has_any(flags, ['R']) THEN 'flags ∈ R' WHEN o_totalprice > 450000 THEN 'o_totalprice > 450000'
 WHEN n < 1 THEN 'n < 1' ELSE '' END AS reason FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, [CASE WHEN r > 0 THEN 'R' END, CASE WHEN a > 0 THEN 'A' END] AS flags, n FROM orders LEFT JOIN
 (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""",
)
def hard_filters(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_quantity") > 25).alias("n")
    )
    flags = F.array(F.when(F.col("r") > 0, "R"), F.when(F.col("a") > 0, "A"))
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("flags", flags)
    filters = (
        HardFilter("o_orderstatus", within=("p",)), HardFilter("flags", within=("R",), is_array=True), HardFilter("o_totalprice", above=450000), HardFilter("n", below=1),
    )
    return rows.select("o_orderkey", hard_filter_result(filters, F.col)["reason"].alias("reason"))


@query(
    "display_score",
    f"WITH {FULL_SQL} SELECT p_partkey, coalesce(CASE WHEN p_size = 7 THEN 2e0 END, CASE WHEN p_type <> 'SMALL' THEN computed_score END, rank) AS display_score FROM scored",
)
def display_score(spark, sf):
    score = fc.display_score(F.when(F.col("p_size") == 7, 2.0), F.when(F.col("p_type") != "SMALL", F.col("computed_score")), F.col("rank"))
    return full_scores(spark, sf).select("p_partkey", score.alias("display_score"))


@query(
    "relevance",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Sr. Engineer' ELSE 'Engineer' END AS title, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS days,
 CASE WHEN c_acctbal > 8000 THEN 4e0 WHEN c_acctbal > 5000 THEN 3e0 WHEN c_acctbal > 0 THEN 1e0 END AS fit FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, 1e0 + CASE WHEN title = 'Sr. Engineer' THEN 0.5e0 ELSE 0e0 END + CASE WHEN days <= 14 THEN 0.5e0 WHEN days <= 45 THEN 0.25e0 ELSE 0e0 END + CASE WHEN fit >= 4 THEN 0.5e0 WHEN fit >= 3 THEN 0.25e0 ELSE 0e0 END AS relevance FROM s""",
)
def relevance(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    title = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Sr. Engineer").otherwise("Engineer")
    fit = F.when(F.col("c_acctbal") > 8000, 4.0).when(F.col("c_acctbal") > 5000, 3.0).when(F.col("c_acctbal") > 0, 1.0)
    score = fc.listing_relevance(title, F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date"), fit)
    return rows.select("o_orderkey", score.alias("relevance"))


@query(
    "company_relevance",
    """SELECT c_custkey, c_nationkey + 0.5e0 * CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END + 0.01e0 * CAST(floor(c_acctbal / 100) AS INT) AS relevance FROM customer""",
)
def company_relevance(spark, sf):
    titles = F.array(F.lit("Engineer"), F.when(F.col("c_mktsegment") == "BUILDING", "Team LEAD").when(F.col("c_mktsegment") == "MACHINERY", "Staff engineer").otherwise("Analyst"))
    score = fc.company_relevance(F.col("c_nationkey"), F.floor(F.col("c_acctbal") / 100).cast("int"), titles)
    return table(spark, sf, "customer").select("c_custkey", score.alias("relevance"))


_COMPARED = ("p3", "p11", "p42", "p77")


@query(
    "best_per_dimension",
    f"WITH {FULL_SQL}, c AS (SELECT * FROM scored WHERE key IN {_COMPARED}), l AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS dimension, key, d_{k} AS score FROM c" for k in FULL_DIMS)
    + "), s AS (SELECT dimension, max(score) AS hi, min(score) AS lo, count(score) AS n FROM l GROUP BY 1) SELECT l.dimension, key, score, coalesce(n > 1 AND hi > lo AND score = hi, false) AS best FROM l JOIN s ON l.dimension = s.dimension",
)
def best_per_dimension(spark, sf):
    return compare_listings(full_scores(spark, sf), list(_COMPARED))


@query(
    "comparison_table",
    f"WITH {FULL_SQL}, c AS (SELECT * FROM scored WHERE key IN {_COMPARED}), l AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS dimension, key, d_{k} AS score FROM c" for k in FULL_DIMS)
    + "), s AS (SELECT dimension, max(score) AS hi, min(score) AS lo, count(score) AS n FROM l GROUP BY 1), b AS (SELECT l.dimension, key, score, coalesce(n > 1 AND hi > lo AND score = hi, false) AS best FROM l JOIN s ON l.dimension = s.dimension) SELECT dimension, "
    + ", ".join(f"max(score) FILTER (WHERE key = '{k}') AS score_{i}, bool_or(best) FILTER (WHERE key = '{k}') AS best_{i}" for i, k in enumerate(_COMPARED))
    + " FROM b GROUP BY 1",
)
def comparison_table_query(spark, sf):
    """One row per dimension, two columns per compared listing."""
    wide = comparison_table(full_scores(spark, sf), list(_COMPARED))
    return wide.select("dimension", *[c for i, k in enumerate(_COMPARED) for c in (F.col(f"`{k}`.score").alias(f"score_{i}"), F.col(f"`{k}`.best").alias(f"best_{i}"))])
