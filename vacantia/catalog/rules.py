"""Keyword, location, exclusion and liveness rules; form fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import age_band
from ..functions.fields import learnable
from ..functions.keywords import boost, first_exclusion, location_passes, title_passes
from ..functions.liveness import history_status, liveness, route
from ..functions.status import canonical_status, is_open, stage_chip
from ..functions.text import norm_label
from ..functions.urls import url_guard
from ..operators.containment import listed_keywords, titles_passing, with_first_exclusion
from ..operators.feeds import answer_plan, counts_by, form_verdicts, unresolved_required, with_field_kind
from ..operators.patches import remember_answers
from .registry import query, table
from .standins import STATUS_SQL, event_status
from .text import HTML_SQL, fill, trim


@query(
    "keyword_filter",
    """SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'widget') OR contains(lower(p_name), 'gear') OR contains(lower(p_name), 'ring'))
 AND NOT (contains(lower(p_name), 'old') OR contains(lower(p_name), 'red'))""",
)
def keyword_filter(spark, sf):
    keep = title_passes(F.col("p_name"), ["Widget", "gear", "RING"], ["old", "Red"])
    return table(spark, sf, "part").where(keep).select("p_partkey", "p_name")


@query(
    "keyword_filter_long_list",
    "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{a}{b} ')" for a in ("th", "er", "on", "an", "re", "en", "ou", "ai") for b in ("sh", "le", "ti", "ux", "wh", "st", "nd")),
)
def keyword_filter_long_list(spark, sf):
    words = [f"{a}{b} " for a in ("th", "er", "on", "an", "re", "en", "ou", "ai") for b in ("sh", "le", "ti", "ux", "wh", "st", "nd")]
    return table(spark, sf, "documents").where(title_passes(F.col("text"), words)).select("doc_id")


@query(
    "tiered_keyword_filter",
    r"""SELECT doc_id, CASE WHEN text IS NULL OR regexp_matches(text, '^\s*$') THEN true
 WHEN contains(lower(text), 'thion') OR contains(lower(text), 'eaueau') THEN true WHEN contains(lower(text), 'onan') OR contains(lower(text), 'lement') THEN false
 WHEN contains(lower(text), 'erth') OR contains(lower(text), 'ción') THEN true ELSE false END AS passes FROM documents""",
)
def tiered_keyword_filter(spark, sf):
    ok = location_passes(F.col("text"), ["Thion", "eaueau"], [" ERTH ", "ción", None, 7], ["onan", "lement"])
    return table(spark, sf, "documents").select("doc_id", ok.alias("passes"))


@query(
    "exclusion_first_hit",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'thererth') OR contains(lower(source), 'thererth') THEN 'ThererTH' WHEN contains(lower(text), 'src1') OR contains(lower(source), 'src1') OR contains('tag-' || lang, 'src1') THEN 'src1'
 WHEN contains(lower(text), 'tag-de') OR contains('tag-' || lang, 'tag-de') THEN 'TAG-DE' WHEN contains(lower(text), 'eaux') THEN 'eaux' END AS matched FROM documents""",
)
def exclusion_first_hit(spark, sf):
    tags = F.array(F.concat(F.lit("tag-"), F.col("lang")))
    hit = first_exclusion(["ThererTH", "src1", " ", "TAG-DE", "eaux"], F.col("text"), F.col("source"), tags=tags)
    return table(spark, sf, "documents").select("doc_id", hit.alias("matched"))


@query("keyword_list", "SELECT DISTINCT lower(trim(substr(p_name, 1 + p_partkey % 4, 1 + p_size % 9))) AS keyword FROM part WHERE trim(substr(p_name, 1 + p_partkey % 4, 1 + p_size % 9)) <> ''")
def keyword_list(spark, sf):
    """A table of keywords as it is compared: lower case, trimmed, none blank, none twice."""
    part = F.upper(F.substr("p_name", (1 + F.col("p_partkey") % 4).cast("int"), (1 + F.col("p_size") % 9).cast("int")))
    return listed_keywords(table(spark, sf, "part").select(part.alias("keyword"))).select(F.col("needle").alias("keyword"))


_LISTED_SQL = """pos AS (SELECT DISTINCT lower(trim(substr(p_name, 1 + p_partkey % 5, 4))) AS k FROM part WHERE p_size > 40), neg AS (SELECT DISTINCT lower(trim(substr(p_name, 2, 3 + p_partkey % 4))) AS k FROM part WHERE p_size = 7),
 names AS (SELECT DISTINCT lower(p_name) AS n FROM part)"""


@query(
    "keyword_table_filter",
    f"""WITH {_LISTED_SQL} SELECT p_partkey, p_name FROM part WHERE lower(p_name) IN (SELECT n FROM names JOIN pos ON contains(n, k) AND k <> '')
 AND lower(p_name) NOT IN (SELECT n FROM names JOIN neg ON contains(n, k) AND k <> '')""",
)
def keyword_table_filter(spark, sf):
    """Keywords that are rows of a table, as many as there are."""
    parts = table(spark, sf, "part")
    number = F.col("p_partkey").cast("int")
    positive = parts.where("p_size > 40").select(F.upper(F.substring("p_name", 1 + number % 5, F.lit(4))).alias("keyword"))
    negative = parts.where("p_size = 7").select(F.substring("p_name", F.lit(2), 3 + number % 4).alias("keyword"))
    return titles_passing(parts, "p_name", positive, negative).select("p_partkey", "p_name")


@query(
    "keyword_table_first_hit",
    """WITH k AS (SELECT p_partkey AS pos, upper(substr(p_name, 3, 5)) AS keyword, lower(trim(substr(p_name, 3, 5))) AS needle FROM part WHERE p_size = 3
 UNION ALL SELECT -1, ' brand#1 ', 'brand#1' UNION ALL SELECT 1000000 + c_custkey, c_mktsegment, lower(c_mktsegment) FROM customer WHERE c_custkey < 50),
t AS (SELECT p_partkey, lower(p_name) AS t FROM part UNION SELECT p_partkey, lower(p_brand) FROM part WHERE p_size < 30 UNION SELECT p_partkey, lower(p_type) FROM part),
h AS (SELECT p_partkey, arg_min(keyword, pos) AS matched FROM t JOIN k ON contains(t, needle) AND needle <> '' GROUP BY 1)
SELECT p_partkey, matched FROM part LEFT JOIN h USING (p_partkey)""",
)
def keyword_table_first_hit(spark, sf):
    parts = table(spark, sf, "part").withColumns({"brand": F.when(F.col("p_size") < 30, F.col("p_brand")), "tags": F.array("p_type", F.lit(None).cast("string"))})
    own = parts.where("p_size = 3").select(F.col("p_partkey").cast("long").alias("pos"), F.upper(F.substring("p_name", 3, 5)).alias("keyword"))
    segments = table(spark, sf, "customer").where("c_custkey < 50").select((F.col("c_custkey") + 1_000_000).cast("long").alias("pos"), F.col("c_mktsegment").alias("keyword"))
    brand = own.sparkSession.createDataFrame([(-1, " brand#1 ")], "pos long, keyword string")
    found = with_first_exclusion(parts, own.unionByName(segments).unionByName(brand), ["p_name", "brand"], "tags", "matched")
    return found.select("p_partkey", "matched")


@query("title_boost", "SELECT p_partkey, CASE WHEN contains(p_name, 'gear') OR contains(p_name, 'bolt') THEN 0.5e0 ELSE 0e0 END AS boost FROM part")
def title_boost(spark, sf):
    return table(spark, sf, "part").select("p_partkey", boost(F.col("p_name"), ["Gear", "bolt"], 0.5).alias("boost"))


@query(
    "status_normalise",
    f"SELECT event_id, CASE event_type WHEN 'signup' THEN 'Applied' WHEN 'view' THEN 'Interview' WHEN 'click' THEN 'Discarded' WHEN 'purchase' THEN 'SKIP' ELSE 'Evaluated' END AS status FROM events",
)
def status_normalise(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "signup", F.concat(F.lit("**Aplicado** "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" by mail")))
        .when(kind == "view", " INTERVIEW ").when(kind == "click", "Duplicado #12").when(kind == "purchase", "geo blocker").otherwise(F.concat(F.lit("odd "), kind))
    )
    return table(spark, sf, "events").select("event_id", canonical_status(raw).alias("status"))


@query("open_status", f"SELECT event_id, ({STATUS_SQL}) IN ('Applied', 'Responded', 'Interview', 'Offer') AS open FROM events")
def open_status(spark, sf):
    return table(spark, sf, "events").select("event_id", is_open(event_status()).alias("open"))


@query(
    "stage_chip",
    f"""WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice > 300000 THEN 'Offer' ELSE 'Rejected' END WHEN 'P' THEN 'Applied' END AS status,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'shortlist' WHEN o_orderpriority = '2-HIGH' THEN 'skip' ELSE 'undecided' END AS decision FROM orders)
SELECT o_orderkey, CASE status WHEN 'Offer' THEN 'keep' WHEN 'Rejected' THEN 'skip' WHEN 'Applied' THEN 'status' ELSE CASE WHEN decision IN ('shortlist', 'skip') THEN decision ELSE 'none' END END AS chip FROM s""",
)
def stage_chip_query(spark, sf):
    state = F.col("o_orderstatus")
    status = F.when(state == "F", F.when(F.col("o_totalprice") > 300000, "Offer").otherwise("Rejected")).when(state == "P", "Applied")
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "shortlist").when(F.col("o_orderpriority") == "2-HIGH", "skip").otherwise("undecided")
    return table(spark, sf, "orders").select("o_orderkey", stage_chip(status, decision).alias("chip"))


@query(
    "posting_age_band",
    "SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 30 THEN 'good' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') < 60 THEN 'mixed' ELSE 'concerning' END AS band FROM orders",
)
def posting_age_band(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", age_band(F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date")).alias("band"))


# A landed page check made from each page: status and controls follow from its URL, and a
# notice is added to some bodies so that every rule is met.
_NOTICE_SQL = "CASE WHEN contains(url, 'ref=') THEN ' 48 jobs found ' WHEN contains(url, '#top') THEN ' This position has been filled. ' ELSE '' END"
_LIVE_SQL = f"""
page AS (SELECT page_id, url, CASE WHEN contains(url, '.html') THEN 410 ELSE 200 END AS status,
 CASE WHEN ends_with(url, '/') THEN url || '?error=true' ELSE url END AS final_url,
 CASE WHEN contains(url, '/es/') THEN 'short' ELSE {fill(HTML_SQL, 'html')} END || {_NOTICE_SQL} AS body,
 CASE WHEN contains(url, 'https') THEN 'Apply now' ELSE 'Share' END AS control FROM pages),
live AS (SELECT page_id, url, CASE WHEN status IN (404, 410) THEN 'http_gone' WHEN contains(lower(final_url), '?error=true') THEN 'expired_url'
 WHEN regexp_matches(lower(body), 'position has been filled|job (is )?no longer available|this (position|role|job) (is )?no longer|no longer accepting applications') THEN 'expired_body'
 WHEN control = 'Apply now' THEN 'apply_control_visible' WHEN regexp_matches(lower(body), '\\d+\\s+jobs?\\s+found') THEN 'listing_page'
 WHEN length({trim('body')}) < 300 THEN 'insufficient_content' ELSE 'no_apply_control' END AS code FROM page),
verdict AS (SELECT *, CASE code WHEN 'apply_control_visible' THEN 'active' WHEN 'no_apply_control' THEN 'uncertain' ELSE 'expired' END AS result FROM live)"""


def _checked_pages(spark, sf):
    from ..functions.text import html_to_text

    url = F.col("url")
    notice = F.when(url.contains("ref="), " 48 jobs found ").when(url.contains("#top"), " This position has been filled. ").otherwise("")
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.when(url.contains(".html"), 410).otherwise(200).alias("status"),
        F.when(url.endswith("/"), F.concat(url, F.lit("?error=true"))).otherwise(url).alias("final_url"),
        F.concat(F.when(url.contains("/es/"), "short").otherwise(html_to_text(F.col("html"))), notice).alias("body"),
        F.array(F.when(url.contains("https"), "Apply now").otherwise("Share")).alias("controls"),
    )
    verdict = liveness(F.col("status"), F.col("final_url"), F.col("body"), F.col("controls"))
    return rows.withColumn("v", verdict).select("page_id", "url", "v.result", "v.code", "v.reason")


@query("liveness_rules", f"WITH {_LIVE_SQL} SELECT page_id, result, code FROM verdict")
def liveness_rules(spark, sf):
    return _checked_pages(spark, sf).select("page_id", "result", "code")


_GUARDED_SQL = "CASE WHEN contains(url, 'spam-farm') THEN 'blocked_host' WHEN contains(url, 'cheap-pills') THEN 'unsupported_protocol' END"


@query(
    "liveness_routing",
    f"""WITH {_LIVE_SQL}, g AS (SELECT page_id, CASE WHEN {_GUARDED_SQL} IS NULL THEN result ELSE 'uncertain' END AS result, coalesce({_GUARDED_SQL}, code) AS code FROM verdict)
SELECT page_id, CASE WHEN result = 'expired' THEN 'expired' WHEN code IN ('blocked_host', 'unsupported_protocol') THEN 'invalid' WHEN code = 'no_apply_control' THEN 'dropped' ELSE 'verified' END AS bucket,
 CASE WHEN result = 'expired' THEN 'skipped_expired' WHEN code = 'blocked_host' THEN 'skipped_blocked_host' WHEN code = 'unsupported_protocol' THEN 'skipped_invalid_url'
 WHEN code = 'no_apply_control' THEN 'skipped_no_apply_control' ELSE 'added' END AS history FROM g""",
)
def liveness_routing(spark, sf):
    rows = _checked_pages(spark, sf)
    opened = F.when(F.col("url").contains("spam-farm"), "http://localhost/x").when(F.col("url").contains("cheap-pills"), "ftp://host/x").otherwise(F.col("url"))
    guarded = rows.withColumn("guard", url_guard(opened))
    code = F.coalesce("guard", "code")
    result = F.when(F.col("guard").isNotNull(), "uncertain").otherwise(F.col("result"))
    return guarded.select("page_id", route(result, code).alias("bucket"), history_status(result, code).alias("history"))


@query("liveness_counts", f"WITH {_LIVE_SQL} SELECT result, count(*) AS n FROM verdict GROUP BY result")
def liveness_counts(spark, sf):
    return counts_by(_checked_pages(spark, sf), "result")


# Form fields made from order lines: the label follows from the line's own columns.
_LABEL_SQL = """CASE WHEN l_linenumber = 1 THEN 'First Name *' WHEN l_linenumber = 2 THEN 'Your  Email:' WHEN l_linenumber = 3 THEN 'Desired salary' WHEN l_linenumber = 4 THEN 'Gender'
 WHEN l_linenumber = 5 THEN 'Why us?' WHEN l_linenumber = 6 THEN CASE WHEN l_returnflag = 'A' THEN 'Resume/CV' ELSE 'Attach your resume file' END ELSE 'Favourite ' || l_linestatus || '?' END"""
_KIND_SQL = """CASE WHEN l_linenumber IN (1, 2) THEN 'standard' WHEN l_linenumber = 3 THEN 'salary' WHEN l_linenumber = 4 THEN 'demographic' WHEN l_linenumber = 5 THEN 'free_text'
 WHEN l_linenumber = 6 THEN CASE WHEN l_returnflag <> 'A' THEN 'file' WHEN l_quantity > 40 THEN 'free_text' ELSE 'unmapped' END WHEN l_linestatus = 'O' THEN 'standard' WHEN l_quantity > 40 THEN 'free_text' ELSE 'unmapped' END"""
_FIELDS_SQL = f"""fields AS (SELECT l_orderkey, l_linenumber, {_KIND_SQL} AS kind,
 CASE WHEN l_linenumber = 1 THEN 'first_name' WHEN l_linenumber = 2 THEN 'email' WHEN l_linenumber = 6 AND l_returnflag <> 'A' THEN 'resume' WHEN l_linenumber > 6 AND l_linestatus = 'O' THEN 'how_did_you_hear' END AS profile_key,
 l_discount > 0.03 AS required, {_LABEL_SQL} AS label, CASE WHEN l_tax > 0.02 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE ' ' END AS value FROM lineitem)"""


def form_fields(spark, sf):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    label = (
        F.when(n == 1, "First Name *").when(n == 2, "Your  Email:").when(n == 3, "Desired salary").when(n == 4, "Gender").when(n == 5, "Why us?")
        .when(n == 6, F.when(flag == "A", "Resume/CV").otherwise("Attach your resume file"))
        .otherwise(F.concat(F.lit("Favourite "), "l_linestatus", F.lit("?")))
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", label.alias("label"), (F.col("l_discount") > 0.03).alias("required"),
        F.when(F.col("l_quantity") > 40, 500).otherwise(100).alias("maxlength"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("int").cast("string")).otherwise(" ").alias("value"), "l_partkey", "l_suppkey",
    )
    # Labels the user has assigned by hand: a config-sized table.
    user_map = spark.createDataFrame([("favourite o?", "how_did_you_hear")], "norm_label string, mapped string")
    mapped = rows.withColumn("norm_label", norm_label(F.col("label"))).join(F.broadcast(user_map), "norm_label", "left")
    return with_field_kind(mapped, "label", F.lit("text"), "maxlength", "mapped", "k").withColumns({"kind": F.col("k.kind"), "profile_key": F.col("k.profile_key")}).drop("k", "mapped")


@query("field_classify", f"WITH {_FIELDS_SQL} SELECT l_orderkey, l_linenumber, kind, profile_key, label FROM fields")
def field_classify(spark, sf):
    return form_fields(spark, sf).select("l_orderkey", "l_linenumber", "kind", "profile_key", "label")


@query(
    "form_verdict",
    f"""WITH {_FIELDS_SQL} SELECT l_orderkey, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ('standard', 'file', 'free_text', 'salary', 'demographic', 'unmapped'))},
 bool_and(kind = 'standard') AS all_standard, count(*) FILTER (WHERE required AND kind <> 'standard') AS required_unresolved FROM fields GROUP BY l_orderkey""",
)
def form_verdict(spark, sf):
    return form_verdicts(form_fields(spark, sf), "l_orderkey")


@query("required_unresolved", f"WITH {_FIELDS_SQL} SELECT l_orderkey, l_linenumber, label, kind FROM fields WHERE required AND kind <> 'standard'")
def required_unresolved(spark, sf):
    return unresolved_required(form_fields(spark, sf)).select("l_orderkey", "l_linenumber", "label", "kind")


@query("learnable_answers", f"WITH {_FIELDS_SQL} SELECT l_orderkey, l_linenumber, value FROM fields WHERE trim(value) <> '' AND kind IN ('unmapped', 'demographic', 'free_text')")
def learnable_answers(spark, sf):
    return form_fields(spark, sf).where(learnable(F.col("kind"), F.col("value"))).select("l_orderkey", "l_linenumber", "value")


@query(
    "answer_memory",
    f"""WITH {_FIELDS_SQL}, seen AS (SELECT regexp_replace(regexp_replace(lower(label), '\\s+', ' ', 'g'), '[*:]+\\s*$', '') AS l, value, l_orderkey, l_linenumber FROM fields WHERE trim(value) <> ''),
l AS (SELECT trim(l) AS norm_label, arg_max(value, struct_pack(a := l_orderkey, b := l_linenumber, c := value)) AS value FROM seen GROUP BY 1)
SELECT norm_label, value FROM l UNION ALL SELECT 'notice period', '4 weeks'""",
)
def answer_memory(spark, sf):
    rows = form_fields(spark, sf).withColumn("type", F.lit("text"))
    memory = spark.createDataFrame(
        [("notice period", "4 weeks", "text", "Notice period"), ("gender", "-", "select", "Gender")], "norm_label string, value string, type string, label string"
    )
    return remember_answers(memory, rows.drop("norm_label"), ["l_orderkey", "l_linenumber", "value"]).select("norm_label", "value")


@query(
    "answer_plan",
    f"""WITH {_FIELDS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN label IN ('Gender', 'Attach your resume file', 'First Name *') AND kind NOT IN ('file', 'standard') THEN 'remembered' ELSE kind END AS plan_kind,
 CASE WHEN profile_key = 'first_name' THEN 'Ada' WHEN label = 'Gender' THEN 'prefer not to say' ELSE '' END AS plan_value FROM fields""",
)
def answer_plan_query(spark, sf):
    profile = spark.createDataFrame([("first_name", "Ada")], "profile_key string, value string")
    memory = spark.createDataFrame(
        [("gender", "prefer not to say"), ("attach your resume file", "x"), ("first name", "Bob")], "norm_label string, value string"
    )
    plan = answer_plan(form_fields(spark, sf), profile, memory)
    return plan.select("l_orderkey", "l_linenumber", "plan_kind", "plan_value")
