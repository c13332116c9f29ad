"""Text normalisers over pages, documents, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.classes import archetypes, company_type, excluded_type, own_links
from ..sources.documents import labelled_columns, parse_notes, parse_reports
from .registry import query, table

TRIM = r"regexp_replace({0}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


def fill(template: str, sql: str) -> str:
    return template.replace("{0}", sql)


def trim(sql: str) -> str:
    return fill(TRIM, sql)


_TAGS = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '<\s*br\s*/?>', chr(10), 'gi'), '</p>', chr(10) || chr(10), 'gi'), '</li>', chr(10), 'gi'),
  '<li[^>]*>', '• ', 'gi'), '<[^>]+>', '', 'g')"""
_ENTITIES = (
    "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
    "'&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
)
_BLANKS = r"regexp_replace(regexp_replace({0}, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')"
HTML_SQL = trim(fill(_BLANKS, fill(_ENTITIES, _TAGS)))


@query("html_to_text", f"SELECT page_id, {fill(HTML_SQL, 'html')} AS body FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("body"))


@query(
    "escaped_html_to_text",
    "SELECT page_id, "
    + fill(HTML_SQL, fill(_ENTITIES, "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"))
    + " AS body FROM pages",
)
def escaped_html_to_text(spark, sf):
    escaped = F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(spark, sf, "pages").select("page_id", tx.html_to_text(escaped, escaped=True).alias("body"))


@query(
    "excerpt",
    "WITH b AS (SELECT doc_id, " + trim("array_to_string(list_slice(string_split(text, chr(10)), 3, len(string_split(text, chr(10)))), chr(10))")
    + " AS rest FROM documents) SELECT doc_id, CASE WHEN length(rest) > 200 THEN substr(rest, 1, 200) || '…' ELSE rest END AS excerpt FROM b",
)
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.excerpt(F.col("text"), 200, 2).alias("excerpt"))


@query(
    "contact_parse",
    r"""
WITH p AS (
  SELECT doc_id, text, regexp_extract(text, '[\w.+-]+@[\w.-]+\.\w+') AS email,
         """ + trim(r"regexp_extract(text, '\+?[\d][\d\s().-]{6,}')") + r""" AS phone,
         regexp_replace(text, '<[^>]*>', '', 'g') AS bare FROM documents),
q AS (SELECT *, CASE WHEN email <> '' AND strpos(bare, email) > 0
  THEN substr(bare, 1, strpos(bare, email) - 1) || substr(bare, strpos(bare, email) + length(email)) ELSE bare END AS b1 FROM p),
r AS (SELECT *, CASE WHEN phone <> '' AND strpos(b1, phone) > 0
  THEN substr(b1, 1, strpos(b1, phone) - 1) || substr(b1, strpos(b1, phone) + length(phone)) ELSE b1 END AS b2 FROM q)
SELECT doc_id, email, phone, """ + trim("regexp_replace(b2, '[,;]', ' ', 'g')") + " AS name FROM r",
)
def contact_parse(spark, sf):
    parts = tx.contact_parts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", parts.alias("p")).select("doc_id", "p.email", "p.phone", "p.name")


@query(
    "plain_punctuation",
    "SELECT doc_id, replace(replace(translate(replace(text, chr(8203), ''), '—–“”‘’' || chr(160), '--\"\"'''' '), '…', '...'), chr(8203), '') AS plain FROM documents",
)
def plain_punctuation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.plain_punctuation(F.col("text")).alias("plain"))


@query(
    "table_cell",
    "SELECT p_partkey, "
    + trim(r"replace(regexp_replace(p_brand || ' | ' || p_name || chr(10) || p_type, '[\s\p{Z}]*\|[\s\p{Z}]*', ' / ', 'g'), chr(10), ' ')")
    + " AS cell FROM part",
)
def table_cell(spark, sf):
    raw = F.concat("p_brand", F.lit(" | "), "p_name", F.lit("\n"), "p_type")
    return table(spark, sf, "part").select("p_partkey", tx.table_cell(raw).alias("cell"))


@query("file_safe_key", "SELECT c_custkey, replace(replace(lower(c_mktsegment) || ':' || c_name || '/jobs', ':', '-'), '/', '-') AS file_key FROM customer")
def file_safe_key(spark, sf):
    key = F.concat(F.lower("c_mktsegment"), F.lit(":"), "c_name", F.lit("/jobs"))
    return table(spark, sf, "customer").select("c_custkey", tx.file_safe_key(key).alias("file_key"))


@query(
    "label_normalise",
    r"SELECT conv_id, turn, " + trim(r"regexp_replace(regexp_replace(lower(role || '  ' || text || ' *:'), '[\s\p{Z}]+', ' ', 'g'), '[*:]+\s*$', '')")
    + " AS label FROM conversations",
)
def label_normalise(spark, sf):
    raw = F.concat("role", F.lit("  "), "text", F.lit(" *:"))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.norm_label(raw).alias("label"))


@query(
    "clean_missing",
    "SELECT event_id, CASE WHEN event_type = 'error' OR value IS NULL THEN '' ELSE CAST(CAST(round(value) AS BIGINT) AS VARCHAR) END AS value_text, "
    + trim("'  ' || event_type || chr(9)") + " AS type_text FROM events",
)
def clean_missing(spark, sf):
    # Errors carry no value: they become NaN, as a missing number does in a data frame.
    number = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.round("value"))
    text = tx.clean_missing(number, floating=True)
    return table(spark, sf, "events").select(
        "event_id",
        F.when(text == "", "").otherwise(text.try_cast("double").cast("bigint").cast("string")).alias("value_text"),
        tx.clean_missing(F.concat(F.lit("  "), "event_type", F.lit("\t"))).alias("type_text"),
    )


@query(
    "name_from_slug",
    "WITH s AS (SELECT p_partkey, lower(p_type) || '_' || replace(p_name, ' ', '-') AS slug FROM part) "
    "SELECT p_partkey, array_to_string(list_transform(string_split(replace(slug, '_', '-'), '-'), "
    "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS name FROM s",
)
def name_from_slug(spark, sf):
    slug = F.concat(F.lower("p_type"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", tx.name_from_slug(slug).alias("name"))


@query(
    "title_from_page",
    r"""
WITH s AS (SELECT p_partkey, 'Careers at ' || p_brand || ' - ' || p_name || ' job application | greenhouse ' AS page_title, p_brand AS company FROM part),
a AS (SELECT *, replace(trim(page_title), company, '') AS t FROM s),
b AS (SELECT *, regexp_replace(t, '\b(careers|job application|apply|recruiting|hiring|workday|ashby|greenhouse|lever)\b', '', 'gi') AS u FROM a)
SELECT p_partkey, trim(regexp_replace(u, '^[^a-zA-Z0-9(]+|[^a-zA-Z0-9)]+$', '', 'g')) AS title FROM b""",
)
def title_from_page(spark, sf):
    page = F.concat(F.lit("Careers at "), "p_brand", F.lit(" - "), "p_name", F.lit(" job application | greenhouse "))
    return table(spark, sf, "part").select("p_partkey", tx.title_from_page(page, F.col("p_brand")).alias("title"))


@query(
    "split_result_title",
    r"""
WITH s AS (SELECT s_suppkey, n_name || ' engineer' || CASE WHEN s_acctbal < 3000 THEN ' @ ' WHEN s_acctbal < 6000 THEN ' at ' WHEN s_acctbal < 8000 THEN ' | ' ELSE ' ' END || s_name AS t
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey,
  CASE WHEN regexp_matches(t, '^(.+?)(?:\s*[@|—–-]\s*|\s+at\s+)(.+?)$') THEN regexp_extract(t, '^(.+?)(?:\s*[@|—–-]\s*|\s+at\s+)(.+?)$', 1) END AS title,
  CASE WHEN regexp_matches(t, '^(.+?)(?:\s*[@|—–-]\s*|\s+at\s+)(.+?)$') THEN regexp_extract(t, '^(.+?)(?:\s*[@|—–-]\s*|\s+at\s+)(.+?)$', 2) END AS company
FROM s""",
)
def split_result_title(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    glue = F.when(F.col("s_acctbal") < 3000, " @ ").when(F.col("s_acctbal") < 6000, " at ").when(F.col("s_acctbal") < 8000, " | ").otherwise(" ")
    parts = tx.split_result_title(F.concat("n_name", F.lit(" engineer"), glue, "s_name"))
    return rows.select("s_suppkey", parts["title"].alias("title"), parts["company"].alias("company"))


@query(
    "money_label",
    """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS lo,
  CASE WHEN o_orderstatus <> 'O' THEN o_totalprice * 2 END AS hi, CASE WHEN o_orderpriority <> '5-LOW' THEN 'CAD' END AS cur FROM orders)
SELECT o_orderkey, concat_ws('–', '$' || CAST(CAST(floor(lo / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k',
  '$' || CAST(CAST(floor(hi / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k') || CASE WHEN cur IS NOT NULL THEN ' ' || cur ELSE '' END AS pay FROM s""",
)
def money_label(spark, sf):
    low = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    high = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") * 2)
    currency = F.when(F.col("o_orderpriority") != "5-LOW", "CAD")
    return table(spark, sf, "orders").select("o_orderkey", tx.money_label(low, high, currency).alias("pay"))


_REPORT_CELL = "'[' || CAST(o_orderkey AS VARCHAR) || '](' || CASE WHEN o_orderstatus = 'F' THEN 'reports/' WHEN o_orderstatus = 'O' THEN '../reports/' ELSE 'https://x.org/' END || CAST(o_orderkey AS VARCHAR) || '-acme.md)'"


def _report_cell():
    folder = F.when(F.col("o_orderstatus") == "F", "reports/").when(F.col("o_orderstatus") == "O", "../reports/").otherwise("https://x.org/")
    number = F.col("o_orderkey").cast("string")
    return F.concat(F.lit("["), number, F.lit("]("), folder, number, F.lit("-acme.md)"))


@query("report_file", rf"SELECT o_orderkey, regexp_extract({_REPORT_CELL}, '([\w.\-]+\.md)', 1) AS report FROM orders")
def report_file(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.report_file(_report_cell()).alias("report"))


@query(
    "relative_report_link",
    rf"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN {_REPORT_CELL} ELSE replace(replace({_REPORT_CELL}, '../reports/', 'reports/'), 'reports/', '../reports/') END AS link FROM orders",
)
def relative_report_link(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.relative_report_link(_report_cell(), "../").alias("link"))


@query("score_class", "SELECT p_partkey, CASE WHEN p_size / 10.0 >= 4 THEN 'high' WHEN p_size / 10.0 >= 3 THEN 'mid' ELSE 'low' END AS band FROM part")
def score_class(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.score_class(F.col("p_size") / 10).alias("band"))


_TYPE_NAME = "CASE WHEN s.source IN ('src0', 'src1', 'src2', 'src3') THEN s.source || ' consulting' WHEN s.source IN ('src4', 'src5') THEN 'Infosys ' || s.source WHEN s.source IN ('src6', 'src7', 'src8') THEN s.source || ' recruitment' ELSE s.source END"


@query(
    "type_rules",
    rf"""
SELECT doc_id, kind, kind IN ('consulting', 'outsourcing', 'staffing', 'unresolved') AS excluded FROM (
SELECT doc_id, CASE
  WHEN regexp_matches({_TYPE_NAME}, '(?i)\b(infosys|wipro|cognizant)\b') THEN 'outsourcing'
  WHEN regexp_matches({_TYPE_NAME}, '(?i)\b(consult(ing|ancy)?|advisory)\b') THEN 'consulting'
  WHEN regexp_matches({_TYPE_NAME}, '(?i)\b(staffing|recruit(ing|ment))\b') THEN 'staffing'
  WHEN regexp_matches(lower(text), '\bconsultant\b|\bclient\b|staff\s*aug') THEN 'consulting' ELSE 'unknown' END AS kind FROM documents s)""",
)
def type_rules(spark, sf):
    source = F.col("source")
    name = (
        F.when(source.isin("src0", "src1", "src2", "src3"), F.concat(source, F.lit(" consulting")))
        .when(source.isin("src4", "src5"), F.concat(F.lit("Infosys "), source))
        .when(source.isin("src6", "src7", "src8"), F.concat(source, F.lit(" recruitment")))
        .otherwise(source)
    )
    kind = company_type(name, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), excluded_type(kind).alias("excluded"))


# The invented prose holds fragments rather than words, so the classes here list fragments.
_CLASSES = {"first": ("ention", "erth", "onwh"), "second": ("ouion", "eau", "eux"), "third": ("ción", "osa"), "fourth": ("ung", "isch", "erth")}


def _class_sum(words) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)


@query(
    "archetype_tags",
    "WITH c AS (SELECT doc_id, unnest([" + ", ".join(f"{{'n': {_class_sum(w)}, 'pos': {i}, 'tag': '{t}'}}" for i, (t, w) in enumerate(_CLASSES.items()))
    + "]) AS x FROM documents), r AS (SELECT doc_id, x.tag AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.pos) AS rn, x.n AS n FROM c WHERE x.n > 0) "
    "SELECT d.doc_id, coalesce(string_agg(r.tag, ',' ORDER BY rn), '') AS tags FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND rn <= 2 GROUP BY d.doc_id",
)
def archetype_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(archetypes(F.col("text"), _CLASSES), ",").alias("tags"))


@query(
    "archetype_default_tags",
    """WITH c AS (SELECT doc_id, lower(text) AS t FROM documents),
s AS (SELECT doc_id, unnest([
 {'n': contains(t,'observability')::INT + contains(t,'evals')::INT + contains(t,'pipelines')::INT + contains(t,'monitoring')::INT + contains(t,'reliability')::INT, 'pos': 0, 'tag': 'AI Platform / LLMOps'},
 {'n': contains(t,'agent')::INT + contains(t,'hitl')::INT + contains(t,'orchestration')::INT + contains(t,'workflow')::INT + contains(t,'multi-agent')::INT, 'pos': 1, 'tag': 'Agentic / Automation'},
 {'n': contains(t,'prd')::INT + contains(t,'roadmap')::INT + contains(t,'discovery')::INT + contains(t,'stakeholder')::INT + contains(t,'product manager')::INT, 'pos': 2, 'tag': 'Technical AI PM'},
 {'n': contains(t,'architecture')::INT + contains(t,'enterprise')::INT + contains(t,'integration')::INT + contains(t,'design')::INT + contains(t,'systems')::INT, 'pos': 3, 'tag': 'AI Solutions Architect'},
 {'n': contains(t,'client-facing')::INT + contains(t,'deploy')::INT + contains(t,'prototype')::INT + contains(t,'fast delivery')::INT + contains(t,'field')::INT, 'pos': 4, 'tag': 'AI Forward Deployed'},
 {'n': contains(t,'change management')::INT + contains(t,'adoption')::INT + contains(t,'enablement')::INT + contains(t,'transformation')::INT, 'pos': 5, 'tag': 'AI Transformation'}]) AS x FROM c),
r AS (SELECT doc_id, x.tag AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.pos) AS rn FROM s WHERE x.n > 0)
SELECT d.doc_id, coalesce(string_agg(r.tag, ',' ORDER BY rn), '') AS tags FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND rn <= 2 GROUP BY d.doc_id""",
)
def archetype_default_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(archetypes(F.col("text")), ",").alias("tags"))


# A research note made from each page: its own URL, a careers link on the same host, a blog
# elsewhere; pages in German name their sources as bare domains only.
_NOTE_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_NOTE_SQL = f"""CASE WHEN contains(url, '/de/') THEN 'Sources: ' || {_NOTE_HOST} || '/about, example.com/x.'
 ELSE 'See ' || url || ', https://' || {_NOTE_HOST} || '/careers; and https://blog.elsewhere.org/post).' END"""


def _note():
    h = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return F.when(F.col("url").contains("/de/"), F.concat(F.lit("Sources: "), h, F.lit("/about, example.com/x."))).otherwise(
        F.concat(F.lit("See "), F.col("url"), F.lit(", https://"), h, F.lit("/careers; and https://blog.elsewhere.org/post)."))
    )


@query(
    "own_links",
    rf"""
WITH n AS (SELECT page_id, {_NOTE_SQL} AS note, string_split({_NOTE_HOST}, '.')[-2] || ' inc' AS name, contains(url, '/de/') AS bare FROM pages),
u AS (SELECT page_id, name, CASE WHEN bare
   THEN list_transform(regexp_extract_all(note, '(?i)[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/[^\s,]*)?'), lambda x: 'https://' || regexp_replace(x, '[.,;]+$', ''))
   ELSE list_transform(regexp_extract_all(note, 'https?://[^\s,)<>"'']+'), lambda x: regexp_replace(x, '[.,;)]+$', '')) END AS urls FROM n),
e AS (SELECT page_id, name, unnest(urls) AS url, generate_subscripts(urls, 1) AS pos FROM u),
h AS (SELECT *, string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', ''), '.') AS parts,
  regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS nn FROM e),
o AS (SELECT *, parts[-2] AS ml, length(parts[-2]) >= 3 AND length(nn) >= 3 AND (contains(nn, parts[-2]) OR contains(parts[-2], substr(nn, 1, 8))) AS own FROM h),
k AS (SELECT *, bool_or(own) OVER (PARTITION BY page_id) AS any_own FROM o),
d AS (SELECT page_id, url, min(pos) AS pos FROM k WHERE own OR NOT any_own GROUP BY page_id, url),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS short FROM d)
SELECT page_id, rank, url, CASE WHEN length(short) > 48 THEN substr(short, 1, 47) || '…' ELSE short END AS label,
  CASE WHEN regexp_matches(url, '(?i)career|job') THEN 'careers' WHEN regexp_matches(url, '(?i)about|values|culture|handbook|life-?at|company') THEN 'about'
       WHEN regexp_matches(url, '(?i)blog|engineering') THEN 'blog' ELSE '' END AS tag
FROM r WHERE rank <= 8""",
)
def own_links_query(spark, sf):
    name = F.concat(F.element_at(F.split(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"\."), -2), F.lit(" inc"))
    pages = table(spark, sf, "pages").select("page_id", own_links(_note(), name).alias("links"))
    return pages.select("page_id", F.posexplode("links").alias("pos", "l")).select(
        "page_id", (F.col("pos") + 1).cast("long").alias("rank"), "l.url", "l.label", "l.tag"
    )


_DOSSIER = (
    "'# ' || c_name || ' — research' || chr(10) || 'Provider/key: ' || lower(c_mktsegment) || ':' || CAST(c_custkey AS VARCHAR) || ' | company_type: product' || chr(10) "
    "|| 'What they do: sells ' || lower(c_mktsegment) || '.' || chr(10) || CASE WHEN c_acctbal > 0 THEN 'Remote policy: remote-first ' || chr(10) ELSE '' END || 'Sources: a.example, b.example'"
)


def _dossier():
    return F.concat(
        F.lit("# "), "c_name", F.lit(" — research\nProvider/key: "), F.lower("c_mktsegment"), F.lit(":"), F.col("c_custkey").cast("string"),
        F.lit(" | company_type: product\nWhat they do: sells "), F.lower("c_mktsegment"), F.lit(".\n"),
        F.when(F.col("c_acctbal") > 0, "Remote policy: remote-first \n").otherwise(""), F.lit("Sources: a.example, b.example"),
    )


@query(
    "dossier_parse",
    """SELECT c_custkey, c_name AS title, lower(c_mktsegment) || ':' || CAST(c_custkey AS VARCHAR) AS key, 'product' AS company_type,
 'sells ' || lower(c_mktsegment) || '.' AS what_they_do, CASE WHEN c_acctbal > 0 THEN 'remote-first' END AS remote_policy,
 'a.example, b.example' AS sources, CAST(NULL AS VARCHAR) AS engineering FROM customer""",
)
def dossier_parse(spark, sf):
    notes = table(spark, sf, "customer").select("c_custkey", _dossier().alias("text"))
    return parse_notes(notes).select("c_custkey", "title", "key", "company_type", "what_they_do", "remote_policy", "sources", "engineering")


@query(
    "labelled_columns",
    "SELECT doc_id, source AS src, " + trim("lang") + " AS language, CAST(NULL AS VARCHAR) AS region FROM documents",
)
def labelled_columns_query(spark, sf):
    note = F.concat(F.lit("Source: "), "source", F.lit("\nLanguage:  "), "lang", F.lit("\n"), "text")
    rows = table(spark, sf, "documents").select("doc_id", note.alias("text"))
    return labelled_columns(rows, {"Source": "src", "Language": "language", "Region of the author": "region"}).drop("text")


@query(
    "report_corpus",
    r"""SELECT lpad(CAST(page_id AS VARCHAR), 3, '0') || '-site.md' AS file, lpad(CAST(page_id AS VARCHAR), 3, '0') AS num,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '://www\.', '://'), '([?&])(utm_source|ref)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/$', '') AS url FROM pages""",
)
def report_corpus(spark, sf):
    number = F.lpad(F.col("page_id").cast("string"), 3, "0")
    text = F.concat(F.lit("# Report\n**URL:** "), "url", F.lit("\nScore: 4/5"))
    return parse_reports(table(spark, sf, "pages").select(F.concat(number, F.lit("-site.md")).alias("file"), text.alias("text")))
