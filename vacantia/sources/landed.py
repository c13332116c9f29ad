"""Reading landed files: every reader states its schema and never infers one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_missing, or_else, strip
from ..functions.status import canonical_status
from ..functions.urls import first_urls

COMP = T.StructType([
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("currency", T.StringType()), T.StructField("equity", T.BooleanType()),
])
TEXT = ("url", "apply_url", "title", "company", "location", "description", "department", "date_posted")
RAW_SCAN = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField("comp", COMP)]
    + [T.StructField(c, T.StringType()) for c in ("employment_type", "provider", "careers_url", "source")]
)
SCAN_META = T.StructType([
    T.StructField("scanned_at", T.StringType()), T.StructField("companies", T.ArrayType(T.StringType())),
    T.StructField("partial", T.BooleanType()),
])
HISTORY = T.StructType([
    T.StructField(c, T.StringType()) for c in ("url", "first_seen", "portal", "title", "company", "status", "location")
])
BATCH_INPUT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "url", "source", "notes")])
BATCH_STATE = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("id", "url", "status", "started_at", "completed_at", "report_num", "score", "error", "retries")
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines source, and the lines that could not be read (``_corrupt``).

    Blank lines are ignored. Bad lines are kept apart instead of being lost.
    """
    return parse_jsonl(spark.read.text(path), schema)


def parse_jsonl(lines: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Same as :func:`read_jsonl` for lines that are already in a table."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.where(strip(F.col(column)) != "").select(F.from_json(column, with_bad, options).alias("r")).select("r.*")
    good = parsed.where("_corrupt IS NULL").drop("_corrupt")
    return good, parsed.where("_corrupt IS NOT NULL").select("_corrupt")


def read_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A raw scan file: its rows (those with a URL) and its one-row meta record."""
    return split_scan(spark.read.text(path))


def split_scan(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    schema = T.StructType([*RAW_SCAN.fields, T.StructField("_meta", SCAN_META)])
    rows, _ = parse_jsonl(lines, schema, column)
    meta = rows.where("_meta IS NOT NULL").select("_meta.*")
    return rows.where("_meta IS NULL AND coalesce(url, '') <> ''").drop("_meta"), meta


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Scan history: tab-separated with a header; files without the location column are fine."""
    return spark.read.csv(path, sep="\t", header=True, schema=HISTORY, mode="PERMISSIVE", enforceSchema=True)


def checklist_urls(lines: DataFrame, column: str = "value") -> DataFrame:
    """URLs of ``- [ ] url`` and ``- [x] url`` items with their done flag."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"- \[[ x]\] https?://\S+"), F.lit(0))
    items = lines.select(F.explode(found).alias("item"))
    return items.select(
        F.regexp_extract("item", r"https?://\S+", 0).alias("url"), F.col("item").startswith("- [x]").alias("done")
    )


def checklist_items(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pending items ``- [ ] url | company | title`` as columns."""
    pattern = r"^\s*- \[([ x])\] (https?://\S+)(?:\s*\|\s*([^|]*?))?(?:\s*\|\s*(.*?))?\s*$"
    hit = lines.where(F.col(column).rlike(pattern))
    part = lambda i: F.regexp_extract(column, pattern, i)
    return hit.select(part(2).alias("url"), part(3).alias("company"), part(4).alias("title"), (part(1) == "x").alias("done"))


def urls_in_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.explode(first_urls(F.col(column))).alias("url"))


def table_cells(column: str = "value") -> Column:
    """Cells of a Markdown table line, trimmed; the first and last are the outer edges."""
    return F.transform(F.split(F.col(column), r"\|"), lambda c: strip(c))


def tracker_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(company, role) of tracker table lines, lower case, without the header."""
    cells = lines.where(F.col(column).startswith("|")).select(table_cells(column).alias("c")).where(F.size("c") >= 6)
    pairs = cells.select(F.lower(F.get("c", F.lit(3))).alias("company_lc"), F.lower(F.get("c", F.lit(4))).alias("role_lc"))
    real = "company_lc <> '' AND role_lc <> '' AND company_lc <> 'company' AND NOT company_lc RLIKE '^:?-+:?$'"
    return pairs.where(real).distinct()


def tracker_applications(lines: DataFrame, known_numbers: DataFrame, column: str = "value") -> DataFrame:
    """Tracker table lines as application rows, without header, separators and known numbers.

    Of lines with the same number the first one counts, as a whole.
    """
    usable = F.col(column).startswith("|") & ~F.col(column).contains("---") & ~F.col(column).rlike(r"\b#\b.*Date.*Company")
    placed = lines.withColumn("__at", F.monotonically_increasing_id())
    cells = placed.where(usable).select("__at", table_cells(column).alias("c")).where(F.size("c") >= 10)
    number = F.regexp_extract(F.get("c", F.lit(1)), r"^[+-]?\d+", 0).try_cast("int")
    rows = cells.select(
        "__at", number.alias("tracker_num"), F.get("c", F.lit(2)).alias("date_applied"), F.get("c", F.lit(3)).alias("company"),
        F.get("c", F.lit(4)).alias("title"), F.nullif(F.nullif(F.get("c", F.lit(5)), F.lit("—")), F.lit("")).alias("score"),
        canonical_status(or_else(F.get("c", F.lit(6)), F.lit("Evaluated"))).alias("status"),
        F.get("c", F.lit(7)).alias("pdf"), F.get("c", F.lit(8)).alias("report"), F.get("c", F.lit(9)).alias("notes"),
    ).where("coalesce(tracker_num, 0) <> 0")
    values = [c for c in rows.columns if c not in ("__at", "tracker_num")]
    first = rows.groupBy("tracker_num").agg(F.min_by(F.struct(*values), "__at").alias("r")).select("tracker_num", "r.*")
    return first.join(known_numbers.select("tracker_num").distinct(), "tracker_num", "left_anti")


def tracker_status_by_number(lines: DataFrame, column: str = "value") -> DataFrame:
    """(num, status): report number in the link cell → status cell of a tracker line."""
    cells = lines.select(table_cells(column).alias("c")).where(F.size("c") >= 8)
    link = F.filter("c", lambda x: x.rlike(r"\]\(.*reports/"))
    num = F.regexp_extract(F.try_element_at(link, F.lit(1)), r"(\d+)\]", 1)
    return cells.select(num.alias("num"), F.get("c", F.lit(6)).alias("status")).where("coalesce(num, '') <> ''")


def read_json_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document with a ``jobs`` array → job rows with title and url."""
    return explode_jobs(spark.read.text(path, wholetext=True))


CACHED_JOB = T.StructType([
    T.StructField(c, T.StringType()) for c in ("title", "url", "company", "location", "source_site", "date_posted")
])


def explode_jobs(documents: DataFrame, column: str = "value") -> DataFrame:
    schema = T.StructType([T.StructField("fetched_at", T.StringType()), T.StructField("jobs", T.ArrayType(CACHED_JOB))])
    jobs = documents.select(F.explode(F.from_json(column, schema)["jobs"]).alias("j")).select("j.*")
    cleaned = jobs.select(*[clean_missing(F.col(c)).alias(c) for c in jobs.columns])
    return cleaned.where("title <> '' AND url <> ''")


_CSV_LINE = r'^(.*),([^,]*),([^,]*)$'


def read_company_csvs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of ``<provider>.csv`` files with name, slug, url; names may hold commas."""
    lines = spark.read.text(path).withColumn(
        "provider", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    )
    return company_lines(lines)


def company_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(provider, value) lines → name, slug, url. The header and short lines are dropped."""
    text = strip(F.col(column))
    part = lambda i: F.regexp_extract(text, _CSV_LINE, i)
    rows = lines.where(text.rlike(_CSV_LINE) & ~F.lower(text).rlike("^name,slug,")).select(
        "provider", strip(F.regexp_replace(part(1), '^"|"$', "")).alias("name"), part(2).alias("slug"), part(3).alias("careers_url")
    )
    return rows.where("name <> '' AND slug <> ''")


def careers_urls(companies: DataFrame) -> DataFrame:
    """Lookup table (provider, slug) → careers_url of a company list."""
    return companies.groupBy("provider", "slug").agg(F.max("careers_url").alias("careers_url"))


def read_batch_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Batch input or state; ``-`` stands for no value."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return rows.select(*[F.nullif(F.col(c), F.lit("-")).alias(c) for c in rows.columns])


def batch_state_types(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"score": F.col("score").try_cast("double"), "retries": F.coalesce(F.col("retries").try_cast("int"), F.lit(0))})


def names_in_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Names of ``- name: …`` lines, without quotes, in lower case."""
    pattern = r"^\s*-\s*name:\s*(.+?)\s*$"
    name = F.lower(F.regexp_replace(F.regexp_extract(column, pattern, 1), "^[\"']|[\"']$", ""))
    return lines.where(F.col(column).rlike(pattern)).select(name.alias("name")).distinct()


def existing_names(companies: DataFrame, name: str = "name") -> DataFrame:
    return companies.select(F.lower(name).alias("name")).distinct()


PATCH = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("rank", T.DoubleType()), T.StructField("fit", T.DoubleType()),
    T.StructField("reason", T.StringType()), T.StructField("fit_brief", T.StringType()),
    T.StructField("company_type", T.StringType()),
    T.StructField("dim_scores", T.MapType(T.StringType(), T.DoubleType())),
])


def read_patch(spark: SparkSession, path: str, schema: T.StructType = PATCH) -> DataFrame:
    """A result file (one JSON array) as patch rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("p")).select("p.*")


