"""Applications: folding status events, the open-application cap, tracker rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import canonical_status, is_open
from ..functions.text import or_else, relative_report_link, report_file, strip, table_cell
from ..functions.urls import company_key, listing_id
from .patches import latest_values, merge_structs
from .sequence import DAY, status_changes
from .skew import lookup, number_in_order

RECRUITER = ("name", "email", "phone", "notes")
# Columns an event may set; a later value replaces an earlier one, a missing value never does.
EVENT_COLUMNS = ("company", "company_key", "title", "apply_url", "cv_pdf", "pdf", "confirmation", "report", "score", "notes")


def normal_events(events: DataFrame) -> DataFrame:
    """Events with canonical statuses (null where the event has none)."""
    given = F.coalesce(F.col("status"), F.lit("")) != ""
    return events.withColumn("status", F.when(given, canonical_status(F.col("status"))))


def timeline_events(events: DataFrame, applications: DataFrame, ts: str, tie: str, chunk_seconds: int = DAY) -> DataFrame:
    """New timeline rows (key, status, date, note): only changes, and the first event of a new key."""
    prior = applications.select("key", "status")
    stated = normal_events(events)
    first = stated.groupBy("key").agg(F.min(F.struct(ts, tie)).alias("__first"))
    # A first event without a status opens a new application as Applied; other events
    # without one keep the status and are no change.
    opened = (
        lookup(lookup(stated, first, "key"), prior.select("key", F.lit(1).alias("__known")), "key")
        .withColumn(
            "status",
            F.when(F.col("status").isNull() & F.col("__known").isNull() & (F.struct(ts, tie) == F.col("__first")), "Applied")
            .otherwise(F.col("status")),
        ).drop("__first", "__known").where("status IS NOT NULL")
    )
    changes = status_changes(opened, "key", ts, tie, "status", prior, chunk_seconds)
    day = F.coalesce(F.col("date"), F.to_date(ts))
    return changes.select("key", "status", day.alias("date"), F.coalesce("note", F.lit("")).alias("note"), F.col(ts), F.col(tie))


def upsert_applications(
    applications: DataFrame, events: DataFrame, ts: str, tie: str, today: Column, chunk_seconds: int = DAY, highest: DataFrame | None = None
) -> DataFrame:
    """Applications after a batch of events, one row per key.

    ``applications`` may be a part of the table that holds all keys of the events; then ``highest`` (one row, one
    column) is the highest number of the whole table.

    Per key the events are folded in time order: last given value per column, recruiter merged field
    by field, status the last stated one, date_applied set once. New keys get the next tracker
    numbers in order of their first event. The timeline stays in its own table
    (:func:`timeline_events`).
    """
    stated = normal_events(events)
    day = F.coalesce(F.col("date"), F.to_date(ts))
    flat = stated.withColumns({
        "__day": day, **{f"__r_{f}": F.col(f"recruiter.{f}") for f in RECRUITER},
    })
    columns = [c for c in EVENT_COLUMNS if c in events.columns]
    last = latest_values(flat, ["key"], [ts, tie], ["status", *columns, *[f"__r_{f}" for f in RECRUITER]])
    first = flat.groupBy("key").agg(F.min_by("__day", F.struct(ts, tie)).alias("__first_day"), F.min(ts).alias("__first_ts"))
    folded = last.join(first, "key").select(
        "key", "__first_day", "__first_ts", F.col("status").alias("__n_status"),
        *[F.col(c).alias(f"__n_{c}") for c in columns],
        F.struct(*[F.col(f"__r_{f}").alias(f) for f in RECRUITER]).alias("__n_recruiter"),
    )
    start = highest if highest is not None else applications.select(F.coalesce(F.max("tracker_num"), F.lit(0)).alias("__max"))
    fresh = folded.join(applications.select("key"), "key", "left_anti").select("key", "__first_ts")
    numbered = number_in_order(fresh, ["__first_ts", "key"], "__num")
    # One-row scalar: the highest number so far.
    numbered = numbered.withColumn("__num", F.col("__num") + start.scalar()).select("key", "__num")

    both = applications.join(folded, "key", "full_outer").join(numbered, "key", "left")
    known = F.col("tracker_num").isNotNull()
    touched = F.col("__first_ts").isNotNull()
    out = {
        "tracker_num": F.coalesce("tracker_num", "__num").cast("int"),
        "status": F.coalesce("__n_status", "status", F.lit("Applied")),
        "recruiter": merge_structs(F.col("recruiter"), F.col("__n_recruiter"), RECRUITER),
        "date_applied": F.coalesce("date_applied", "__first_day"),
        "last_updated": F.when(touched, today).otherwise(F.col("last_updated")),
    }
    for c in columns:
        filled = F.coalesce(F.col(f"__n_{c}"), F.col(c))
        out[c] = filled if c == "score" else F.when(known, filled).otherwise(F.coalesce(filled, F.lit("")))
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in applications.columns])


def sync_decisions(personal: DataFrame, applications: DataFrame) -> DataFrame:
    """Mark listings as applied that have a real application, by key or by listing id."""
    applied = applications.where("status IS NOT NULL AND status <> 'Evaluated'")
    by_key = applied.select("key").distinct().withColumn("__by_key", F.lit(True))
    by_id = (
        applied.select(F.nullif(listing_id(F.col("key")), F.lit("")).alias("__id")).where("__id IS NOT NULL")
        .distinct().withColumn("__by_id", F.lit(True))
    )
    tagged = personal.withColumn("__id", F.nullif(listing_id(F.col("key")), F.lit("")))
    joined = lookup(tagged, by_id, "__id").join(by_key, "key", "left")
    hit = F.col("__by_key").isNotNull() | F.col("__by_id").isNotNull()
    changed = hit & (F.coalesce(F.col("decision"), F.lit("")) != "applied")
    return joined.select(*[
        F.when(hit, "applied").otherwise(F.col("decision")).alias("decision") if c == "decision"
        else F.when(changed, or_else(F.col("last_reviewed"), F.lit("web"))).otherwise(F.col("last_reviewed")).alias(c)
        if c == "last_reviewed" else F.col(c)
        for c in personal.columns
    ])


def with_company_key(applications: DataFrame, registry: DataFrame) -> DataFrame:
    """Company of each application: the stored key, else the listing's, else from its URL."""
    via = registry.select("key", F.col("company_key").alias("__via"))
    joined = applications.join(via, "key", "left")
    derived = company_key(F.lit(""), or_else(F.col("apply_url"), F.col("key")))
    filled = or_else(F.col("company_key"), F.col("__via"), derived)
    return joined.select(*[filled.alias(c) if c == "company_key" else F.col(c) for c in applications.columns])


def open_per_company(applications: DataFrame, group: str = "company_key") -> DataFrame:
    """Number of applications per company that are still in play."""
    return (
        applications.where(is_open(F.col("status")) & (F.coalesce(F.col(group).cast("string"), F.lit("")) != ""))
        .groupBy(group).agg(F.count(F.lit(1)).alias("open_count"))
    )


def capped_companies(open_counts: DataFrame, max_open: int) -> DataFrame:
    return open_counts.where(F.col("open_count") >= max_open)


def with_cap(listings: DataFrame, open_counts: DataFrame, max_open: int, group: str = "company_key") -> DataFrame:
    """Add open_count and capped to each listing."""
    joined = lookup(listings, open_counts, group)
    n = F.coalesce(F.col("open_count"), F.lit(0)).cast("long")
    return joined.withColumn("open_count", n).withColumn("capped", F.col("open_count") >= max_open)


def applications_view(applications: DataFrame, registry: DataFrame) -> DataFrame:
    """Applications with the listing's values where they have none, newest first."""
    r = registry.select(
        "key", *[F.col(c).alias(f"__r_{c}") for c in ("company", "title", "apply_url", "url", "provider", "location", "has_body")]
    )
    joined = applications.join(r, "key", "left")
    return joined.select(
        "key", "tracker_num",
        or_else(F.col("company"), F.col("__r_company")).alias("company"),
        or_else(F.col("title"), F.col("__r_title")).alias("title"),
        "status", "date_applied",
        or_else(F.col("apply_url"), F.col("__r_apply_url"), F.col("__r_url")).alias("apply_url"),
        or_else(F.col("__r_url")).alias("url"),
        or_else(F.col("__r_provider")).alias("provider"),
        or_else(F.col("__r_location")).alias("location"),
        report_file(F.col("report")).alias("report"),
        F.coalesce("__r_has_body", F.lit(False)).alias("has_body"),
        "recruiter", "confirmation", "notes",
    ).orderBy(F.desc_nulls_last("date_applied"), F.desc("tracker_num"))


def search_applications(view: DataFrame, state: str = "open", status: str | None = None, text: str | None = None) -> DataFrame:
    """Open, closed or all applications, with a status and a free text over seven columns."""
    rows = view
    if state == "open":
        rows = rows.where(is_open(F.col("status")))
    elif state == "closed":
        rows = rows.where(~is_open(F.col("status")))
    if status:
        rows = rows.where(F.col("status") == status)
    if text and text.strip():
        words = [F.col(c) for c in ("company", "title", "status", "confirmation", "notes", "recruiter.name", "recruiter.email")]
        joined = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in words])
        rows = rows.where(F.lower(joined).contains(text.strip().lower()))
    return rows


TRACKER_HEADER = (
    "# Applications",
    "",
    "| # | Date | Company | Role | Score | Status | PDF | Report | Notes |",
    "|---|------|---------|------|-------|--------|-----|--------|-------|",
)


def tracker_rows(applications: DataFrame, to_root: str = "../") -> DataFrame:
    """The tracker table as text lines (tracker_num, line)."""
    score = F.col("score").cast("string")
    shown = F.when(F.coalesce(score, F.lit("")) == "", "—").when(score.endswith("/5"), score).otherwise(F.concat(score, F.lit("/5")))
    pdf = or_else(F.col("pdf"), F.when(F.coalesce(F.col("cv_pdf"), F.lit("")) != "", "✅").otherwise("❌"))
    report = relative_report_link(F.coalesce(F.col("report"), F.lit("")), to_root)
    cells = [
        F.col("tracker_num").cast("string"), table_cell(F.col("date_applied").cast("string")), table_cell(F.col("company")),
        table_cell(F.col("title")), table_cell(shown), table_cell(F.col("status")), pdf, report, table_cell(F.col("notes")),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return applications.select("tracker_num", line.alias("line"))


def merge_additions(additions: DataFrame, applications: DataFrame, order: str) -> DataFrame:
    """Re-evaluations merged into applications: a row is replaced only by a higher score.

    Rows belong together when company and role agree (lower case, trimmed); of several additions the
    best score counts. ``additions`` come as status before score, the applications' own columns decide
    the output order. New pairs are returned with a null key and number, to be upserted.
    """
    def pair(df: DataFrame) -> DataFrame:
        return df.withColumns({c: strip(F.lower(F.coalesce(F.col(s), F.lit("")))) for c, s in (("__c", "company"), ("__t", "title"))})

    best = pair(additions).groupBy("__c", "__t").agg(
        F.max_by(F.struct("company", "title", "status", "score", "report", "notes"), F.struct(F.col("score"), -F.col(order))).alias("__a")
    )
    joined = pair(applications).join(best, ["__c", "__t"], "full_outer")
    new = F.col("key").isNull() & F.col("tracker_num").isNull()
    better = new | F.coalesce(F.col("__a.score") > F.col("score"), F.col("score").isNull())
    replace = ("status", "score", "report", "notes")
    return joined.select(*[
        F.when(new, F.col(f"__a.{c}")).otherwise(F.col(c)).alias(c) if c in ("company", "title")
        else F.when(F.col("__a").isNotNull() & better, F.coalesce(F.col(f"__a.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in replace
        else F.col(c)
        for c in applications.columns
    ])
