"""From job feeds to candidate companies, and batches of work."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import LONG_TEXT, PROFILE_KEYS, field_kind
from ..functions.keywords import first_exclusion, location_passes, title_passes
from ..functions.text import lower_strip, norm_name
from ..functions.urls import platform
from .skew import exclude, first_per_key, lookup, top_per_key


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def new_companies(found: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Companies whose name (any case) is not in the list yet."""
    known = existing.select(norm_name(F.col(name)).alias("known")).distinct()
    return exclude(found.withColumn("__n", norm_name(F.col(name))), known, {"__n": "known"}).drop("__n")


def drop_skipped(found: DataFrame, decisions: DataFrame, name: str = "name") -> DataFrame:
    """Companies nobody has decided to skip."""
    skipped = decisions.where("decision = 'skip'").select(norm_name(F.col(name)).alias("known")).distinct()
    return exclude(found.withColumn("__n", norm_name(F.col(name))), skipped, {"__n": "known"}).drop("__n")


def candidate_jobs(
    feed: DataFrame, positive: Sequence[str], negative: Sequence[str], locations: dict | None, exclusions: Sequence[str],
    existing: DataFrame, decisions: DataFrame,
) -> DataFrame:
    """Feed rows of new companies, each with the exclusion keyword it hits (null for candidates).

    ``feed``: company_name, title, description, location, url, tags, ord.
    """
    places = locations or {}
    rows = feed.where(
        (F.coalesce("company_name", F.lit("")) != "")
        & title_passes(F.col("title"), positive, negative)
        & location_passes(F.col("location"), places.get("always_allow"), places.get("allow"), places.get("block"))
    ).withColumn("name", F.col("company_name"))
    fresh = drop_skipped(new_companies(rows, existing), decisions).drop("name")
    hit = first_exclusion(exclusions, F.col("company_name"), F.col("title"), F.col("description"), tags=F.col("tags"))
    return fresh.withColumn("exclusion_matched", hit)


def group_companies(jobs: DataFrame, order: str, keep_jobs: int = 2) -> tuple[DataFrame, DataFrame]:
    """Companies (any spelling of a name is one) with their job count, and their first jobs as rows."""
    keyed = jobs.withColumn("company_lc", F.lower("company_name"))
    companies = keyed.groupBy("company_lc").agg(
        F.min_by("company_name", order).alias("name"), F.count(F.lit(1)).alias("n_jobs"), F.min(order).alias("first_seen_at")
    )
    return companies, top_per_key(keyed, ["company_lc"], [order], keep_jobs, "job_rank")


def log_exclusions(log: DataFrame, excluded: DataFrame, order: str, day: Column) -> DataFrame:
    """New rows of the exclusion log: the first hit per company not in the log yet."""
    keyed = excluded.where("exclusion_matched IS NOT NULL").withColumn("__n", F.lower("company_name"))
    fresh = exclude(keyed, log.select(F.lower("name").alias("known")).distinct(), {"__n": "known"})
    first = first_per_key(fresh, ["__n"], [order])
    return first.select(F.col("company_name").alias("name"), "exclusion_matched", day.alias("date_added"))


def fit_passes(fit: Column, minimum: float) -> Column:
    """Unscored companies pass; scored ones need the minimum. No minimum passes all."""
    return F.lit(True) if minimum <= 0 else (fit.isNull() | (fit >= minimum))


def company_entries(resolved: DataFrame, existing: DataFrame, min_fit: float = 0.0) -> DataFrame:
    """Rows to append to the company list, with the enabled flag and a note saying why.

    ``resolved``: name, careers_url, provider, count, fit, resolved.
    """
    rows = new_companies(resolved, existing).where(fit_passes(F.col("fit"), min_fit))
    board = platform(F.coalesce("careers_url", F.lit("")))
    fit = F.when(F.col("fit").isNotNull(), F.format_string(", fit %s/5", F.col("fit").cast("string"))).otherwise("")
    note = (
        F.when(F.col("resolved"), F.concat(F.lit("added by board lookup ("), "provider", F.lit(", "), F.col("count").cast("string"), F.lit(" live jobs"), fit, F.lit(")")))
        .when(board == "unresolved", "added from feeds (unresolved, no careers page)")
        .otherwise(F.concat(F.lit("added from feeds (unsupported: "), board, F.lit(", careers page saved)")))
    )
    return rows.select("name", "careers_url", F.col("resolved").alias("enabled"), note.alias("notes"), "provider")


def uncovered_hits(hits: DataFrame, parsed: DataFrame, company: str = "company") -> DataFrame:
    """Search hits of companies no parser has already covered."""
    done = parsed.select(lower_strip(F.col("name")).alias("known")).distinct()
    return exclude(hits.withColumn("__n", lower_strip(F.col(company))), done, {"__n": "known"}).drop("__n")


# ── batches of work ──────────────────────────────────────────────────


def pending_work(
    todo: DataFrame, state: DataFrame, max_retries: int, retry_failed: bool = False, start_from: int = 0
) -> DataFrame:
    """Input rows still to be done: numeric ids with a URL, not completed, retries left."""
    number = F.col("id").try_cast("long")
    rows = todo.where(F.col("id").rlike(r"^[0-9]+$") & (F.coalesce("url", F.lit("")) != "") & (number >= start_from))
    known = state.select("id", F.col("status").alias("__s"), F.coalesce("retries", F.lit(0)).alias("__r"))
    joined = rows.join(known, "id", "left")
    failed = F.coalesce(F.col("__s") == "failed", F.lit(False))
    used_up = failed & (F.col("__r") >= max_retries)
    done = F.coalesce(F.col("__s") == "completed", F.lit(False))
    keep = (failed & ~used_up) if retry_failed else (~done & ~used_up)
    return joined.where(keep).select(*todo.columns)


def gate_score(score: Column, minimum: float) -> Column:
    """Status of a finished item: below the minimum it is skipped, unscored items pass."""
    if minimum <= 0:
        return F.lit("completed")
    return F.when(score < minimum, "skipped").otherwise("completed")


def batch_summary(state: DataFrame) -> DataFrame:
    """One row: total, completed, failed, pending and the mean score of completed scored items."""
    completed = F.col("status") == "completed"
    return state.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(completed).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~F.col("status").isin("completed", "failed")).alias("pending"),
        F.count(F.when(completed, F.col("score"))).alias("scored"),
        F.avg(F.when(completed, F.col("score"))).alias("mean_score"),
    )


def next_number(*columns: tuple[DataFrame, str]) -> DataFrame:
    """One row: the highest number in any of the given columns, plus one."""
    parts = [df.select(F.col(c).try_cast("long").alias("n")) for df, c in columns]
    return reduce(DataFrame.unionByName, parts).agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("next_number"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# ── forms ────────────────────────────────────────────────────────────


_UNMAPPED = "\u0001"


def with_field_kind(fields: DataFrame, label: str, kind_of_input: Column, maxlength: str, mapped_key: str | None = None, out: str = "field") -> DataFrame:
    """``fields`` with a struct(kind, profile_key), as :func:`field_kind` gives it.

    Forms ask the same things again and again: the rules are applied once to each distinct question, and rows look theirs
    up (a question that a third of all rows ask is split).
    """
    mapped = F.lit(None).cast("string") if mapped_key is None else F.col(mapped_key)
    parts = {
        "label": F.coalesce(label, F.lit("")), "control": F.lower(F.coalesce(kind_of_input, F.lit(""))),
        "long": F.coalesce(F.col(maxlength) > LONG_TEXT, F.lit(False)), "mapped": F.coalesce(mapped, F.lit(_UNMAPPED)),
    }
    names = {k: f"__asked_{k}" for k in parts}
    asked = fields.withColumns({names[k]: v for k, v in parts.items()})
    key = F.nullif(F.col(names["mapped"]), F.lit(_UNMAPPED))
    kind = field_kind(F.col(names["label"]), F.col(names["control"]), F.when(F.col(names["long"]), LONG_TEXT + 1), key)
    answers = asked.select(*names.values()).distinct().withColumn(out, kind)
    return lookup(asked, answers, list(names.values())).select(*[F.col(f"`{c}`") for c in fields.columns], out)


def form_verdicts(fields: DataFrame, form: str) -> DataFrame:
    """Per form: fields per kind, and can the profile fill all of it?  ``fields`` has kind, required."""
    kinds = ("standard", "file", "free_text", "salary", "demographic", "unmapped")
    return fields.groupBy(form).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
        F.bool_and(F.col("kind") == "standard").alias("all_standard"),
        F.count_if(F.col("required") & (F.col("kind") != "standard")).alias("required_unresolved"),
    )


def unresolved_required(fields: DataFrame) -> DataFrame:
    """The required fields that the profile can't fill, as rows."""
    return fields.where(F.coalesce("required", F.lit(False)) & (F.coalesce("kind", F.lit("unmapped")) != "standard"))


def answer_plan(fields: DataFrame, profile: DataFrame, memory: DataFrame) -> DataFrame:
    """What to fill in: the profile's value, else a remembered answer, else nothing.

    ``fields``: norm_label, kind, profile_key …; ``profile``: profile_key, value; ``memory``:
    norm_label, value.
    """
    # One person's profile has at most one row per profile key, a fixed list: safe to broadcast.
    values = profile.where(F.col("profile_key").isin(*PROFILE_KEYS)).groupBy("profile_key").agg(F.max("value").alias("__own"))
    own = fields.join(F.broadcast(values), "profile_key", "left")
    both = lookup(own, memory.select("norm_label", F.col("value").alias("__mem")), "norm_label")
    standard = (F.col("kind") == "standard") & F.col("profile_key").isNotNull()
    remembered = ~standard & F.col("__mem").isNotNull() & (F.col("kind") != "file")
    return both.withColumns({
        "plan_kind": F.when(remembered, "remembered").otherwise(F.col("kind")),
        "plan_value": F.when(standard, F.coalesce("__own", F.lit(""))).when(remembered, F.col("__mem")).otherwise(""),
        "profile_key": F.when(~remembered, F.col("profile_key")),
    }).drop("__own", "__mem")
