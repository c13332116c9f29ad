"""Work queues, orders, searches and counts over the registry and its personal layer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, or_else
from .skew import in_group, lookup, top_per_key


def is_live(c: str = "live") -> Column:
    """A missing flag means live."""
    return F.coalesce(F.col(c), F.lit(True))


def _open_work(rows: DataFrame) -> DataFrame:
    return rows.where(is_live() & (F.coalesce("decision", F.lit("undecided")) == "undecided"))


def triage_queue(rows: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Live undecided listings without a rank, by relevance; ``rows`` = personal ⟕ registry."""
    todo = _open_work(rows).where("rank IS NULL")
    ordered = todo.orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "key")
    return ordered.offset(offset).limit(n)


def with_excerpt(queue: DataFrame, bodies: DataFrame, max_chars: int = 600) -> DataFrame:
    """Queue rows with the start of the listing text.

    A queue has at most its ``n`` rows, so its keys are broadcast to the bodies, and only the bodies of
    queued listings are cut.
    """
    wanted = bodies.select("key", "body").join(F.broadcast(queue.select("key")), "key", "left_semi")
    # A column used twice stays below as it is; the text is cut above the join.
    both = queue.join(wanted.withColumn("__found", F.lit(True)), "key", "left")
    return both.withColumn("excerpt", F.when(F.col("__found"), excerpt(F.col("body"), max_chars, 2))).drop("body", "__found")


def research_queue(rows: DataFrame, n: int, include_extracted: bool = False) -> DataFrame:
    """Ranked live undecided listings without facets, best rank first."""
    todo = _open_work(rows).where("rank IS NOT NULL")
    if not include_extracted:
        todo = todo.where("NOT researched")
    return todo.orderBy(F.desc("rank"), F.desc(F.coalesce("relevance_score", F.lit(0.0))), "key").limit(n)


def review_queue(rows: DataFrame, score: Column, n: int) -> DataFrame:
    return _open_work(rows).withColumn("display_score", score).orderBy(F.desc_nulls_last("display_score"), "key").limit(n)


def _eligible_companies(companies: DataFrame) -> DataFrame:
    return companies.where(~F.coalesce("excluded_by_type", F.lit(False)) & (F.col("decision") == "undecided"))


def company_triage_queue(companies: DataFrame, n: int, offset: int = 0) -> DataFrame:
    todo = _eligible_companies(companies).where("rank IS NULL")
    return todo.orderBy(F.desc("relevance_score"), "key").offset(offset).limit(n)


def company_research_queue(companies: DataFrame, n: int) -> DataFrame:
    """Ranked companies without a fit: rank first, then number of remote openings."""
    todo = _eligible_companies(companies).where("rank IS NOT NULL AND fit IS NULL")
    return todo.orderBy(F.desc("rank"), F.desc(F.coalesce("remote_relevant", F.lit(0))), "key").limit(n)


def company_vetting_queue(companies: DataFrame, n: int) -> DataFrame:
    return _eligible_companies(companies).where("rank IS NOT NULL").orderBy(F.desc("rank"), "key").limit(n)


def registry_order(rows: DataFrame) -> DataFrame:
    """Live first, then relevance."""
    return rows.orderBy(F.desc(F.coalesce("live", F.lit(False))), F.desc(F.coalesce("relevance_score", F.lit(0.0))), "key")


def company_order(companies: DataFrame) -> DataFrame:
    """Researched companies before ranked ones before the rest, then score, then relevance."""
    tier = F.when(F.col("fit").isNotNull(), 2).when(F.col("rank").isNotNull(), 1).otherwise(0)
    scored = companies.withColumns({"tier": tier, "score": F.coalesce("fit", "rank")})
    return scored.orderBy(
        F.desc("tier"), F.desc(F.coalesce("score", F.lit(-1))), F.desc(F.coalesce("relevance_score", F.lit(0.0))), "key"
    )


def company_registry_order(companies: DataFrame) -> DataFrame:
    return companies.orderBy(F.asc(F.coalesce("excluded_by_type", F.lit(False))), F.desc("relevance_score"), "key")


def company_openings_order(companies: DataFrame) -> DataFrame:
    """The research registry's order: most remote openings first."""
    return companies.orderBy(F.desc(F.coalesce("remote_relevant", F.lit(0))), "key")


def sort_by(rows: DataFrame, column: str, descending: bool = False, numeric: bool = False) -> DataFrame:
    """Order a person chose: missing numbers count as -1, missing texts as ''."""
    if numeric:
        sort_key: Sequence[Column] = [F.coalesce(F.col(column).cast("double"), F.lit(-1.0))]
    else:
        text = F.coalesce(F.col(column).cast("string"), F.lit(""))
        sort_key = [F.lower(text), text]
    return rows.orderBy(*[c.desc() if descending else c.asc() for c in sort_key], "key")


def search_listings(
    rows: DataFrame, score: str = "display_score", live_only: bool = True, show_excluded: bool = False,
    researched_only: bool = False, hide_capped: bool = True, hide_applied: bool = True, language: str | None = None,
    equal: dict[str, str] | None = None, min_score: float = 0.0, text: str | None = None,
) -> DataFrame:
    """Facet search over the ranked view; listings of skipped companies never show."""
    tests = [F.coalesce("company_decision", F.lit("undecided")) != "skip"]
    if live_only:
        tests.append(F.col("live"))
    if not show_excluded:
        tests.append(~F.col("hard_excluded"))
    if researched_only:
        tests.append(F.col("researched"))
    if hide_capped:
        tests.append(~F.col("capped"))
    if hide_applied:
        tests.append(~F.col("applied"))
    if language:
        tests.append(F.coalesce(F.array_contains("languages", language), F.lit(False)))
    tests += [F.col(c) == v for c, v in (equal or {}).items() if v]
    if min_score > 0:
        tests.append(F.coalesce(F.col(score), F.lit(-1.0)) >= min_score)
    if text and text.strip():
        lists = [F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("languages", "technologies")]
        everything = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in ("company", "title", "reason")], *lists)
        tests.append(F.lower(everything).contains(text.strip().lower()))
    return rows.where(reduce(lambda a, b: a & b, tests))


def search_companies(companies: DataFrame, decision: str = "all", text: str | None = None) -> DataFrame:
    rows = companies if decision == "all" else companies.where(F.col("decision") == decision)
    if text and text.strip():
        joined = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in ("name", "company_type", "reason")])
        rows = rows.where(F.lower(joined).contains(text.strip().lower()))
    return rows


def decision_counts(rows: DataFrame) -> DataFrame:
    """Triage progress in one row; the ratio is null while nothing is decided."""
    todo = is_live() & (F.col("decision") == "undecided")
    counts = rows.agg(
        F.count_if(todo).alias("open"),
        F.count_if(todo & F.col("rank").isNotNull()).alias("ranked"),
        F.count_if(todo & F.col("researched")).alias("researched"),
        F.count_if(F.col("decision") != "undecided").alias("decided"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("shortlist", "applied", "skip")],
    )
    return counts.withColumns({
        "remaining": F.col("open") - F.col("ranked"),
        "ratio": F.when(F.col("decided") > 0, F.round(F.col("ranked") / F.col("decided")).cast("long")),
    })


# Boards that can be scanned again.
SCANNABLE = ("greenhouse", "ashby", "lever", "smartrecruiters", "recruitee", "workday", "workable", "bamboohr", "breezy", "rippling", "gem")


def watchlist(
    companies: DataFrame, include_undecided: bool, min_openings: int, max_undecided: int, scannable: Sequence[str] = SCANNABLE
) -> DataFrame:
    """Kept companies plus the best undecided ones with enough openings.

    ``companies``: key, name, provider, careers_url, decision, excluded_by_type, openings,
    relevance_score. The cap on undecided companies is applied before unusable entries (no name or
    URL) are dropped; a negative cap means no cap.
    """
    known = companies.where(F.col("provider").isin(*scannable))
    usable = "coalesce(name, '') <> '' AND coalesce(careers_url, '') <> ''"
    kept = known.where("decision = 'keep'").where(usable).withColumn("entry", F.lit("keep"))
    if not include_undecided:
        return kept
    candidates = known.where("decision = 'undecided' AND NOT coalesce(excluded_by_type, false)").where(
        F.coalesce("openings", F.lit(0)) >= min_openings
    )
    ordered = candidates.orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "key")
    chosen = ordered if max_undecided < 0 else ordered.limit(max_undecided)
    return kept.unionByName(chosen.where(usable).withColumn("entry", F.lit("candidate")))


def pending_vetting(shortlisted: DataFrame, companies: DataFrame) -> DataFrame:
    """Shortlisted live listings of undecided companies, one row per listing with the company's count.

    The count comes from an aggregate joined back, so no company's titles are gathered in one task.
    """
    undecided = companies.where("decision = 'undecided'").select(F.col("key").alias("company_key"))
    rows = in_group(
        shortlisted.where(is_live() & (F.col("decision") == "shortlist")), undecided, "company_key", "__undecided",
    ).where("__undecided").drop("__undecided")
    counts = rows.groupBy("company_key").agg(F.count(F.lit(1)).alias("shortlisted"))
    return lookup(rows, counts, "company_key").orderBy(F.desc("shortlisted"), "company_key", "key")


def top_titles(titles: DataFrame, group: str, title: str, order: str, n: int = 12) -> DataFrame:
    """The first ``n`` distinct titles per company in order of appearance, as rows with a rank."""
    distinct = titles.groupBy(group, title).agg(F.min(order).alias("__first"))
    return top_per_key(distinct, [group], ["__first", title], n).select(group, title, "rank")


def titles_or_samples(companies: DataFrame, titles: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` titles per company by their rank, so a list is safe, else the survey's own samples."""
    lists = titles.where(F.col("rank") <= n).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("__t"))
    names = F.transform(F.col("__t"), lambda x: x["title"])
    return companies.join(lists, "key", "left").withColumn(
        "titles", F.coalesce(names, F.col("sample_titles"), F.array().cast("array<string>"))
    ).drop("__t")


def facet_values(rows: DataFrame, arrays: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """Distinct values per facet as rows (facet, value), in order."""
    parts = [
        rows.select(F.lit(c).alias("facet"), F.explode(c).alias("value")) for c in arrays
    ] + [rows.select(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in scalars]
    union = reduce(DataFrame.unionByName, parts)
    return union.where("coalesce(value, '') <> ''").distinct().orderBy("facet", "value")


def funnel(
    view: DataFrame, applications: DataFrame, open_counts: DataFrame, registry: DataFrame, companies: DataFrame,
    floor: float, max_open: int,
) -> DataFrame:
    """What is left to do, as rows (metric, n).

    The view is reduced once, to one row per company; every metric but the number of open applications
    comes from that table beside the companies' own state.
    """
    from ..functions.status import is_open

    actionable = (
        F.col("live") & ~F.col("hard_excluded") & ~F.col("capped") & ~F.col("applied")
        & (F.coalesce(F.col("display_score"), F.lit(-1.0)) >= floor)
    )
    shortlisted = (F.col("decision") == "shortlist") & F.col("live")
    per_company = view.groupBy("company_key").agg(
        F.count_if("live").alias("n_live"), F.count_if(actionable).alias("n_actionable"), F.coalesce(F.bool_or(shortlisted), F.lit(False)).alias("wanted"),
    )
    scanned = registry.where(is_live()).select("company_key", F.lit(True).alias("scanned")).distinct()
    state = companies.select(F.col("key").alias("company_key"), F.col("decision").alias("state"), "fit", F.coalesce("excluded_by_type", F.lit(False)).alias("excluded"))
    rows = per_company.join(state, "company_key", "full").join(open_counts.select("company_key", "open_count"), "company_key", "full").join(scanned, "company_key", "left")
    undecided = F.col("state") == "undecided"
    metrics = {
        "live": F.sum("n_live"), "actionable": F.sum("n_actionable"), "capped_companies": F.count_if(F.col("open_count") >= max_open),
        "companies_kept_unscanned": F.count_if((F.col("state") == "keep") & F.col("scanned").isNull()),
        "companies_to_research": F.count_if(undecided & F.col("fit").isNotNull() & ~F.col("excluded")),
        "companies_pending_vet": F.count_if(F.col("wanted") & undecided),
    }

    def as_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        counts = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in columns.items()])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in columns])))

    return as_rows(rows, metrics).unionByName(as_rows(applications, {"open_apps": F.count_if(is_open(F.col("status")))}))


def listing_detail(
    key: str, registry: DataFrame, personal: DataFrame, bodies: DataFrame, by_url: DataFrame, by_id: DataFrame, verdicts: DataFrame | None = None
) -> DataFrame:
    """Everything about one listing, with its text and (key, fit_verdict); the key filter reaches every table's scan."""
    from .matching import with_lifecycle

    one = lambda df: df.where(F.col("key") == key)
    rows = one(registry).join(one(personal), "key", "full_outer").join(one(bodies).select("key", "body"), "key", "left")
    if verdicts is not None:
        rows = rows.join(one(verdicts).select("key", "fit_verdict"), "key", "left")
    seen = with_lifecycle(rows.withColumnRenamed("status", "__status") if "status" in rows.columns else rows, by_url, by_id)
    applied = F.col("tracked") & (F.coalesce("status", F.lit("")) != "Evaluated")
    return seen.withColumn(
        "decision", F.when(applied, "applied").otherwise(or_else(F.col("decision"), F.lit("undecided")))
    )


def comparison_table(rows: DataFrame, keys: Sequence[str], dims: str = "dim_scores") -> DataFrame:
    """Chosen listings as columns: per dimension and key a struct(score, best); null where a listing has no such score.

    The keys come from whoever compares (a handful), so they are known columns and one aggregation builds the table.
    """
    cell = F.first(F.struct("score", "best"))
    return compare_listings(rows, keys, dims).groupBy("dimension").pivot("key", list(dict.fromkeys(keys))).agg(cell)


def compare_listings(rows: DataFrame, keys: Sequence[str], dims: str = "dim_scores") -> DataFrame:
    """Chosen listings side by side: (dimension, key, score, best).

    A value is best when at least two are known and it is the highest above the lowest; ties are all
    best.
    """
    chosen = rows.where(F.col("key").isin(*keys)).select("key", F.explode(dims).alias("dimension", "score"))
    span = chosen.groupBy("dimension").agg(
        F.max("score").alias("__max"), F.min("score").alias("__min"), F.count("score").alias("__n")
    )
    best = (F.col("__n") > 1) & (F.col("__max") > F.col("__min")) & (F.col("score") == F.col("__max"))
    return chosen.join(span, "dimension").select("dimension", "key", "score", F.coalesce(best, F.lit(False)).alias("best"))
