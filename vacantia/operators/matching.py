"""Matching rows by one of several keys, in priority order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else, report_file, strip
from ..functions.urls import board_and_slug, canonical_url, https_on_host, slug_candidates, with_url_keys, workday_parts
from .containment import contained
from .skew import lookup


def lifecycle_tables(
    applications: DataFrame, reports: DataFrame, tracker: DataFrame, order: str
) -> tuple[DataFrame, DataFrame]:
    """Two lookup tables, by canonical URL and by listing id, each with one (status, report) per key.

    ``applications``: key, status, report and the order column; ``reports``: file, num, url and the
    order column; ``tracker``: num, status. An application (the last one of a URL) decides its URL; a
    report (the first one of a URL) counts only where there is none, with the status the tracker has
    for its number. Among the URLs of one id, reports come after applications and the last one wins.
    """
    apps = with_url_keys(applications.where("coalesce(key, '') <> ''"), {"__url": F.col("key")}).select(
        F.col("__url").alias("url"),
        F.struct(F.nullif("status", F.lit("")).alias("status"), report_file(F.col("report")).alias("report")).alias("value"),
        F.lit(1).alias("is_app"), F.col(order).alias("ord"), F.col(order).alias("rank"),
    )
    by_number = tracker.where("coalesce(num, '') <> ''").groupBy("num").agg(F.max("status").alias("tracker_status"))
    noted = with_url_keys(reports.where("coalesce(url, '') <> ''"), {"__url": F.col("url")}).join(by_number, "num", "left").select(
        F.col("__url").alias("url"),
        F.struct(or_else(F.col("tracker_status"), F.lit("Evaluated")).alias("status"), F.col("file").alias("report")).alias("value"),
        F.lit(0).alias("is_app"), F.col(order).alias("ord"), (-F.col(order)).alias("rank"),
    )
    best = F.max_by(F.struct("value", "is_app", "ord"), F.struct("is_app", "rank"))
    # Both tables start from the same aggregation, so its shuffle is done once.
    per_url = apps.unionByName(noted).groupBy("url").agg(best.alias("best"))
    by_url = per_url.select("url", F.col("best.value").alias("by_url"))
    last = F.max_by("best.value", F.struct(-F.col("best.is_app"), F.col("best.ord")))
    by_id = with_url_keys(per_url, ids={"id": F.col("url")}).where("id <> ''").groupBy("id").agg(last.alias("by_id"))
    return by_url, by_id


def with_lifecycle(listings: DataFrame, by_url: DataFrame, by_id: DataFrame, key: str = "key") -> DataFrame:
    """Add status, report and ``tracked`` of the application behind each listing: by URL, else by id.

    ``tracked`` tells an application without a status from no application at all.
    """
    tagged = with_url_keys(listings, ids={"__id": F.col(key)}).withColumns({"__url": F.col(key), "__id": F.nullif("__id", F.lit(""))})
    found = lookup(tagged, by_url.withColumnRenamed("url", "__url"), "__url")
    found = lookup(found, by_id.withColumnRenamed("id", "__id"), "__id")
    value = F.coalesce(F.col("by_url"), F.col("by_id"))
    return found.select(*listings.columns, value["status"].alias("status"), value["report"].alias("report"), value.isNotNull().alias("tracked"))


def match_submissions(submissions: DataFrame, listings: DataFrame, order: str, submission_id: str) -> DataFrame:
    """The first listing (in ``order``) a submission belongs to, by any of four keys.

    Keys: the canonical URL is the listing key; the raw URL is its url; the canonical URL is that of
    its apply_url; the listing id occurs in one of its three URLs. An OR over join conditions would
    compare all pairs; instead every listing is indexed once per key value (earliest listing only)
    and every submission looks up its few values.
    """
    def pairs(kinds: dict[str, Column]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(k.rstrip("0123456789")).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("__k")

    named = with_url_keys(listings, {"__apply": F.col("apply_url")}, {f"__id{i}": F.col(c) for i, c in enumerate(("key", "url", "apply_url"))})
    entries = named.select(
        "key", F.col(order).alias("__ord"),
        pairs({"key": F.col("key"), "url": F.col("url"), "apply": F.col("__apply"), **{f"id{i}": F.col(f"__id{i}") for i in range(3)}}),
    ).select("key", "__ord", "__k.kind", "__k.value").where("value <> ''")
    table = entries.groupBy("kind", "value").agg(F.min_by(F.struct("__ord", "key"), "__ord").alias("found"))
    raw = F.col("apply_url")
    asked = with_url_keys(submissions, {"__url": raw}, {"__id": raw})
    wanted = asked.select(
        F.col(submission_id), pairs({"key": F.col("__url"), "url": raw, "apply": F.col("__url"), "id": F.col("__id")})
    ).select(submission_id, "__k.kind", "__k.value").where("value <> ''")
    hits = lookup(wanted, table, ["kind", "value"]).where("found IS NOT NULL")
    best = hits.groupBy(submission_id).agg(F.min("found").alias("__best"))
    return submissions.join(best, submission_id, "left").withColumn("matched_key", F.col("__best.key")).drop("__best")


# Boards in the order in which a company is looked for.
PROVIDER_ORDER = ("greenhouse", "ashby", "lever", "smartrecruiters", "recruitee", "gem", "workable", "bamboohr", "breezy", "rippling")


def resolve_by_name(companies: DataFrame, catalogue: DataFrame, name: str, providers: Sequence[str] = PROVIDER_ORDER) -> DataFrame:
    """Board of each company: the first provider, then slug guess, with open listings.

    ``catalogue``: provider, slug, careers_url, count. Unresolved companies keep nulls.
    """
    guesses = companies.select(F.col(name), F.posexplode(slug_candidates(F.col(name))).alias("__pos", "slug"))
    rank = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    boards = catalogue.where(F.col("provider").isin(*providers) & (F.col("count") > 0))
    hits = guesses.join(boards, "slug").withColumn("__rank", rank)
    board = F.struct("provider", "slug", "careers_url", "count")
    best = hits.groupBy(name).agg(F.min_by(board, F.struct("__rank", "__pos")).alias("__b"))
    return companies.join(best, name, "left").select(
        *companies.columns, "__b.provider", "__b.slug", "__b.careers_url", "__b.count", F.col("__b").isNotNull().alias("resolved")
    )


def resolve_by_url(companies: DataFrame, catalogue: DataFrame, url: str) -> DataFrame:
    """Board of each company from its careers URL: Workday first, then the first slug pattern."""
    workday = workday_parts(F.col(url))
    parts = F.coalesce(
        F.when(workday.isNotNull(), F.struct(F.lit("workday").alias("provider"), workday["tenant"].alias("slug"))),
        board_and_slug(F.col(url)),
    )
    tagged = companies.withColumn("__b", parts)
    tagged = tagged.withColumns({"provider": F.col("__b.provider"), "slug": F.col("__b.slug")}).drop("__b")
    boards = catalogue.where("count > 0").select("provider", "slug", "count")
    return tagged.join(boards, ["provider", "slug"], "left").select(
        *companies.columns, "provider", "slug", "count", F.col("count").isNotNull().alias("resolved")
    )


def detect_provider(careers_url: Column, api: Column) -> Column:
    """First board whose detector accepts a company entry, in name order; null when none does."""
    url = F.coalesce(careers_url, F.lit(""))
    api_text = F.coalesce(api, F.lit(""))
    workday = F.when(url != "", url).otherwise(api_text)
    trusted_api = https_on_host(
        api_text, r"boards-api\.greenhouse\.io|boards\.greenhouse\.io|job-boards\.greenhouse\.io|job-boards\.eu\.greenhouse\.io"
    )
    has_segment = lambda u: F.regexp_extract(u, "(?i)^https://[^/?#]+/+([^/?#]+)", 1) != ""
    return (
        F.when(url.rlike(r"jobs\.ashbyhq\.com/[^/?#]+"), "ashby")
        .when(url.rlike(r"(?i)^https?://[a-z0-9-]+\.bamboohr\.com"), "bamboohr")
        .when(url.rlike(r"(?i)^https?://[a-z0-9-]+\.breezy\.hr"), "breezy")
        .when(url.rlike(r"jobs\.gem\.com/[^/?#]+"), "gem")
        .when(F.when(api_text != "", trusted_api).otherwise(url.rlike(r"job-boards(?:\.eu)?\.greenhouse\.io/[^/?#]+")), "greenhouse")
        .when(url.rlike(r"jobs\.lever\.co/[^/?#]+"), "lever")
        .when(https_on_host(url, r"[a-z0-9][a-z0-9-]*\.recruitee\.com"), "recruitee")
        .when(url.rlike(r"(?i)ats\.rippling\.com/[^/?#]+"), "rippling")
        .when(https_on_host(url, r"(?:careers|jobs)\.smartrecruiters\.com") & has_segment(url), "smartrecruiters")
        .when(https_on_host(url, r"apply\.workable\.com") & has_segment(url), "workable")
        .when(workday_parts(workday).isNotNull(), "workday")
    )


def route_companies(companies: DataFrame, known: Sequence[str]) -> DataFrame:
    """Provider per company entry: the one it names, else its own parser, else the first detector.

    Adds ``provider_id`` and ``route`` (explicit, parser, detected, unknown_provider, unmatched).
    """
    given = F.coalesce(F.col("provider"), F.lit(""))
    parser = F.coalesce(F.col("parser_command"), F.lit("")) != ""
    found = detect_provider(F.col("careers_url"), F.col("api"))
    route = (
        F.when((given != "") & given.isin(*known), "explicit")
        .when(given != "", "unknown_provider")
        .when(parser, "parser")
        .when(found.isNotNull(), "detected")
        .otherwise("unmatched")
    )
    provider = F.when(route == "explicit", given).when(route == "parser", "local-parser").when(route == "detected", found)
    return companies.withColumns({"provider_id": provider, "route": route})


def enabled_companies(companies: DataFrame, name_part: str | None = None) -> DataFrame:
    """Entries that are not disabled, have a name, and (optionally) whose name holds a text."""
    rows = companies.where(F.coalesce(F.col("enabled"), F.lit(True)) & (strip(F.coalesce(F.col("name"), F.lit(""))) != ""))
    return rows.where(F.lower("name").contains(name_part.lower())) if name_part else rows


def resolve_keys(texts: Sequence[str] | DataFrame, listings: DataFrame, applications: DataFrame, order: str) -> DataFrame:
    """Listing key for each free text a person typed: URL, exact key, then a substring match.

    ``texts`` is a list or a table with the one column ``text``; repeated and blank texts count once and never. A text is
    looked for in company, title and both with a blank between; of several listings the first in ``order`` counts, and a
    listing comes before an application. Names are indexed by stretches of characters (:func:`contained`), so the
    work grows with the texts and the tables and not with their product.
    """
    spark = listings.sparkSession
    asked = texts if isinstance(texts, DataFrame) else spark.createDataFrame([(t,) for t in texts], "text string")
    asked = asked.select(strip("text").alias("text")).where("text <> ''").distinct().withColumn("needle", F.lower("text"))
    needles = asked.select("needle").distinct()
    company, title = (strip(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("company", "title"))

    def firsts(named: DataFrame, out: str) -> DataFrame:
        """Per needle the key first in order among the names that hold it; a name stands for all its rows."""
        row = F.min_by(F.struct(F.col(order).alias("o"), F.col("key").alias("k")), F.struct(order, "key"))
        # A row per name, as many as the table has: sorted and not broadcast, however small its files are.
        own = named.groupBy("name").agg(row.alias("first")).hint("merge")
        hits = contained(named.select("name"), needles)
        found = hits.join(own, F.col("text") == F.col("name")).groupBy("needle").agg(F.min("first").alias("first"))
        return found.select("needle", F.col("first.k").alias(out))

    both = listings.select(F.concat_ws(" ", company, title).alias("name"), "key", order)
    apart = applications.select(F.explode(F.array(company, title)).alias("name"), "key", order)
    exact = applications.select(F.col("key").alias("text")).distinct().withColumn("exact", F.col("text")).hint("merge")
    joined = lookup(lookup(lookup(asked, exact, "text"), firsts(both, "listing"), "needle"), firsts(apart, "application"), "needle")
    key = F.when(F.col("text").rlike("(?i)^https?://"), canonical_url(F.col("text"))).otherwise(
        or_else(F.col("exact"), F.col("listing"), F.col("application"))
    )
    return joined.select("text", key.alias("key"))


def search_grid(terms: Sequence[str], locations: Sequence[str], sites: DataFrame) -> DataFrame:
    """One row per search: every term and location for each site of a (small) site table."""
    return (
        sites.withColumn("term", F.explode(F.array(*[F.lit(t) for t in terms])))
        .withColumn("location", F.explode(F.array(*[F.lit(x) for x in locations])))
    )
