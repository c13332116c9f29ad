"""Registries: merging full or partial snapshots while keeping what people decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import company_type, excluded_type
from ..functions.facets import company_relevance, listing_relevance
from ..functions.text import html_to_text, or_else
from ..functions.urls import company_key
from .dedup import last_wins
from .skew import in_group, lookup

# How a column of a rescanned row is filled.
NEW, PRIOR, NEW_OR_PRIOR, NEW_TEXT_OR_PRIOR, PRIOR_TEXT_OR_NEW = range(5)


def _merged(rule, new: Column, old: Column) -> Column:
    if rule == NEW:
        return new
    if rule == PRIOR:
        return old
    if rule == NEW_OR_PRIOR:
        return F.coalesce(new, old)
    if rule == NEW_TEXT_OR_PRIOR:
        return F.coalesce(F.nullif(new, F.lit("")), old)
    return F.coalesce(F.nullif(old, F.lit("")), new)


def merge_snapshot(
    prior: DataFrame, scan: DataFrame, key: str, group: str, policy: dict[str, int],
    scanned_groups: DataFrame | None = None, scan_date: Column | None = None, few_groups: int = 0,
) -> DataFrame:
    """Merge one scan into a registry.

    Rows of the scan take each column by ``policy`` and become live. Prior rows missing from the
    scan keep all their columns; they go dead only if their group was scanned. ``scanned_groups``
    (one column named ``group``) states what was scanned, so a board that came back empty expires its
    rows too; without it, the groups of the scan's rows count. Both inputs have one row per key. If there are no more
    than ``few_groups`` of them (which is counted first), they are broadcast and the merged rows stay where they are.
    """
    if scanned_groups is None:
        scanned_groups = scan.select(group).where(F.col(group).isNotNull()).distinct()
    columns = [c for c in prior.columns if c not in (key, "live", "first_seen", "last_seen")]
    old = prior.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__p_{c}") for c in prior.columns if c != key])
    new = scan.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__s_{c}") for c in scan.columns if c != key])
    both = old.join(new, key, "full_outer")
    # Only rows absent from the scan need to know whether their group was scanned.
    both = both.withColumn(group, F.when(F.col("__new").isNull(), F.col(f"__p_{group}")))
    if few_groups and scanned_groups.distinct().limit(few_groups + 1).count() <= few_groups:
        listed = scanned_groups.distinct().withColumn("__group_scanned", F.lit(True))
        both = both.join(F.broadcast(listed), group, "left").withColumn("__group_scanned", F.coalesce("__group_scanned", F.lit(False)))
    else:
        both = in_group(both, scanned_groups, group, "__group_scanned")

    present = F.col("__new").isNotNull()
    out = {}
    for c in columns:
        new_value = F.col(f"__s_{c}") if c in scan.columns else F.lit(None)
        out[c] = F.when(present, _merged(policy.get(c, PRIOR), new_value, F.col(f"__p_{c}"))).otherwise(F.col(f"__p_{c}"))
    out["live"] = F.when(present, True).when(F.col("__group_scanned"), False).otherwise(F.col("__p_live"))
    if scan_date is not None:
        out["first_seen"] = F.when(present, F.coalesce(F.col("__p_first_seen"), scan_date)).otherwise(F.col("__p_first_seen"))
        out["last_seen"] = F.when(present, scan_date).otherwise(F.col("__p_last_seen"))
    return both.select(key, *[v.alias(c) for c, v in out.items()])


LISTING_POLICY = {
    "company_key": NEW, "company": NEW, "title": NEW, "url": NEW, "provider": NEW, "location": NEW, "department": NEW,
    "apply_url": NEW_TEXT_OR_PRIOR, "date_posted": NEW_TEXT_OR_PRIOR, "employment_type_raw": NEW_TEXT_OR_PRIOR,
    "comp": NEW_OR_PRIOR, "has_body": NEW, "extracted": PRIOR,
}


def scan_to_listings(scan: DataFrame, companies: DataFrame, order: str) -> DataFrame:
    """Rows of a raw scan in registry shape, the last row per URL, with their company key.

    ``companies`` has (key, careers_url); a listing whose careers_url is not in it gets a key
    derived from the URL.
    """
    rows = last_wins(scan.where(F.coalesce(F.col("url"), F.lit("")) != ""), ["url"], [order])
    known = (
        companies.where(F.coalesce(F.col("careers_url"), F.lit("")) != "")
        .groupBy("careers_url").agg(F.max("key").alias("__registered"))
    )
    found = lookup(rows, known, "careers_url")
    text = F.coalesce
    return found.select(
        F.col("url").alias("key"),
        F.coalesce(F.col("__registered"), company_key(F.col("provider"), F.col("careers_url"))).alias("company_key"),
        "company", "title", "url",
        or_else(F.col("apply_url")).alias("apply_url"),
        text(F.col("location"), F.lit("")).alias("location"),
        text(F.col("department"), F.lit("")).alias("department"),
        "provider",
        text(F.col("date_posted"), F.lit("")).alias("date_posted"),
        "comp",
        text(F.col("employment_type"), F.lit("")).alias("employment_type_raw"),
        html_to_text(F.col("description")).alias("body"),
    )


def refresh_listings(
    listings: DataFrame, prior: DataFrame, scan_date: Column, scanned_groups: DataFrame | None = None,
) -> DataFrame:
    """The listing registry after a scan (``listings`` from :func:`scan_to_listings`)."""
    scan = listings.withColumn("has_body", F.col("body") != "").drop("body")
    marked = prior.withColumn("__had_body", F.coalesce(F.col("has_body"), F.lit(False)))
    merged = merge_snapshot(
        marked, scan, "key", "company_key", LISTING_POLICY, scanned_groups, scan_date,
    )
    return merged.withColumns({
        "has_body": F.coalesce(F.col("has_body"), F.lit(False)) | F.coalesce(F.col("__had_body"), F.lit(False)),
        "apply_url": or_else(F.col("apply_url"), F.col("url")),
        "date_posted": F.coalesce(F.col("date_posted"), F.lit("")),
        "employment_type_raw": F.coalesce(F.col("employment_type_raw"), F.lit("")),
    }).drop("__had_body")


def listing_bodies(listings: DataFrame) -> DataFrame:
    """One text body per key, as rows of a table."""
    return listings.where("body <> ''").select("key", "company", "title", "url", "body")


def applied_keys(applications: DataFrame) -> DataFrame:
    return (
        applications.where("coalesce(status, '') <> '' AND status <> 'Evaluated'").select("key").distinct()
    )


def refresh_personal(
    registry: DataFrame, listings: DataFrame, prior: DataFrame, applications: DataFrame, fits: DataFrame,
    scan_date: Column,
) -> DataFrame:
    """The personal layer after a scan: relevance anew for scanned rows, everything else kept.

    ``fits`` has (company_key, company_fit) of the kept companies. Keys with a real application
    are decided as applied.
    """
    scored = lookup(listings.select("key", "company_key", "title", "date_posted"), fits, "company_key")
    relevance = listing_relevance(
        F.col("title"), F.try_to_date(F.substring("date_posted", 1, 10)), scan_date, F.col("company_fit")
    )
    scored = scored.select("key", relevance.alias("__relevance"))
    applied = applied_keys(applications).withColumn("__applied", F.lit(True))
    base = registry.select("key").join(prior, "key", "left").join(scored, "key", "left").join(applied, "key", "left")
    return base.withColumns({
        "relevance_score": F.coalesce(F.col("__relevance"), F.col("relevance_score")),
        "hard_excluded": F.coalesce(F.col("hard_excluded"), F.lit(False)),
        "decision": F.when(F.col("__applied"), "applied").otherwise(or_else(F.col("decision"), F.lit("undecided"))),
    }).drop("__relevance", "__applied")


def registry_counts(registry: DataFrame, personal: DataFrame) -> DataFrame:
    """One row: total, live, expired, with body, undecided."""
    both = registry.select("key", "live", "has_body").join(personal.select("key", "decision"), "key", "left")
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("live")).alias("live"),
        F.count_if(~F.col("live")).alias("expired"),
        F.count_if(F.col("has_body")).alias("with_body"),
        F.count_if(F.col("decision") == "undecided").alias("undecided"),
    )


def merge_companies(survey: DataFrame, urls: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company registry and personal layer from a survey.

    ``survey``: provider, slug, name, total, relevant, remote_relevant, samples (array), error.
    ``urls``: provider, slug, careers_url. ``prior``: the personal layer before. Companies with no
    relevant opening leave the registry; those already decided stay on the personal layer, stale.
    """
    found = (
        survey.where("coalesce(error, '') = '' AND relevant > 0")
        .join(urls, ["provider", "slug"], "left")
        .withColumn("key", F.concat_ws(":", "provider", "slug"))
        .withColumn("company_type", company_type(F.col("name"), F.concat_ws(" ", F.lower(F.concat_ws(" ", "samples")))))
    )
    research = found.select(
        "key", "provider", "slug", "name", F.coalesce("careers_url", F.lit("")).alias("careers_url"), "total", "relevant",
        "remote_relevant", F.coalesce("samples", F.array().cast("array<string>")).alias("sample_titles"), "company_type",
    )
    current = research.select(
        "key", *[F.col(c).alias(f"__n_{c}") for c in ("name", "provider", "careers_url", "company_type")],
        company_relevance(F.col("remote_relevant"), F.col("relevant"), F.col("sample_titles")).alias("__relevance"),
    )
    both = prior.join(current, "key", "full_outer")
    present = F.col("__relevance").isNotNull()
    keep = present | (or_else(F.col("decision")).isin("", "undecided") == F.lit(False))
    personal = both.where(keep).select(
        "key",
        F.coalesce("__n_name", "name").alias("name"),
        F.coalesce("__n_provider", "provider").alias("provider"),
        or_else(F.col("__n_careers_url"), F.col("careers_url")).alias("careers_url"),
        F.coalesce("__relevance", F.lit(0.0)).alias("relevance_score"),
        F.when(present, excluded_type(F.col("__n_company_type")))
        .otherwise(F.coalesce("excluded_by_type", F.lit(False))).alias("excluded_by_type"),
        or_else(F.col("decision"), F.lit("undecided")).alias("decision"),
        "fit",
        (~present).alias("stale"),
    )
    return research, personal


# Default values for companies registered in bulk.
NEW_COMPANY_RELEVANCE = 50.0


def register_companies(found: DataFrame, known_keys: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """New companies (provider, slug, name, careers_url) for both layers, first row per key wins."""
    from .dedup import first_wins

    keyed = found.where("coalesce(name, '') <> '' AND coalesce(slug, '') <> ''").withColumn("key", F.concat_ws(":", "provider", "slug"))
    new = first_wins(keyed.join(known_keys.select("key"), "key", "left_anti"), ["key"], [order])
    base = new.select("key", "name", "provider", "careers_url")
    personal = base.withColumns({
        "relevance_score": F.lit(NEW_COMPANY_RELEVANCE), "excluded_by_type": F.lit(False), "decision": F.lit("undecided"),
        "fit": F.lit(None).cast("double"),
    })
    research = base.withColumns({
        "company_type": F.lit("unknown"), "relevant": F.lit(0), "remote_relevant": F.lit(0),
        "sample_titles": F.array().cast("array<string>"),
    })
    return personal, research
