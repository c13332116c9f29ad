"""The served views, composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facets import display_score
from ..functions.text import or_else
from ..operators.applications import open_per_company, with_cap, with_company_key
from ..operators.matching import lifecycle_tables, with_lifecycle
from ..operators.patches import merge_structs, patch_columns
from ..operators.skew import lookup
from .rubric import Rubric, score_rows

FACETS = (
    "seniority", "yoe_min", "yoe_max", "languages", "technologies", "remote_policy", "geo_eligibility",
    "employment_type", "on_call", "domain", "autonomy", "culture", "company_stage",
)


def score_registry(personal: DataFrame, registry: DataFrame, companies: DataFrame, rubric: Rubric) -> DataFrame:
    """Score every listing that has facets; the fit of kept companies is joined in only here."""
    fits = companies.where("decision = 'keep' AND fit IS NOT NULL").select(
        F.col("key").alias("company_key"), F.col("fit").alias("company_fit")
    )
    facts = registry.where("extracted IS NOT NULL").select("key", "company_key", "extracted")
    facts = lookup(facts, fits, "company_key").select("key", "extracted", "company_fit")
    kept = personal.drop("dim_scores", "computed_score", "hard_excluded", "hard_reason")
    old = {c: F.col(f"__o_{c}") for c in ("dim_scores", "computed_score", "hard_excluded")}
    joined = personal.select(*[F.col(c).alias(f"__o_{c}") if c in old else F.col(c) for c in personal.columns]).join(facts, "key", "left")

    def facet(name: str) -> Column:
        return F.col("company_fit") if name == "company_fit" else F.col(f"extracted.{name}")

    judged = F.col("judged_dim_scores") if "judged_dim_scores" in personal.columns else None
    judged_all = F.col("judged_fit") if "judged_fit" in personal.columns else None
    scored = score_rows(joined, rubric, facet, judged, judged_all)
    has_facets = F.col("extracted").isNotNull()
    return scored.select(
        *[F.col(c) for c in kept.columns],
        F.when(has_facets, F.col("dim_scores")).otherwise(old["dim_scores"]).alias("dim_scores"),
        F.when(has_facets, F.col("computed_score")).otherwise(old["computed_score"]).alias("computed_score"),
        F.when(has_facets, F.col("hard_excluded")).otherwise(F.coalesce(old["hard_excluded"], F.lit(False))).alias("hard_excluded"),
    )


def ranked_view(
    personal: DataFrame, registry: DataFrame, applications: DataFrame, reports: DataFrame, tracker: DataFrame,
    companies: DataFrame, max_open: int, order: str = "tracker_num",
) -> DataFrame:
    """The ranked queue: personal ⟕ registry ⟕ lifecycle ⟕ company state and cap."""
    cols = [c for c in registry.columns if c not in ("extracted", "key", "comp", "apply_url")]
    # What was read from the text goes before what the feed said.
    facets = registry.schema["extracted"].dataType.names
    pays = [F.col(c) for c, known in (("extracted.comp", "comp" in facets), ("comp", "comp" in registry.columns)) if known]
    extra = [F.coalesce(*pays).alias("comp")] if pays else []
    if "apply_url" in registry.columns:
        extra.append(or_else(F.col("apply_url"), F.col("url")).alias("apply_url"))
    r = registry.select("key", *cols, *extra, F.col("extracted").isNotNull().alias("researched"), *[F.col(f"extracted.{f}").alias(f) for f in FACETS])
    rows = personal.join(r, "key", "left")
    by_url, by_id = lifecycle_tables(applications, reports, tracker, order)
    rows = with_lifecycle(rows, by_url, by_id)
    open_counts = open_per_company(with_company_key(applications, registry))
    state = companies.select(
        F.col("key").alias("company_key"), F.col("decision").alias("company_decision"), F.col("fit").alias("company_fit")
    ).join(open_counts, "company_key", "full_outer")
    rows = lookup(rows, state, "company_key")
    applied = F.col("tracked") & (F.coalesce("status", F.lit("")) != "Evaluated")
    return rows.withColumns({
        "company_decision": or_else(F.col("company_decision"), F.lit("undecided")),
        "open_count": F.coalesce("open_count", F.lit(0)).cast("long"),
        "live": F.coalesce("live", F.lit(True)),
        "researched": F.coalesce("researched", F.lit(False)),
        "has_body": F.coalesce("has_body", F.lit(False)),
        "hard_excluded": F.coalesce("hard_excluded", F.lit(False)),
        "display_score": display_score(F.col("manual_score"), F.col("computed_score"), F.col("rank")),
        "applied": applied | F.coalesce(F.col("decision") == "applied", F.lit(False)),
        "decision": F.when(applied, "applied").otherwise(or_else(F.col("decision"), F.lit("undecided"))),
    }).withColumn("capped", F.col("open_count") >= max_open)


def patch_listings(personal: DataFrame, registry: DataFrame, companies: DataFrame, patch: DataFrame, rubric: Rubric) -> tuple[DataFrame, DataFrame]:
    """Personal layer and registry after a patch of judged listings; what the patch leaves out stays.

    ``patch`` (one row per key) may bring rank, reason, fit_brief, judged_fit, judged_dim_scores (a map that
    replaces the old one, its nulls dropped) and extracted (merged field by field). Patched listings with
    facets are scored anew from facets and rubric; a score is never taken from the patch.
    """
    touched = patch.select("key").distinct()
    fields = ["rank", "reason", "fit_brief", "judged_fit"]
    updated = patch_columns(personal, patch, "key", fields, blank_is_missing=["fit_brief"])
    given = patch.select("key", F.lit(True).alias("__hit"), *([F.map_filter("judged_dim_scores", lambda _, v: v.isNotNull()).alias("__dims")] if "judged_dim_scores" in patch.columns else []))
    updated = lookup(updated, given, "key")
    values = {"last_reviewed": F.when(F.col("__hit"), or_else(F.col("last_reviewed"), F.lit("llm"))).otherwise(F.col("last_reviewed"))} if "last_reviewed" in personal.columns else {}
    if "__dims" in given.columns and "judged_dim_scores" in personal.columns:
        values["judged_dim_scores"] = F.coalesce("__dims", "judged_dim_scores")
    updated = updated.withColumns(values) if values else updated
    facts = registry
    if "extracted" in patch.columns:
        names = registry.schema["extracted"].dataType.names
        have = patch.schema["extracted"].dataType.names
        typed = {f.name: f.dataType for f in registry.schema["extracted"].dataType.fields}
        brought = F.when(F.col("extracted").isNotNull(), F.struct(*[(F.col(f"extracted.{n}") if n in have else F.lit(None)).cast(typed[n]).alias(n) for n in names]))
        facts = lookup(registry, patch.select("key", brought.alias("__extracted")), "key")
        facts = facts.withColumn("extracted", merge_structs(F.col("extracted"), F.col("__extracted"), names)).drop("__extracted")
    mine = updated.where("__hit").select(*personal.columns)
    rest = updated.where("__hit IS NULL").select(*personal.columns)
    scored = score_registry(mine, facts.join(touched, "key", "left_semi"), companies, rubric)
    return rest.unionByName(scored.select(*personal.columns)), facts


def cap_flags(listings: DataFrame, applications: DataFrame, max_open: int) -> DataFrame:
    return with_cap(listings, open_per_company(applications), max_open)
