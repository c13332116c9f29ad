"""Patches, edits and keyed state: merges in which only what was given changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import excluded_type
from ..functions.text import norm_label, strip


def patch_columns(current: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], blank_is_missing: Sequence[str] = ()) -> DataFrame:
    """Overwrite the given columns where the patch has a value; one patch row per key."""
    names = [c for c in columns if c in patch.columns]
    given = patch.select(key, *[
        (F.nullif(F.col(c), F.lit("")) if c in blank_is_missing else F.col(c)).alias(f"__q_{c}") for c in names
    ])
    joined = current.join(given, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"__q_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in current.columns
    ])


def patch_companies(personal: DataFrame, research: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranks, fit and reason from a patch; a corrected company type re-decides the exclusion."""
    fields = ["rank", "fit", "fit_brief", "reason"]
    updated = patch_columns(personal, patch, "key", fields, blank_is_missing=["fit_brief"])
    if "company_type" not in patch.columns:
        return updated, research
    types = patch.where("coalesce(company_type, '') <> ''").select("key", F.col("company_type").alias("__type"))
    updated = updated.join(types, "key", "left").withColumn(
        "excluded_by_type",
        F.when(F.col("__type").isNotNull(), excluded_type(F.col("__type"))).otherwise(F.col("excluded_by_type")),
    ).drop("__type")
    return updated, patch_columns(research, types.withColumnRenamed("__type", "company_type"), "key", ["company_type"])


def merge_maps(old: Column, new: Column) -> Column:
    """Map with the new entries winning; null values of the new map are dropped first."""
    given = F.map_filter(new, lambda _, v: v.isNotNull())
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(given, k))
    return F.when(new.isNull(), old).when(old.isNull(), given).otherwise(F.map_concat(kept, given))


def merge_structs(old: Column, new: Column, fields: Sequence[str]) -> Column:
    """Field by field: the new value where given, else the old one; null when both are null."""
    merged = F.struct(*[F.coalesce(new[f], old[f]).alias(f) for f in fields])
    return F.when(old.isNull() & new.isNull(), F.lit(None)).otherwise(merged)


def latest_values(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per key the last non-null value of each column. Combines before the shuffle."""
    position = F.struct(*order)
    return events.groupBy(*keys).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in columns
    ])


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keyed state after changes (one row per key): given values replace, missing ones stay."""
    columns = [c for c in state.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__c_{c}") for c in columns if c in changes.columns])
    joined = state.join(new, key, "full_outer")
    return joined.select(key, *[
        F.coalesce(F.col(f"__c_{c}"), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in columns
    ])


def answer_text(value: Column) -> Column:
    """Boolean answers read Yes and No."""
    return F.when(F.lower(value) == "true", "Yes").when(F.lower(value) == "false", "No").otherwise(value)


def remember_answers(memory: DataFrame, answers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Answer memory (norm_label, value, type, label) after new answers; the last one wins."""
    rows = answers.withColumns({"norm_label": norm_label(F.col("label")), "value": answer_text(F.col("value"))})
    rows = rows.where((F.col("norm_label") != "") & (strip(F.coalesce(F.col("value"), F.lit(""))) != ""))
    last = rows.groupBy("norm_label").agg(
        F.max_by(F.struct("value", "type", "label"), F.struct(*order)).alias("__last")
    )
    changes = last.select("norm_label", "__last.value", "__last.type", "__last.label")
    return upsert(memory, changes, "norm_label")


# Decisions that may be set by hand.
LISTING_DECISIONS = ("shortlist", "skip", "applied", "undecided")
COMPANY_DECISIONS = ("keep", "skip", "undecided")


def check_edits(edits: DataFrame, decisions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split an edit log (key, field, value) into valid and rejected edits.

    A decision must be a known one, a score or fit a number from 0 to 5; a blank manual score
    clears it.
    """
    number = F.col("value").try_cast("double")
    in_range = F.coalesce((number >= 0) & (number <= 5), F.lit(False))
    blank = F.coalesce(F.col("value"), F.lit("")) == ""
    ok = (
        F.when(F.col("field") == "decision", F.coalesce(F.col("value").isin(*decisions), F.lit(False)))
        .when(F.col("field") == "manual_score", blank | in_range)
        .when(F.col("field") == "fit", in_range)
        .otherwise(False)
    )
    checked = edits.withColumn("__ok", ok)
    return checked.where("__ok").drop("__ok"), checked.where("NOT __ok").drop("__ok")


def apply_edits(rows: DataFrame, edits: DataFrame, order: Sequence[str]) -> DataFrame:
    """Apply the last valid edit per key and field to existing rows; a blank score clears it."""
    last = edits.groupBy("key", "field").agg(F.max_by("value", F.struct(*order)).alias("value"))
    present = last.groupBy("key").agg(*[
        F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias(f"__e_{f}")
        for f in ("decision", "manual_score", "fit")
    ])
    joined = rows.join(present, "key", "left")
    out = []
    for c in rows.columns:
        edit = F.col(f"__e_{c}") if c in ("decision", "manual_score", "fit") else None
        if edit is None:
            out.append(F.col(c))
        else:
            value = edit["v"] if c == "decision" else F.nullif(edit["v"], F.lit("")).try_cast("double")
            out.append(F.when(edit.isNotNull(), value).otherwise(F.col(c)).alias(c))
    return joined.select(*out)
