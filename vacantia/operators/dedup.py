"""Seen-filters, first-wins and last-wins, scan outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_strip
from ..session import cut_lineage
from .skew import exclude, first_per_key, in_group


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.desc(c) for c in order])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.asc(c) for c in order])


def seen_urls(*sources: DataFrame) -> DataFrame:
    """Distinct non-empty URLs over all given one-column tables."""
    named = [s.toDF("url") for s in sources]
    return reduce(DataFrame.unionByName, named).where("url <> ''").distinct()


def seen_roles(applications: DataFrame, company: str = "company", role: str = "title") -> DataFrame:
    """Distinct (company, role) in lower case, blanks dropped."""
    return (
        applications.select(lower_strip(F.col(company)).alias("company_lc"), lower_strip(F.col(role)).alias("role_lc"))
        .where("company_lc <> '' AND role_lc <> ''")
        .distinct()
    )


def unseen(listings: DataFrame, urls: DataFrame, roles: DataFrame, url: str, company: str, role: str) -> DataFrame:
    """Listings whose URL and whose (company, role) are both new."""
    tagged = listings.withColumns({"__c": F.lower(F.col(company)), "__r": F.lower(F.col(role))})
    fresh = exclude(tagged, urls, {url: "url"})
    return exclude(fresh, roles, {"__c": "company_lc", "__r": "role_lc"}).drop("__c", "__r")


def first_wins_two_keys(
    df: DataFrame, url: str, role: Sequence[str], order: str, max_rounds: int | None = None,
) -> DataFrame:
    """Keep a row unless an earlier *kept* row has its URL or its role.

    The result equals a pass over the rows in ``order`` (which must be unique), but is found in
    rounds: a row that is the earliest open one of both its keys is kept, all open rows sharing a
    key with a kept row are dropped. A round costs a fixed number of aggregations and joins; the
    number of rounds is the length of the longest chain of rows that decide each other, usually
    below five. A key that is null (a null url, a role with a null part) equals nothing: it never
    makes a row a duplicate, and a row without either key is kept. Open rows are checkpointed per round, so a lost executor costs one round.
    """
    keys = ["__u", *[f"__r{i}" for i in range(len(role))]]
    roles = keys[1:]
    slim = df.select(
        F.col(url).alias("__u"), *[F.col(c).alias(f"__r{i}") for i, c in enumerate(role)], F.col(order).alias("__o")
    )
    no_role = reduce(lambda a, b: a | b, [F.col(r).isNull() for r in roles])
    no_url = F.col("__u").isNull()
    kept, rounds = [slim.where(no_url & no_role).select("__o")], 0
    # Of rows equal in both keys only the earliest can be kept; a row with a null key is equal to none.
    alone = F.when(no_url | no_role, F.col("__o"))
    some = slim.where(~(no_url & no_role))
    open_rows = cut_lineage(some.groupBy(*keys, alone.alias("__alone")).agg(F.min("__o").alias("__o")).drop("__alone"))
    while not open_rows.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError("first_wins_two_keys: more rounds needed than allowed")
        by_url = open_rows.groupBy("__u", F.when(no_url, F.col("__o"))).agg(F.min("__o").alias("__mu"))
        by_role = open_rows.groupBy(*roles, F.when(no_role, F.col("__o"))).agg(F.min("__o").alias("__mr"))
        first = by_url.join(by_role, F.col("__mu") == F.col("__mr")).select(F.col("__mu").alias("__o"))
        winners = cut_lineage(open_rows.join(first, "__o", "left_semi"))
        kept.append(winners.select("__o"))
        flagged = in_group(open_rows, winners, ["__u"], "__taken_url")
        flagged = in_group(flagged, winners, roles, "__taken_role")
        open_rows = cut_lineage(flagged.where("NOT __taken_url AND NOT __taken_role").select(*keys, "__o"))
        rounds += 1
    winners = reduce(DataFrame.unionByName, kept).withColumnRenamed("__o", order)
    return df.join(winners, order, "left_semi")


# Outcomes in the order in which they are decided.
OUTCOMES = ("skipped_title", "skipped_location", "skipped_dup", "added")


def scan_outcomes(
    listings: DataFrame, title_ok: Column, location_ok: Column, urls: DataFrame, roles: DataFrame,
    url: str, company: str, role: str, order: str,
) -> DataFrame:
    """Tag every scanned row with what happened to it; nothing is dropped.

    Title and location rules first, then the history, then earlier rows of the same scan.
    """
    tagged = listings.withColumns({
        "__title_ok": F.coalesce(title_ok, F.lit(False)),
        "__location_ok": F.coalesce(location_ok, F.lit(False)),
        "__co": F.lower(F.col(company)),
        "__ro": F.lower(F.col(role)),
    })
    candidates = tagged.where("__title_ok AND __location_ok")
    fresh = unseen(candidates, urls, roles, url, company, role)
    winners = first_wins_two_keys(fresh, url, ["__co", "__ro"], order).select(order, F.lit(True).alias("__new"))
    marked = tagged.join(winners, order, "left")
    outcome = (
        F.when(~F.col("__title_ok"), "skipped_title")
        .when(~F.col("__location_ok"), "skipped_location")
        .when(F.col("__new").isNull(), "skipped_dup")
        .otherwise("added")
    )
    return marked.withColumn("outcome", outcome).drop("__title_ok", "__location_ok", "__co", "__ro", "__new")


def outcome_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
