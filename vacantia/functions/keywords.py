"""Keyword rules compiled on the driver into one boolean Column."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


FEW = 8  # keywords


def clean_keywords(value) -> list[str]:
    """Config value → keywords: a scalar counts as one, non-strings and blanks are dropped."""
    if value is None:
        return []
    items: Iterable = value if isinstance(value, (list, tuple)) else [value]
    return [k.lower().strip() for k in items if isinstance(k, str) and k.strip()]


def clean_exclusions(value) -> list[str]:
    """Exclusion keywords in configured order and spelling, placeholders in brackets dropped."""
    items = value if isinstance(value, (list, tuple)) else ([] if value is None else [value])
    return [k for k in items if isinstance(k, str) and k.strip() and not re.fullmatch(r"\[.*\]", k.strip())]


def matches_any(text: Column, keywords: Sequence[str], word: bool = False) -> Column:
    """Does ``text`` (any case) hold one of the keywords?  Null text gives null."""
    return let(F.lower(text), lambda lowered: _any_in(lowered, keywords, word))


def _any_in(lowered: Column, keywords: Sequence[str], word: bool = False) -> Column:
    """Lists from a configuration: one test for each keyword. Long lists are tables (operators/containment)."""
    if not keywords:
        return F.lit(False)
    if word:
        return lowered.rlike(rf"\b(?:{'|'.join(re.escape(k) for k in keywords)})\b")
    return reduce(lambda a, b: a | b, [lowered.contains(k) for k in keywords])


def title_passes(title: Column, positive=(), negative=()) -> Column:
    """At least one positive keyword (if any are configured) and no negative one."""
    pos = [k.lower() for k in positive or ()]
    neg = [k.lower() for k in negative or ()]
    def passes(lowered: Column) -> Column:
        return (_any_in(lowered, pos) if pos else F.lit(True)) & ~_any_in(lowered, neg)

    # For a few keywords, lower() for each costs less than leaving generated code for a lambda.
    lowered = F.lower(F.coalesce(title, F.lit("")))
    return passes(lowered) if len(pos) + len(neg) <= FEW else let(lowered, passes)


def location_passes(location: Column, always_allow=None, allow=None, block=None) -> Column:
    """Tiered rule: blank passes, then always_allow, block, allow; no allow list passes."""
    always_kw, allow_kw, block_kw = clean_keywords(always_allow), clean_keywords(allow), clean_keywords(block)

    def passes(lowered: Column) -> Column:
        return (
            F.when(lowered == "", True)
            .when(_any_in(lowered, always_kw), True)
            .when(_any_in(lowered, block_kw), False)
            .when(_any_in(lowered, allow_kw), True)
            .otherwise(F.lit(not allow_kw))
        )

    return let(strip(F.lower(F.coalesce(location, F.lit("")))), passes)


def _holds(needle: str):
    return lambda t: t.contains(needle)


def first_exclusion(keywords: Sequence[str], *texts: Column, tags: Column | None = None) -> Column:
    """The first configured keyword found in any text or tag, else null."""
    def first(lowered: Column) -> Column:
        hits = []
        for keyword in keywords:
            needle = keyword.lower().strip()
            if needle:
                hits.append(F.when(F.exists(lowered, _holds(needle)), F.lit(keyword)))
        return F.coalesce(*hits) if hits else F.lit(None).cast("string")

    everything = F.array(*[F.lower(F.coalesce(t, F.lit(""))) for t in texts])
    if tags is not None:
        listed = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.lower(t))
        everything = F.concat(everything, F.coalesce(listed, F.array().cast("array<string>")))
    return let(everything, first)


def boost(text: Column, keywords: Sequence[str], amount: float) -> Column:
    """Priority boost when a keyword occurs; never removes a row."""
    return F.when(F.coalesce(matches_any(text, clean_keywords(list(keywords))), F.lit(False)), float(amount)).otherwise(0.0)


def keyword_counts(text: Column, classes: dict[str, Sequence[str]]) -> Column:
    """Array of struct(n, tag) with the number of a class's keywords present in the text."""
    def counted(lowered: Column) -> Column:
        return F.array(*[
            F.struct(
                reduce(lambda a, b: a + b, [lowered.contains(k.lower()).cast("int") for k in words]).alias("n"),
                F.lit(tag).alias("tag"),
            )
            for tag, words in classes.items()
        ])

    return let(F.lower(F.coalesce(text, F.lit(""))), counted)


def top_classes(counts: Column, keep: int = 2) -> Column:
    """The ``keep`` best classes with a hit; ties in configured order."""
    ranked = F.transform(counts, lambda x, i: F.struct((-x["n"]).alias("neg"), i.alias("pos"), x["tag"].alias("tag")))
    hits = F.filter(F.array_sort(ranked), lambda x: x["neg"] < 0)
    return F.transform(F.slice(hits, 1, keep), lambda x: x["tag"])
