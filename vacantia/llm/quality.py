"""Quality rules: text statistics as Columns, and an ordered list of threshold rules learned from labels.

Everything is DataFrame functions. ``learn_rules`` is sequential covering: each rule is grown by adding the threshold
that gains most, pruned against rows it was not grown on, and kept while it is precise enough; the rows it covers then
leave. Every step is one aggregation over all labelled rows, so that only counts per feature and threshold reach the
driver. ``decision`` turns the list into one ordered ``CASE`` expression.

Null and empty texts have no words and fail the base rule. Labels without a document or without a value are ignored;
repeated labels count as often as they are given. Without labels of both kinds the list is empty and keeps everything.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import SPACES, filled, plain_words, scratch, staged

REPEAT_WINDOW = 8
FEW_LABELS = 1_000_000
STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
DIGITS, CAPITALS, MARKS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?"
# Runs of what none of these counts: without them little of a text is left to count in.
COUNTED = rf"[^{re.escape(SYMBOLS)}0-9A-Z{re.escape(MARKS)}]+"

# Shares and means the rules may test, from the statistics and further counts.
FEATURES = {
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbol_share": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "words": lambda c: c("n_words").cast("double"),
    "line_words": lambda c: c("n_words") / F.greatest(c("n_lines"), F.lit(1)),
    "distinct_share": lambda c: c("n_distinct") / F.greatest(c("n_words"), F.lit(1)),
    "digit_share": lambda c: c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
    "upper_share": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "stop_share": lambda c: c("n_stops") / F.greatest(c("word_chars"), F.lit(1)),
}


def dropped(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` a text holds."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(hashes: Column, window: int) -> Column:
    """Words inside windows that occur at least twice: ``hashes`` are those of all windows in order.

    Windows are compared by 64-bit hashes within one text. Equal neighbours in hash order mark the repeated windows;
    the union of their words is summed over their sorted places.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(sorted_pairs: Column) -> Column:
        ups = F.zip_with(sorted_pairs, F.slice(sorted_pairs, 2, F.size(sorted_pairs)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.array_sort(F.array_distinct(F.flatten(ups)))

    # Binding by a lambda of one element computes the sorted arrays once.
    at = F.transform(F.array(placed), places)[0]

    def covered(x: Column) -> Column:
        before = F.concat(F.array(F.lit(-window)), x)
        return F.aggregate(F.zip_with(x, F.slice(before, 1, F.size(x)), lambda a, b: F.least(a - b, F.lit(window))), F.lit(0), lambda s, v: s + v)

    return F.transform(F.array(at), covered)[0].cast("long")


def text_stats(docs: DataFrame, keep: list[str], text: str = "text", window: int = REPEAT_WINDOW) -> DataFrame:
    """``keep`` columns and a struct ``stats`` of each whole text."""
    # Each costly array is a column of its own step that the next one uses more than once, which keeps Spark from
    # copying its expression into every use.
    body = docs.select(*[F.col(f"`{c}`") for c in keep], filled(F.col(f"`{text}`")).alias("__t"))
    words = body.select(
        *keep_cols(keep), F.col("__t"), plain_words(F.col("__t")).alias("__w"),
        F.filter(F.split(F.col("__t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("__l"),
        F.regexp_replace("__t", COUNTED, "").alias("__o"),
    )
    n = F.size("__w")
    hashes = words.select(
        *keep_cols(keep), "__o", "__l", n.alias("__n"), F.length(F.array_join("__w", "")).cast("long").alias("__c"), F.size(F.array_distinct("__w")).alias("__d"),
        F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("__w"), i, window))))
        .otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    odd, lines, h = F.col("__o"), F.col("__l"), F.col("__h")
    stats = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.col("__c").alias("word_chars"),
        dropped(odd, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), repeated_words(h, window)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.col("__d").cast("long").alias("n_distinct"),
        dropped(odd, DIGITS).alias("n_digits"),
        dropped(odd, CAPITALS).alias("n_upper"),
        dropped(odd, MARKS).alias("n_stops"),
    )
    # Passed through a generator of one row: a filter on it can't be moved below, where it would compute all of this again.
    return hashes.select(*keep_cols(keep), F.explode(F.array(stats)).alias("stats"))


def keep_cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def base_failed(stats: str = "stats") -> Column:
    """Too short, or too much of it said twice."""
    n, again = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 20) | (100 * again > 30 * n)


def feature_columns(stats: str = "stats") -> dict[str, Column]:
    return {name: make(lambda c: F.col(f"{stats}.{c}")) for name, make in FEATURES.items()}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.bound if self.above else values[self.feature] <= self.bound


@dataclass(frozen=True)
class Rule:
    """Rejects where all tests hold."""

    tests: tuple[Test, ...]

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(values)
        return out


def _counts(rows: DataFrame, names: list[str], bounds: dict[str, list[float]]) -> dict[Test, tuple[int, int]]:
    """For each possible test the bad and good rows that pass it; one aggregation of the rows by feature and bin."""
    got = rows.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    out: dict[Test, tuple[int, int]] = {}
    for i, f in enumerate(names):
        cells = {r["b"]: (r["bad"], r["n"] - r["bad"]) for r in got if r["f"] == i}
        for k, bound in enumerate(bounds[f]):
            for above in (True, False):
                inside = [c for b, c in cells.items() if (b > k) == above]
                out[Test(f, above, bound)] = sum(c[0] for c in inside), sum(c[1] for c in inside)
    return out


def learn_rules(
    stats: DataFrame, max_rules: int = 8, max_tests: int = 3, n_bounds: int = 24, precision: float = 0.95, least: float = 0.02
) -> list[Rule]:
    """Rules for bad rows from ``doc_id``, ``stats`` (a struct) and ``bad`` (0 or 1), one row per label.

    ``least`` is the share of all bad rows that a rule must cover on the rows it is pruned on, ``precision`` what it
    must reach there. Two thirds of the documents, chosen by hash of the id, grow rules; the rest prune them.
    """
    values = feature_columns()
    names = list(values)
    rows = staged(
        stats.select("bad", F.struct(*[c.alias(n) for n, c in values.items()]).alias("x"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow")), "labelled-stats"
    )
    totals = rows.agg(
        F.sum("bad").alias("bad"), F.count("*").alias("n"), F.sum(F.when(~F.col("grow"), F.col("bad"))).alias("held"),
        *[F.percentile_approx(f"x.{f}", [k / n_bounds for k in range(1, n_bounds)], 10_000).alias(f"all_{f}") for f in names],
        *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f"x.{f}")), [k / n_bounds for k in range(1, n_bounds)], 10_000).alias(f"bad_{f}") for f in names],
    ).first()
    if not totals["bad"] or totals["bad"] == totals["n"]:
        return []
    bounds = {f: sorted({*(totals[f"all_{f}"] or ()), *(totals[f"bad_{f}"] or ())}) for f in names}
    x = {n: F.col(f"x.{n}") for n in names}
    # The bin of each value, once for all steps: how many bounds of its feature it exceeds.
    rows = staged(rows.withColumn("bins", F.array(*[_bin(x[f], bounds[f]) for f in names])), "binned-stats")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for r in rules:
            left = left.where(~r.column(x))
        # By information gained over the rows covered; where that ends in a rule that is not precise, by precision.
        found = None
        for gain in (_information, _precision):
            tests = _grow(left.where("grow"), names, bounds, x, max_tests, gain)
            found = _pruned(tests, left.where(~F.col("grow")), x, precision, least * (totals["held"] or 0)) if tests else None
            if found is not None:
                break
        if found is None:
            break
        rules.append(found)
    return rules


def _bin(value: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)) if bounds else F.lit(0)


def _information(p: int, q: int, bad: int, good: int) -> float:
    return p * (log2(p / (p + q)) - log2(bad / (bad + good)))


def _precision(p: int, q: int, bad: int, good: int) -> float:
    return (p + 1) / (p + q + 2) - (bad + 1) / (bad + good + 2)


def _grow(within: DataFrame, names: list[str], bounds: dict[str, list[float]], x: dict[str, Column], max_tests: int, gain: Callable) -> list[Test]:
    """Tests added one by one, each the one that gains most, until no good row is covered."""
    tests: list[Test] = []
    start = within.agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).first()
    bad, good = start["bad"] or 0, start["n"] - (start["bad"] or 0)
    while bad and good and len(tests) < max_tests:
        ways = [(gain(p, q, bad, good), p, t, (p, q)) for t, (p, q) in _counts(within, names, bounds).items() if p]
        best = max(ways, key=lambda w: w[:2], default=None)
        if best is None or best[0] <= 0:
            break
        tests.append(best[2])
        within = within.where(best[2].column(x))
        bad, good = best[3]
    if not tests:
        return []
    # A bound in the middle of the gap to what the test covers, so that rows near the good side stay.
    edges = within.where("bad = 1").agg(*[(F.min if t.above else F.max)(f"x.{t.feature}").alias(f"e{k}") for k, t in enumerate(tests)]).first()
    return [Test(t.feature, t.above, (t.bound + edges[f"e{k}"]) / 2 if t.above else t.bound) for k, t in enumerate(tests)]


def _pruned(tests: list[Test], held: DataFrame, x: dict[str, Column], precision: float, least: float) -> Rule | None:
    """Of all beginnings of the conjunction the one with the best net cover on the held rows, if it is precise enough."""
    ways = [Rule(tuple(tests[:k])) for k in range(1, len(tests) + 1)]
    got = held.agg(*[a for k, w in enumerate(ways) for a in (F.sum(F.when(w.column(x), F.col("bad"))).alias(f"p{k}"), F.count(F.when(w.column(x), 1)).alias(f"n{k}"))]).first()
    seen = [(got[f"p{k}"] or 0, got[f"n{k}"]) for k in range(len(ways))]
    k = max(range(len(ways)), key=lambda j: ((2 * seen[j][0] - seen[j][1]) / max(seen[j][1], 1), seen[j][0], -j))
    p, n = seen[k]
    return ways[k] if n and p >= precision * n and p >= least else None


def decision(rules: list[Rule], stats: str = "stats") -> Column:
    """The first rule that rejects a row as its number from 1, else 0."""
    values = feature_columns(stats)
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(values), F.lit(k)).otherwise(out)
    return out


def with_label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a label speaks of: their ids are counted, and sent to every task if they are few (8 bytes each)."""
    ids = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    few = ids.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents with ``bad``."""
    given = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__id"), (1 - F.col("quality")).alias("bad"))
    return stats.join(given, stats["doc_id"] == given["__id"]).select("doc_id", "stats", "bad")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the base statistics, the base rule and the verdict of base rule and learned rules."""
    stats = staged(text_stats(docs.select("doc_id", "text"), ["doc_id"]), "text-stats")
    rules = learn_rules(labelled(stats, labels))
    rule = decision(rules)
    failed = base_failed()
    return stats.select("doc_id", *[f"stats.{c}" for c in STAT_COLUMNS], failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they were.

    Rules are learned from the statistics of the labelled documents alone; then those of all are computed as they are
    judged, so that no text is written here.
    """
    names = docs.columns
    packed = docs.select(F.struct(*keep_cols(names)).alias("__doc"), F.col("doc_id"), F.col("text"))
    with scratch(docs.sparkSession):
        rules = learn_rules(labelled(text_stats(with_label(packed.select("doc_id", "text"), labels), ["doc_id"]), labels))
    stats = text_stats(packed, ["__doc"])
    return stats.where(~base_failed() & (decision(rules) == 0)).select("__doc.*")
