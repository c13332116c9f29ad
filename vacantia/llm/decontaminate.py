"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all benchmark items.

An item's window is ``window`` consecutive words of its folded text (an item of fewer words is one window). The
automaton holds every window once, framed by spaces, so that a match begins and ends at word borders. Folding keeps
byte offsets, hence a match maps straight back to bytes of the original text. Texts are scanned once per automaton;
a benchmark of more than ``automaton_bytes`` of windows is cut by items into several automata, one after another.

Null and empty texts have no words and no hits; items without words or without an id match nothing, repeated items
count once per id; other columns pass through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled, folded

WINDOW = 10
AUTOMATON_BYTES = 16 << 20  # windows of one automaton; its nodes take about thirty times as much

FOUND = "n_words long, first_words array<int>, end_words array<int>, first_bytes array<int>, end_bytes array<int>, items array<string>"


def item_windows(text: str, window: int) -> list[bytes]:
    words = folded(text).split()
    last = max(len(words) - window, 0)
    return [b" ".join(words[i : i + window]) for i in range(last + 1)] if words else []


def window_groups(benchmark: DataFrame, window: int, limit: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows and the items that hold them, cut between items so that no group exceeds ``limit`` bytes."""
    group: dict[bytes, list[str]] = {}
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    for row in rows.toLocalIterator():
        windows = item_windows(row["text"], window)
        grown = sum(map(len, windows))
        if group and size + grown > limit:
            yield group
            group, size = {}, 0
        size += grown
        for w in windows:
            holders = group.setdefault(w, [])
            if row["item"] not in holders:
                holders.append(row["item"])
    if group:
        yield group


_BUILT: dict[str, tuple[ahocorasick.Automaton, list[int], list[list[str]]]] = {}


def _automaton(shared: Broadcast) -> tuple[ahocorasick.Automaton, list[int], list[list[str]]]:
    """Built once per Python worker."""
    key, group = shared.value
    if key not in _BUILT:
        found = ahocorasick.Automaton()
        lengths, holders = [], []
        for w, items in group.items():
            found.add_word(f" {w.decode('latin-1')} ", len(lengths))
            lengths.append(w.count(b" ") + 1)
            holders.append(items)
        found.make_automaton()
        _BUILT[key] = found, lengths, holders
    return _BUILT[key]


def scan(text: str | None, built: tuple, before: dict | None = None) -> dict:
    """Hit runs of words and bytes (merged with those of an earlier automaton) and the items found."""
    automaton, lengths, holders = built
    raw = folded(text)
    words = raw.split()
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if before is not None and len(before["items"]):
        spans += zip(before["first_words"], before["end_words"], strict=True)
        items.update(before["items"])
    joined = f" {b' '.join(words).decode('latin-1')} "
    hits = list(automaton.iter(joined)) if lengths else []
    if hits:
        ends = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        for at, v in hits:
            end = int(np.searchsorted(ends, at))
            spans.append((end - lengths[v], end))
            items.update(holders[v])
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    firsts, ends_b = [], []
    if runs:
        inside = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        stops = np.flatnonzero(inside[:-1] & ~inside[1:])
        firsts, ends_b = [int(starts[a]) for a, _ in runs], [int(stops[b - 1]) for _, b in runs]
    return {
        "n_words": len(words), "first_words": [a for a, _ in runs], "end_words": [b for _, b in runs],
        "first_bytes": firsts, "end_bytes": ends_b, "items": sorted(items),
    }


def _scan(shared: Broadcast, before: Column | None) -> Column:
    names = [x.split()[0] for x in FOUND.split(", ")]
    if before is None:

        @F.pandas_udf(FOUND)
        def first(texts: pd.Series) -> pd.DataFrame:
            built = _automaton(shared)
            return pd.DataFrame([scan(t, built) for t in texts], columns=names)

        return first(filled("text"))

    @F.pandas_udf(FOUND)
    def later(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        built = _automaton(shared)
        return pd.DataFrame([scan(t, built, b) for t, b in zip(texts, earlier.to_dict("records"), strict=True)], columns=names)

    return later(filled("text"), before)


def find_passages(docs: DataFrame, benchmark: DataFrame, out: str = "found", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a struct of its hit runs (word and byte offsets, end exclusive) and the items found."""
    sc = docs.sparkSession.sparkContext
    state: Column | None = None
    for group in list_or_empty(window_groups(benchmark, window, automaton_bytes)):
        shared = sc.broadcast((uuid.uuid4().hex, group))

        state = _scan(shared, state)
    return docs.withColumn(out, state)


def list_or_empty(groups: Iterator[dict[bytes, list[str]]]) -> Iterator[dict[bytes, list[str]]]:
    """An empty benchmark is one empty group: every text is still counted."""
    empty = True
    for group in groups:
        empty = False
        yield group
    if empty:
        yield {}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found and a digest of their sorted ids."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, window=window).select("doc_id", "found")
    n_hit = F.aggregate(F.zip_with("found.first_words", "found.end_words", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.items") > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, all columns as they were."""
    names = docs.columns
    mark = "__found"
    return find_passages(docs, benchmark, mark, window).where(F.size(f"{mark}.items") == 0).select(*[F.col(f"`{c}`") for c in names])
