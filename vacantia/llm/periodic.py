"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
``max(MIN_WORDS, 2 * q)`` words that no neighbouring word extends. Every word of a run has an equal word q places away
inside it. So a word that occurs once within a segment is in no run and splits the segment; what is too short for a run
goes; parts are split again by their own counts until nothing changes. In running text little is left after that.

Surviving segments are scanned by lag. Lags below ``SMALL_LAG`` are compared over the whole segment. A longer run of
period q in [Q, 2Q) matches itself over at least Q words at distance q, so it holds a stretch of g = Q/2 words that
starts at a multiple of g and comes back at distance q. Ranks of all stretches of 2, 4, 8, ... words (doubling) show
which distances occur at all; at each, common extensions to both sides are read off the ranks. A segment of m words
costs O(m log^2 m) at most, also if all its words are equal. A stretch found at several lags counts with the smallest,
which is its period.

Null and empty texts have no words and no runs. Ranks are exact, not hashes. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled, plain_words

MIN_WORDS = 12
SMALL_LAG = 16  # at least MIN_WORDS, a power of two
CANDIDATES = 1 << 20  # distances looked at together; bounds memory, all are looked at

RUNS = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the equal word before and after each word; -1 and the length where there is none."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def surviving(ids: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Segments in which every word occurs twice or more, of at least ``least`` words.

    Of the parts of a split segment, the largest only has its words looked at again whose neighbour lies in what was cut
    off; so a word is looked at O(log n) times.
    """
    n = len(ids)
    if n < least:
        return []
    before, after = neighbours(ids)
    out: list[tuple[int, int]] = []
    todo: list[tuple[int, int, np.ndarray]] = [(0, n, np.arange(n))]
    while todo:
        lo, hi, look = todo.pop()
        cuts = look[(before[look] < lo) & (after[look] >= hi)]
        if not len(cuts):
            out.append((lo, hi))
            continue
        cuts = np.unique(cuts)
        starts, ends = np.concatenate(([lo], cuts + 1)), np.concatenate((cuts, [hi]))
        sizes = ends - starts
        largest = int(np.argmax(sizes))
        for k in np.flatnonzero(sizes >= least):
            a, b = int(starts[k]), int(ends[k])
            if k != largest:
                todo.append((a, b, np.arange(a, b)))
                continue
            gone = np.concatenate((np.arange(lo, a), np.arange(b, hi)))
            near = np.concatenate((before[gone], after[gone]))
            todo.append((a, b, near[(near >= a) & (near < b)]))
    return sorted(out)


class Ranks:
    """Ranks of all stretches of 1, 2, 4, ... words of a segment, as far as any comes back: equal rank, equal stretch."""

    def __init__(self, ids: np.ndarray):
        size, width = len(ids), 1
        self.levels = []
        level = np.unique(ids, return_inverse=True)[1]
        while len(level) and level.max() + 1 < len(level):
            self.levels.append(level.astype(np.int32))
            level = np.unique(level[:-width] * (size + 1) + level[width:], return_inverse=True)[1]
            width *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b > a on."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[k]
            inside = np.flatnonzero(b + n < len(ranks))
            n[inside[ranks[(a + n)[inside]] == ranks[(b + n)[inside]]]] += 1 << k
        return n

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b > a."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks, width = self.levels[k], 1 << k
            inside = np.flatnonzero(a - n >= width)
            n[inside[ranks[(a - n)[inside] - width] == ranks[(b - n)[inside] - width]]] += width
        return n


def _small_lags(ids: np.ndarray, limit: int, least: int) -> Iterator[np.ndarray]:
    """Rows start, end, lag of the stretches found by comparing the segment with itself at each lag below ``limit``."""
    for lag in range(1, min(limit, len(ids) // 2 + 1)):
        equal = np.zeros(len(ids) - lag + 2, np.int8)
        equal[1:-1] = ids[lag:] == ids[:-lag]
        step = np.diff(equal)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = end - start >= max(least - lag, lag)
        yield np.stack((start[long], end[long] + lag, np.full(long.sum(), lag)), axis=1)


def _large_lags(ids: np.ndarray, limit: int, small: np.ndarray) -> Iterator[np.ndarray]:
    """The same for lags from ``limit`` on, looking only at distances at which a stretch of the segment comes back.

    A stretch that comes back within a run of a smaller period (of ``small``) comes back at a multiple of that period and
    says nothing new.
    """
    size = len(ids)
    ranks = Ranks(ids)
    furthest = np.zeros(size, np.int64)  # end and period of the run that reaches furthest from each word
    np.maximum.at(furthest, small[:, 0], small[:, 1] * limit + small[:, 2])
    furthest = np.maximum.accumulate(furthest)
    low = limit
    while low <= size // 2:
        top = low.bit_length() - 2  # stretches of low / 2 words
        if top >= len(ranks.levels):
            return  # no stretch of this size comes back, so no longer one does
        width, level = 1 << top, ranks.levels[top].astype(np.int64)
        order = np.argsort(level, kind="stable")
        key = level[order] * (size + 1) + order
        anchors = np.arange(0, len(level), width)
        at = level[anchors] * (size + 1)
        first = np.searchsorted(key, at + np.minimum(anchors + low, size), "left")
        count = np.searchsorted(key, at + np.minimum(anchors + 2 * low, size), "left") - first
        upto = np.cumsum(count)
        begin = 0
        while begin < len(anchors):
            done = upto[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + CANDIDATES, "right")))
            n = count[begin:stop]
            if n.sum():
                a = np.repeat(anchors[begin:stop], n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[begin:stop], n)
                b = order[place]
                new = (furthest[a] // limit < b + width) | (furthest[a] % limit > width)
                a, b = a[new], b[new]
                start = a - ranks.back(a, b)
                end = a + ranks.ahead(a, b)
                lag = b - a
                long = end - start >= lag
                yield np.unique(np.stack((start[long], (end + lag)[long], lag[long]), axis=1), axis=0)
            begin = stop
        low *= 2


def segment_runs(ids: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """Rows start, end, period of the runs of one segment."""
    limit = SMALL_LAG
    while limit < least:
        limit *= 2
    small = np.concatenate([np.zeros((0, 3), np.int64), *_small_lags(ids, limit, least)])
    found = np.concatenate([small, *_large_lags(ids, limit, small)])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # A stretch with several lags has the smallest as its period, and the others are multiples of it.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def runs_of(words: list[str], least: int = MIN_WORDS) -> np.ndarray:
    """Rows start, end, period of all runs, by start and period."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    parts = [segment_runs(ids[a:b], least) + (a, a, 0) for a, b in surviving(ids, least)]
    found = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    covers = np.zeros(len(words) + 1, np.int64)
    np.add.at(covers, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covers, runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(covers[:-1]) == 0)]


def _runs(texts: pa.Array) -> pa.Array:
    tables, ends, kept = [np.zeros((0, 3), np.int64)], [0], []
    for text in texts:
        words = _WORD.findall(text.as_py())
        found = runs_of(words)
        tables.append(found)
        ends.append(ends[-1] + len(found))
        kept.append(" ".join(collapsed(words, found)))
    rows = np.concatenate(tables)
    columns = [pa.array(c, pa.int64()) for c in (rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2])]
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
    return pa.StructArray.from_arrays([runs, pa.array(kept, pa.string())], names=["runs", "collapsed"])


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic") -> DataFrame:
    """``docs`` with a struct of all runs (by start, then period) and the text without repeats: one blank between kept words."""
    return docs.withColumn(out, F.arrow_udf(_runs, RUNS)(filled(F.col(f"`{text}`"))))


def longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "text") -> DataFrame:
    """``docs`` whose every tenth text (by a checksum of its id) repeats itself from some word on; for measuring.

    With h = crc32 of the decimal id and g = floor(h / 10): if h % 10 = 0, word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null ids and texts without words stay as they are.
    """
    names = docs.columns
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    chosen = docs.select("*", h.alias("__h"), F.when(h % 10 == 0, plain_words(filled(F.col(f"`{text}`")))).alias("__words"))
    n = F.when(F.size("__words") > 0, F.size("__words"))
    g = F.floor(F.col("__h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cut = chosen.select("*", a.alias("__a"), p.alias("__p"), n.alias("__n"))
    part = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    rest = F.col("__n") - F.col("__a")
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil(rest / F.col("__p")).cast("int"))), F.lit(1), rest)
    new = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    changed = F.when(F.col("__n") > 0, new).otherwise(F.col(f"`{text}`"))
    return cut.select(*[changed.alias(out) if c == out else F.col(f"`{c}`") for c in names], *([] if out in names else [changed.alias(out)]))
