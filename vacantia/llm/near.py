"""Near duplicates: circulant MinHash, banding, and confirmation of every link on the full shingle sets.

Two permutations make all coordinates of a signature: one spreads the shingles over the 32-bit ring, the other, shifted
along the ring by k, gives coordinate k. ``BANDS`` bands of ``ROWS`` coordinates make a pair of similarity 0.85 share a
bucket with probability 1 - 8e-7, one of 0.80 with 1 - 7e-5, a closer pair with more.

Copies are one class from the start (equal digests of the word sequence), so a group of copies is one row per task in
every later shuffle. Links between classes come in two steps, which together confirm or refute every pair of classes
that shares a bucket, without listing the pairs of a group:

1. In each bucket, every class is compared with one centre, the class that shares its buckets with most others: of
   copies with edits, one with few of them. Confirmed links join components.
2. A pair left to compare lies in different components. Two sets of similarity t share one of their first
   n - ceil(t n) + 1 shingles in any order of all shingles; with the rarest first, these meet rarely, also inside a
   large group of copies with edits. Where two sets meet first, enough of both must still follow for the shingles they
   need in common. Pairs that meet so across components are compared, and their links join components.

A shingle is known by a 64-bit hash of its word hashes; equal hashes of different shingles are left aside (2^-64 a pair).
Null and empty texts and texts without words have no shingles and no links. Null ids come after all others, equal ids
are told apart by their row; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled, scratch, staged, with_row_key
from vacantia.llm.graph import components

SHINGLE = 5
PERCENT = 85  # similarity of a link, where the caller names no other
BANDS, ROWS = 24, 5
CHUNK = 4096  # shingles hashed at a time

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at exactly the six separators."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(words: list[bytes], hashes: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``size`` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _BASE + w[j : len(w) - k + 1 + j]
    return np.unique(_mix64(h))


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of the circulant signature."""
    place = _mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).astype(np.uint32)  # the first permutation, folded to the ring
    shift = np.arange(bands * rows, dtype=np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(place), CHUNK):
        np.minimum(low, _mix32(place[a : a + CHUNK, None] - shift[None, :]).min(axis=0), out=low)
    key = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T.astype(np.uint64):
        key = _mix64(key * _BASE + column)
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                s = shingle_set(words, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(band_keys(s) if len(s) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["__row", "doc_id", "n", "digest", "bands"],
            )


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [shingle_set(words_of(text.as_py()), hashes).view(np.int64) for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["cid", "set"])


def fits(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``u, v`` of which the full sets are similar enough."""
    a = sets.select(F.col("cid").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("cid").alias("v"), F.col("set").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("same", F.size(F.array_intersect("a", "b")))
    return both.where(100 * F.col("same") >= percent * (F.size("a") + F.size("b") - F.col("same"))).select("u", "v")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct word sequence, with its first row (smallest id, null last) and the size of its set."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    some = rows.where("n > 0").groupBy("digest").agg(F.min(place).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    return staged(some.withColumn("cid", F.monotonically_increasing_id()), "near-classes")


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """The prefix shingles of each set in the order of rarity, without those of one set only, and how many are left from there on."""
    tokens = sets.select("cid", F.size("set").alias("n"), F.explode("set").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(counts, "token").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))  # a set's own shingles
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    first = ranked.select("cid", "n", F.posexplode(F.slice("order", F.lit(1), length)).alias("i", "t")).where("t.df > 1")
    return first.select("cid", "n", (F.col("n") - F.col("i")).alias("rest"), "t.token")


def linked_classes(keyed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``cid, component`` of classes with a link to another class."""
    keys = classes.select("cid", "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(keys.join(shared, ["band", "key"]).select("band", "key", "cid", "n", "size"), "near-buckets")
    need = members.select("cid").distinct().join(classes, "cid").select("cid", F.col("rep.__row").alias("__row"))
    texts = keyed.join(need, "__row").select("cid", filled("text").alias("text"))
    sets = staged(texts.mapInArrow(_class_sets, "cid long, set array<long>"), "near-sets")

    sizes = classes.select(F.col("cid").alias("centre"), F.col("n").alias("m"))
    company = members.groupBy("cid").agg(F.sum("size").alias("company"))
    centres = members.join(company, "cid").groupBy("band", "key").agg(F.max_by("cid", F.struct("company", -F.col("cid"))).alias("centre"))
    stars = members.join(centres, ["band", "key"]).where("cid <> centre").select("cid", "n", "centre").distinct().join(sizes, "centre").where(fits(F.col("n"), F.col("m"), percent))
    first = staged(confirmed(stars.select(F.least("cid", "centre").alias("u"), F.greatest("cid", "centre").alias("v")).distinct(), sets, percent), "near-links-1")
    found = staged(components(first, "near-parts-1"), "near-components-1")

    labelled = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    mixed = labelled.groupBy("band", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band", "key")
    open_ = labelled.join(mixed, ["band", "key"]).select("cid", "part").distinct()
    rest = staged(open_, "near-open")
    prefix = rare_first(sets.join(rest, "cid", "left_semi"), percent).join(rest, "cid")
    several = prefix.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    meets = staged(prefix.join(several, "token"), "near-prefixes")
    a = meets.select("token", F.col("cid").alias("u"), F.col("part").alias("pu"), F.col("n").alias("nu"), F.col("rest").alias("ru"))
    b = meets.select("token", F.col("cid").alias("v"), F.col("part").alias("pv"), F.col("n").alias("nv"), F.col("rest").alias("rv"))
    enough = (100 + percent) * F.least("ru", "rv") >= percent * (F.col("nu") + F.col("nv"))
    pairs = a.join(b, "token").where((F.col("u") < F.col("v")) & (F.col("pu") != F.col("pv")) & enough & fits(F.col("nu"), F.col("nv"), percent)).select("u", "v").distinct()
    second = staged(confirmed(pairs, sets, percent), "near-links-2")
    links = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second)
    return components(links, "near-parts-2").withColumnRenamed("node", "cid")


def near_groups(keyed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of a table with ``__row``, ``doc_id`` and ``text``: ``__row``, ``doc_id``, the size of the set, and ``first``, the first row of its component."""
    texts = keyed.select("__row", "doc_id", filled("text").alias("text"))
    with scratch(keyed.sparkSession):
        return staged(_groups(keyed, texts, percent), "near-groups", keep=True)


def _groups(keyed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    rows = staged(texts.mapInArrow(_signatures, f"__row long, doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n long, digest binary, bands array<long>"), "near-signatures")
    classes = classes_of(rows)
    found = staged(linked_classes(keyed, classes, percent), "near-components-2")
    parts = classes.select("cid", "digest", "rep").join(found, "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    named = parts.join(parts.groupBy("part").agg(F.min("rep").alias("first")), "part").select("digest", "first")
    return rows.select("__row", "doc_id", "n", "digest").join(named, "digest", "left").select("__row", "doc_id", "n", "first")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: size of its set, smallest id of its component, and whether it is the one that stays."""
    got = near_groups(with_row_key(docs.select("doc_id", "text"), "near-docs"), percent)
    alone = F.col("first").isNull()
    return got.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.__row") == F.col("__row"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The first document of each group and all documents without words; columns as they were."""
    keyed = with_row_key(docs, "near-docs")
    stays = near_groups(keyed, percent).where(F.col("first").isNull() | (F.col("first.__row") == F.col("__row"))).select("__row")
    return keyed.join(stays, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
