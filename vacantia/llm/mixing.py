"""Mixing sources to target weights: exact block quotas per output shard from a multivariate-hypergeometric tree.

Every document has a place in its source's random order: a 63-bit hash of seed, id and text. The first 12 bits are its
block. A source is read along that order until its target is met, whole passes first, then a part of one more: all
places below a bound, plus a chosen few of the at most ``fine`` documents at the bound, so that the words taken come
as near the target as these documents allow. The bound is found by counting words per block, then per part of the block
in which the target falls, and so on: aggregations whose result is one row per source.

The block draws of all sources are dealt among the output shards by splitting the shards into halves, each half's
counts per source being drawn from a multivariate hypergeometric distribution, down to single shards. A source's draws,
in their order, fill the shards by these quotas, so that shards get disjoint blocks. Inside a shard, rows are ordered by
another hash. All of it follows from the seed and the rows alone: reruns agree.

Sources are ordered by code point, null last, and weigh ``WEIGHTS`` in turn. Sources are kept on the driver and
broadcast; their number is configuration-sized and checked against ``MAX_SOURCES``. Null and empty texts have size 0 and
are drawn with their block. Rows equal in id and text are drawn together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import filled, plain_words, staged

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)  # of all words
MOST = 2  # times a source, and so a document, may be taken
SEED = 20_240
BITS = 12
BLOCKS = 1 << BITS
FINE = 256
MAX_SOURCES = 20_000
SHARD_WORDS = 2_000_000
LEAST_SHARDS, MOST_SHARDS = 32, 1_024
NO_SOURCE = "\U0010ffff none"  # stands for null in joins; after every other name

_PLACE_BITS = 60


@dataclass
class Source:
    name: str | None
    size: int
    target: float = 0.0
    passes: int = 0
    bound: int = 0  # places below it are in the part of a pass
    chosen: list[int] = field(default_factory=list)  # places beyond it that are too
    quotas: list[int] = field(default_factory=list)


def size_of(text: str = "text") -> Column:
    return F.size(plain_words(filled(text))).cast("long")


def place_of(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 64 - _PLACE_BITS)


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Weighted shares of ``share`` times all words, none above ``most`` times its source, the excess shared again."""
    left, out = share * sum(sizes), [Fraction(0)] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] > most * sizes[i] * total}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def nearest(wanted: Fraction, docs: list[tuple[int, int]]) -> list[int]:
    """Places of documents (place, words), largest first where they still fit; one more if that comes nearer."""
    out, left = [], wanted
    for place, words in sorted(docs, key=lambda x: (-x[1], x[0])):
        if words <= left:
            out.append(place)
            left -= words
    rest = [(words, place) for place, words in docs if place not in set(out) and words]
    if rest and abs(left - min(rest)[0]) < left:
        out.append(min(rest)[1])
    return sorted(out)


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts per source dealt among ``shards``: an array of shards by sources with the same column sums."""
    out = np.zeros((shards, len(counts)), np.int64)

    def deal(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        mine = (total * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = draw.multivariate_hypergeometric(have, mine, method="marginals") if total else have
        deal(lo, mid, left)
        deal(mid, hi, have - left)

    deal(0, shards, np.asarray(counts, np.int64))
    return out


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """A number, source (null marked), size and place of each row, written once."""
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("__row"), "doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), size_of().alias("size"), place_of(seed).alias("place")
        ),
        "mix-sizes",
    )


def plan_mix(rows: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> tuple[list[Source], int]:
    """What to take of each source, and the number of shards, from ``measured`` rows."""
    spark = rows.sparkSession
    names = rows.groupBy("source").agg(F.sum("size").alias("size"))
    got = sorted(((r["source"], r["size"]) for r in names.limit(MAX_SOURCES + 1).collect()), key=lambda x: (x[0] == NO_SOURCE, x[0]))
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = [Source(None if n == NO_SOURCE else n, s) for n, s in got]
    if not sources:
        return [], LEAST_SHARDS
    exact = targets([s.size for s in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    left: dict[str, tuple[int, Fraction]] = {}  # by source: where the open part begins, and the words wanted of it
    for (name, size), s, t in zip(got, sources, exact, strict=True):
        s.target = float(t)
        s.passes = int(t // size) if size else 0
        if size and t > s.passes * size:
            left[name] = (0, t - s.passes * size)
    by_name = dict(zip((n for n, _ in got), sources, strict=True))
    shift = _PLACE_BITS
    while left:
        # Documents of the open parts, by source: few enough to choose among them, or cut into finer parts.
        width = shift
        opens = spark.createDataFrame([(n, lo) for n, (lo, _) in left.items()], "source string, lo long")
        inside = rows.join(F.broadcast(opens), "source").where(F.shiftright(F.col("place"), width) == F.shiftright(F.col("lo"), width)) if width < _PLACE_BITS else rows.join(F.broadcast(opens), "source")
        units = {r["source"]: r["n"] for r in inside.groupBy("source").agg(F.count("*").alias("n")).collect()}
        few = [n for n in left if units.get(n, 0) <= FINE or shift == 0]
        if few:
            docs: dict[str, dict[int, int]] = {n: {} for n in few}
            for r in inside.where(F.col("source").isin(few)).groupBy("source", "place").agg(F.sum("size").alias("size")).collect():
                docs[r["source"]][r["place"]] = r["size"]
            for n in few:
                lo, wanted = left.pop(n)
                by_name[n].bound = lo
                by_name[n].chosen = nearest(wanted, list(docs[n].items()))
        if not left:
            break
        shift -= BITS
        part = inside.where(F.col("source").isin(list(left))).withColumn("part", F.shiftright(F.col("place"), shift))
        sums = part.groupBy("source", "part").agg(F.sum("size").alias("size"))  # at most BLOCKS parts of a source
        order = Window.partitionBy("source").orderBy("part")
        upto = sums.withColumn("upto", F.sum("size").over(order))
        want = spark.createDataFrame([(n, float(w)) for n, (_, w) in left.items()], "source string, want double")
        crossed = upto.join(F.broadcast(want), "source").where((F.col("upto") > F.col("want")) | (F.col("upto") == F.col("want")))
        first = crossed.groupBy("source").agg(F.min(F.struct("part", "upto", "size")).alias("f")).collect()
        for r in first:
            lo, wanted = left[r["source"]]
            left[r["source"]] = (r["f"]["part"] << shift, wanted - (r["f"]["upto"] - r["f"]["size"]))
    shards = int(min(MOST_SHARDS, max(LEAST_SHARDS, sum(s.target for s in sources) // shard_words)))
    counts = [s.passes * BLOCKS + min(BLOCKS, (max([s.bound - 1, *s.chosen]) >> (_PLACE_BITS - BITS)) + 1 if s.bound or s.chosen else 0) for s in sources]
    for s, q in zip(sources, split_tree(np.array(counts), shards, seed).T, strict=True):
        s.quotas = [int(x) for x in q]
    return sources, shards


def plan_table(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """One row per source; bounded by the number of sources and by ``FINE`` places each."""
    made = [(NO_SOURCE if s.name is None else s.name, s.size, s.target, s.passes, s.bound, s.chosen, [int(x) for x in np.cumsum(s.quotas)]) for s in sources]
    return rows.sparkSession.createDataFrame(made, "__source string, source_size long, target double, passes int, bound long, chosen array<long>, ends array<long>")


def times_taken(place: Column) -> Column:
    extra = (place < F.col("bound")) | F.array_contains("chosen", place)
    return F.col("passes") + extra.cast("int")


def drawn(rows: DataFrame, plan: DataFrame, source: str, place: str, seed: int) -> DataFrame:
    """The draws: each row as often as it is taken, with its shard, the pass and its order in the shard.

    ``mix_shard`` follows from the quotas: a draw's block, counted over all passes, falls to the first shard whose share
    of its source's blocks is not used up by smaller blocks. A draw that no shard has a place for is none.
    """
    own = rows.join(F.broadcast(plan), F.col(source) == F.col("__source")).withColumn("__times", times_taken(F.col(place))).where("__times > 0")
    each = own.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    draw = F.col("mix_pass") * BLOCKS + F.shiftright(F.col(place), _PLACE_BITS - BITS)
    placed = each.withColumn("mix_shard", F.size(F.filter("ends", lambda e: e <= draw))).where(F.col("mix_shard") < F.size("ends"))
    return placed.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), place, "mix_pass")).drop("__times", *plan.columns)


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: its words, its source's words and target, the words the mix takes of it, and the first shard
    that gets it (null for none). What is taken is counted from the draws."""
    rows = measured(docs.select("doc_id", "text", "source"), seed)
    sources, _ = plan_mix(rows, seed)
    plan = plan_table(rows, sources)
    slim = rows.select("__row", F.col("source").alias("__of"), "place")
    counts = drawn(slim, plan, "__of", "place", seed).groupBy("__row").agg(F.count("*").alias("times"), F.min("mix_shard").alias("first_shard"))
    joined = rows.join(counts.hint("merge"), "__row", "left").join(F.broadcast(plan.select("__source", "source_size", "target")), F.col("source") == F.col("__source"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), "first_shard")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix: the columns of ``docs`` with ``mix_shard``, ``mix_pass`` and ``mix_order``, each shard in its order.

    A shard is one task. Columns of these names in ``docs`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_pass", "mix_order")]
    rows = measured(docs.select("doc_id", "text", "source"), seed)
    sources, shards = plan_mix(rows, seed)
    plan = plan_table(rows, sources)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.coalesce("source", F.lit(NO_SOURCE)).alias("__of"), place_of(seed).alias("__place"))
    placed = drawn(packed, plan, "__of", "__place", seed).select("__doc.*", "mix_shard", "mix_pass", "mix_order")
    return placed.repartitionById(shards, F.col("mix_shard")).sortWithinPartitions("mix_order")
