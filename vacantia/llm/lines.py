"""Line dedup by a suffix array over line ids, built by distributed prefix doubling; DataFrame functions only.

A document is the sequence of its lines that hold a word, trimmed of the six separators. Ranks order all suffixes by
their first 1, 2, 4, ... lines: the ranks for twice the length come from sorting pairs of ranks. A suffix whose prefix
no other suffix shares can't be in any longer repeated run and leaves, so later rounds only see what still repeats.
Suffixes of equal rank are an interval of common prefix; an interval over a run of any length is the pair of ranks of
the two (overlapping) powers of two that cover the run.

The rule: a line goes if it lies in a run of consecutive lines of at least ``min_words`` words in total that also
starts earlier (smaller ``doc_id``, null last, or earlier in the document). It is enough to compare, for each line, the
shortest such run that starts there and the shortest that ends there: in a repeated run every line lies in one of these.
Each has at most ``min_words`` lines, so the number of rounds does not depend on the data.

Null and empty texts have no lines; documents with equal or null ids are told apart by their row. Blank lines are
neither compared nor removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import SPACES, filled, plain_words, scratch, staged, with_row_key

MIN_WORDS = 20


def keep_cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def worded_lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: row, doc_id, place in the text, place among such lines, id of two hashes, words before and up to it."""
    raw = docs.select("__row", "doc_id", F.posexplode(F.split(filled("text"), "\n")).alias("line_no", "raw"))
    lines = raw.select("__row", "doc_id", "line_no", F.btrim("raw", F.lit(SPACES)).alias("line")).where("line <> ''")
    by_doc = Window.partitionBy("__row").orderBy("line_no")
    ids = lines.select(
        "__row", "doc_id", "line_no", F.size(plain_words(F.col("line"))).cast("long").alias("words"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
    )
    return ids.select(
        "__row", "doc_id", "line_no", "h1", "h2", "words", F.row_number().over(by_doc).alias("seq"), F.sum("words").over(by_doc).alias("upto"),
    )


def repeated_ranks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Of the distinct keys that occur twice or more, the rank in sorted order (increasing, with gaps).

    Counting is combined before the shuffle, so that a key with a third of all rows is one row per task. The sorted
    order comes from a range partitioning that is fixed by writing it.
    """
    distinct = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    ranges = staged(distinct.repartitionByRange(*keys).withColumn("part", F.spark_partition_id().cast("long")), f"ranges-{name}")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return ranges.select(*keys, (F.col("part") * (1 << 40) + place).alias("rank"))


def prefix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """For 1, 2, 4, ... lines up to ``longest``: row, seq and rank of each suffix whose prefix repeats."""
    level = staged(lines.join(repeated_ranks(lines, ["h1", "h2"], "1"), ["h1", "h2"]).select("__row", "seq", "rank"), "ranks-1")
    levels, h = [level], 1
    while 2 * h <= longest:
        ahead = level.select("__row", (F.col("seq") - h).alias("seq"), F.col("rank").alias("next"))
        pairs = level.join(ahead, ["__row", "seq"])
        pairs = pairs.withColumnRenamed("rank", "first")
        ranks = repeated_ranks(pairs, ["first", "next"], str(2 * h))
        level = staged(pairs.join(ranks, ["first", "next"]).select("__row", "seq", "rank"), f"ranks-{2 * h}")
        levels.append(level)
        h *= 2
    return levels


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """For each line the shortest run of enough words that starts there and the one that ends there."""
    doc = Window.partitionBy("__row")
    starts = doc.orderBy("before").rangeBetween(0, min_words - 1)
    ends = doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    placed = lines.withColumn("before", F.col("upto") - F.col("words")).select(
        "__row", "doc_id", "seq", "before", "upto", F.max("upto").over(doc).alias("all_words"),
        F.count("*").over(starts).alias("ahead"), F.count("*").over(ends).alias("back"),
    )
    forward = F.when(F.col("all_words") - F.col("before") >= min_words, F.struct(F.col("seq").alias("start"), F.col("ahead").alias("n")))
    backward = F.when(F.col("upto") >= min_words, F.struct((F.col("seq") - F.col("back") + 1).cast("int").alias("start"), F.col("back").alias("n")))
    return placed.select("__row", "doc_id", F.explode(F.array_distinct(F.array_compact(F.array(forward, backward)))).alias("r")).select("__row", "doc_id", "r.*").distinct()


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies: row, first line (by seq) and number of lines of each run that also starts earlier."""
    levels = prefix_ranks(lines, min_words)
    runs = staged(shortest_runs(lines, min_words), "runs")
    keyed: DataFrame | None = None
    for k, level in enumerate(levels):
        h = 1 << k
        mine = runs.where(F.col("n").between(h, 2 * h - 1))
        a = level.select("__row", F.col("seq").alias("start"), F.col("rank").alias("a"))
        z = level.select("__row", F.col("seq").alias("last"), F.col("rank").alias("z"))
        got = mine.withColumn("last", (F.col("start") + F.col("n") - h).cast("int")).join(a, ["__row", "start"]).join(z, ["__row", "last"])
        got = got.select("__row", "doc_id", "start", "n", "a", "z")
        keyed = got if keyed is None else keyed.unionByName(got)
    keyed = staged(keyed, "keyed-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"), F.col("start").alias("start"))
    firsts = keyed.groupBy("n", "a", "z").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    firsts = staged(firsts, "first-runs")  # a table of its own, so that the join with a very common run can be split
    return keyed.join(firsts, ["n", "a", "z"]).where((F.col("first.row") != F.col("__row")) | (F.col("first.start") != F.col("start"))).select("__row", "start", "n")


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row that loses lines: the places of these in its text, the words they held, and how many lines are left.

    A document's own lines bound the list.
    """
    lines = staged(worded_lines(docs), "lines")
    spans = repeated_runs(lines, min_words).select("__row", F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("n") - 1).cast("int"))).alias("seq")).distinct()
    marked = lines.join(spans.withColumn("hit", F.lit(True)), ["__row", "seq"], "left")
    each = marked.groupBy("__row").agg(
        F.collect_list(F.when(F.col("hit"), F.col("line_no"))).alias("__gone"), F.sum(F.when(F.col("hit"), F.col("words"))).alias("__gone_words"),
        F.count(F.when(F.col("hit").isNull(), 1)).alias("__n_left"),
    )
    return each.where(F.size("__gone") > 0)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, emptied: bool = True) -> DataFrame:
    """``docs`` with a row key and the text without later copies: ``__row``, ``__kept``, ``__n_gone``, ``__gone_words``.

    Without ``emptied``, rows that lose all their lines are left out. This is told before the text is put together: a filter
    on the text itself would make Spark compute its expression inside the filter again.
    """
    keyed = with_row_key(docs, "line-dedup")
    names = keyed.columns
    with scratch(docs.sparkSession):
        gone = staged(dropped_lines(keyed, min_words), "dropped-lines", keep=True)
    # Sorted and merged whatever the size of the list, so that the work grows with the rows alone.
    joined = keyed.join(gone.hint("merge"), "__row", "left")
    if not emptied:
        joined = joined.where(F.coalesce(F.col("__n_left"), F.lit(1)) > 0)
    both = joined.select(*keep_cols(names), F.split(filled("text"), "\n").alias("__lines"), F.coalesce("__gone", F.array().cast("array<int>")).alias("__gone"), "__gone_words")
    lines, lost = F.col("__lines"), F.col("__gone")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    kept = both.select(*keep_cols(names), lines.alias("__lines"), places.alias("__places"), F.size(lost).cast("long").alias("__n_gone"), F.coalesce("__gone_words", F.lit(0)).cast("long").alias("__gone_words"))
    text = F.when(F.col("__n_gone") == 0, F.col("text")).otherwise(F.array_join(F.transform("__places", lambda i: F.element_at("__lines", i + 1)), "\n"))
    return kept.select(*keep_cols(names), text.alias("__kept"), "__n_gone", "__gone_words")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: lines and words removed, and a digest of the text that stays."""
    out = deduplicated(docs.select("doc_id", "text"), min_words)
    return out.select(
        "doc_id", F.col("__n_gone").alias("n_removed_lines"), F.col("__gone_words").alias("n_removed_words"),
        F.length(filled("__kept")).cast("long").alias("n_chars_kept"), F.sha2(filled("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with the shortened text; those that lost lines and have no word left go. Same columns, ``n_chars`` renewed."""
    names = docs.columns
    out = deduplicated(docs, min_words, emptied=False)
    cols = []
    for c in names:
        if c == "text":
            cols.append(F.col("__kept").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("__n_gone") == 0, F.col(c)).otherwise(F.length("__kept")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
