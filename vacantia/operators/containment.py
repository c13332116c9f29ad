"""Which of many search texts occur inside which of many texts, both as tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .skew import lookup

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """Distinct stretches of ``size`` characters of a column; none if the text is shorter."""
    chars = F.split(text, "")
    count = F.greatest(F.size(chars) - (size - 1), F.lit(0))
    out = F.slice(chars, 1, count)
    for k in range(1, size):
        out = F.zip_with(out, F.slice(chars, k + 1, count), lambda a, b: F.concat(a, b))
    return F.array_distinct(out)


def contained(texts: DataFrame, needles: DataFrame, size: int = GRAM) -> DataFrame:
    """``(text, needle)`` for every needle that occurs in a text; each pair once. Both tables have one column of that name.

    An index of character stretches: a needle can only occur where its rarest stretch does, so it meets the texts that
    hold this one, and what meets is verified. Stretches are counted first (one row per stretch and task before the
    shuffle); a needle with a stretch that no text holds meets nothing. Needles shorter than ``size`` are looked up by
    shorter stretches. Comparison is exact, case included. Null and empty values on either side match nothing, repeated
    ones count once. There is no limit on how many pairs a text or a needle may have. Stretches are joined by sorting:
    the size Spark expects of them is that of the compressed files, and many times as many rows would be broadcast.
    """
    where = lambda df, c: df.toDF(c).where(F.col(c) != "").distinct()
    texts, needles = where(texts, "text"), where(needles, "needle")
    out = None
    for n in range(size, 0, -1):
        long_enough = F.length("needle") >= n if n == size else F.length("needle") == n
        mine = needles.where(long_enough).select("needle", F.explode(grams(F.col("needle"), n)).alias("gram"))
        asked = mine.select("gram").distinct()
        counts = texts.select(F.explode(grams(F.col("text"), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_texts"))
        known = lookup(mine, counts.join(asked.hint("merge"), "gram", "left_semi").hint("merge"), "gram")
        rarest = known.groupBy("needle").agg(
            F.min_by("gram", F.struct("n_texts", "gram")).alias("gram"), F.count(F.when(F.col("n_texts").isNull(), 1)).alias("absent")
        ).where("absent = 0").select("needle", "gram")
        held = texts.select("text", F.explode(grams(F.col("text"), n)).alias("gram"))
        pairs = held.join(rarest.hint("merge"), "gram").where(F.col("text").contains(F.col("needle"))).select("text", "needle")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _lowered(column: Column) -> Column:
    return F.lower(F.coalesce(column, F.lit("")))


def listed_keywords(keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """A keyword table as needles: lower case, blanks at the ends dropped, no empty ones."""
    return keywords.select(strip(F.lower(F.col(keyword))).alias("needle")).where("needle <> ''").distinct()


def titles_passing(rows: DataFrame, title: str, positive: DataFrame | None, negative: DataFrame | None) -> DataFrame:
    """Rows whose title holds a positive keyword (if a table of them is given) and no negative one.

    The same rule as ``title_passes`` with keywords as tables (one column), for lists too long for a configuration. A
    positive table without any keyword lets every title pass, as an empty list does. Titles are compared once each,
    however often they occur.
    """
    lowered = rows.withColumn("__low", _lowered(F.col(title)))
    texts = lowered.select("__low").distinct()

    def flagged(df: DataFrame, words: DataFrame, flag: str) -> DataFrame:
        hits = contained(texts, listed_keywords(words.toDF("keyword"))).select(F.col("text").alias("__low")).distinct()
        return lookup(df, hits.withColumn(flag, F.lit(True)), "__low")

    keep = F.lit(True)
    out = lowered
    if positive is not None:
        some = listed_keywords(positive.toDF("keyword")).agg((F.count(F.lit(1)) > 0).alias("some"))
        out = flagged(out, positive, "__pos").withColumn("__wanted", F.coalesce("__pos", F.lit(False)) | ~some.scalar())
        keep = F.col("__wanted")
    if negative is not None:
        out = flagged(out, negative, "__neg")
        keep = keep & F.col("__neg").isNull()
    return out.where(keep).select(*[F.col(f"`{c}`") for c in rows.columns])


def with_first_exclusion(rows: DataFrame, keywords: DataFrame, texts: list[str], tags: str | None = None, out: str = "exclusion_matched") -> DataFrame:
    """``rows`` with the first keyword of a table (pos, keyword) that occurs in any of the texts or tags, else null.

    The same rule as ``first_exclusion``; the keyword is given in its own spelling. Blank keywords match nothing, of
    keywords alike in lower case the first counts.
    """
    everything = F.array(*[_lowered(F.col(t)) for t in texts])
    if tags is not None:
        everything = F.concat(everything, F.coalesce(F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.lower(t)), F.array().cast("array<string>")))
    whole = rows.withColumn("__all", F.array_sort(F.array_distinct(everything)))
    named = keywords.select("pos", "keyword", strip(F.lower("keyword")).alias("needle")).where("needle <> ''")
    first = named.groupBy("needle").agg(F.min(F.struct("pos", "keyword")).alias("hit"))
    each = whole.select("__all").distinct().select("__all", F.explode("__all").alias("text"))
    hits = contained(each.select("text"), first.select("needle")).join(first, "needle").groupBy("text").agg(F.min("hit").alias("hit"))
    best = each.join(hits, "text").groupBy("__all").agg(F.min("hit").alias("__hit"))
    return lookup(whole, best, "__all").select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__hit.keyword").alias(out))
