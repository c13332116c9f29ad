"""WARC archives and a Merkle audit of two replicas of them.

``archived`` writes pages as WARC/1.0 response records, dealt among archives by a hash of the page id; a record's place
is its archive and its byte offset there. A tree stands over these places: records by digest, ranges of 64 KiB of an
archive, ranges 16 times as long, and so on up to the archive, then 16 archives together, up to one root. A node's
digest covers keys and digests of its children in order. ``audit`` compares the two roots and goes down only where
digests differ, down to the records, and says what is wrong with each: changed, missing or extra.

Trees are aligned by place, so a lost record spoils only its own branch. Every node has few children: ranges bound
those of an archive (a record is never shorter than its header), the fan-out all others.

Null html is an empty payload, null urls are left out of the header, null ids come last in their archive; rows equal in
every column are separate records. Empty tables have no root and no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import staged

RECORDS_PER_ARCHIVE = 512
RANGE_BITS = 16  # the smallest ranges hold 64 KiB
FAN_BITS = 4


def number_of(value: Column, n: Column | int) -> Column:
    """The first 28 bits of the MD5 of a value's text, modulo ``n``; null counts as an empty text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def record_bytes(url: Column, payload: Column) -> Column:
    """One response record: header, blank line, payload, two line ends."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\n"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def archived(pages: DataFrame, per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """``page_id, archive, offset, record``: the records of all pages in their archives."""
    n = max(1, -(-pages.count() // per_archive))
    records = pages.select("page_id", number_of(F.col("page_id"), n).alias("archive"), record_bytes(F.col("url"), F.col("html")).alias("record"))
    sized = records.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2("record", 256))
    place = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_last(), "digest")  # about ``per_archive`` records
    before = F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, -1))
    return sized.select("page_id", "archive", F.coalesce(before, F.lit(0)).alias("offset"), "record")


def leaves(records: DataFrame) -> DataFrame:
    """The lowest level of a tree: place, length and digest of each record."""
    return records.select("archive", F.col("offset").alias("at"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def _joined(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: F.concat_ws(" ", c["archive"], c["at"], c["digest"])), "\n"), 256)


def merkle_levels(records: DataFrame, name: str, archive_bits: int, offset_bits: int) -> list[DataFrame]:
    """From the records up to the root: ``archive, at, digest``, each key the parent's key with more bits."""
    low = staged(leaves(records), f"merkle-{name}-records")
    levels = [low]
    steps = [("at", RANGE_BITS)] + [("at", FAN_BITS)] * max(0, -(-(offset_bits - RANGE_BITS) // FAN_BITS)) + [("archive", FAN_BITS)] * -(-archive_bits // FAN_BITS)
    for k, (column, bits) in enumerate(steps):
        below = levels[-1].withColumn("up_archive", F.shiftright("archive", bits) if column == "archive" else F.col("archive")).withColumn("up_at", F.shiftright("at", bits) if column == "at" else F.col("at"))
        grouped = below.groupBy("up_archive", "up_at").agg(_joined(F.collect_list(F.struct("archive", "at", "digest"))).alias("digest"))
        levels.append(staged(grouped.select(F.col("up_archive").alias("archive"), F.col("up_at").alias("at"), "digest"), f"merkle-{name}-{k}"))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys whose digests differ or stand on one side only."""
    left = a.select("archive", "at", F.col("digest").alias("a"))
    right = b.select("archive", "at", F.col("digest").alias("b"))
    return left.join(right, ["archive", "at"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """``archive, offset, length, fault`` of each record of ``records`` or ``replica`` that the other has not alike.

    Both have ``archive``, ``offset`` and ``record``.
    """
    top = records.agg(F.max("archive").alias("a"), F.max("offset").alias("o")).first()
    other = replica.agg(F.max("archive").alias("a"), F.max("offset").alias("o")).first()
    archive_bits = max(top["a"] or 0, other["a"] or 0).bit_length()
    offset_bits = max(top["o"] or 0, other["o"] or 0).bit_length()
    ours, theirs = merkle_levels(records, "a", archive_bits, offset_bits), merkle_levels(replica, "b", archive_bits, offset_bits)
    found = differing(ours[-1], theirs[-1])
    n_offset = len(ours) - 1 - -(-archive_bits // FAN_BITS)
    for k in range(len(ours) - 2, -1, -1):
        bits = (RANGE_BITS if k == 0 else FAN_BITS) if k < n_offset else FAN_BITS
        parent = found.select(F.col("archive").alias("up_archive"), F.col("at").alias("up_at"))

        def below(level: DataFrame, k: int = k, bits: int = bits, parent: DataFrame = parent) -> DataFrame:
            up_archive = F.col("archive") if k < n_offset else F.shiftright("archive", bits)
            up_at = F.shiftright("at", bits) if k < n_offset else F.col("at")
            return level.join(parent, (up_archive == F.col("up_archive")) & (up_at == F.col("up_at")), "left_semi")

        found = staged(differing(below(ours[k]), below(theirs[k])), f"merkle-found-{k}")
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    lengths = ours[0].select("archive", "at", "length").unionByName(theirs[0].select("archive", "at", "length").join(ours[0].select("archive", "at"), ["archive", "at"], "left_anti"))
    return found.join(lengths, ["archive", "at"]).select("archive", F.col("at").alias("offset"), "length", fault.alias("fault"))


def second_copy(records: DataFrame) -> DataFrame:
    """A replica with the faults that storage makes: of 100 records by hash, one with a wrong byte, one cut short, one lost."""
    kind = number_of(F.concat(F.lit("fault "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 100)
    n = F.octet_length("record")
    wrong = F.concat(F.substring("record", 1, n - 5), F.lit(b"\x00"), F.substring("record", n - 3, F.lit(4)))
    short = F.substring("record", 1, n - 7)
    damaged = F.when(kind == 0, wrong).when(kind == 1, short).otherwise(F.col("record"))
    return records.where(kind != 2).withColumn("record", damaged)


def replica_faults(pages: DataFrame) -> DataFrame:
    """Audit of the archives of ``pages`` against their second copy, with the page of each record."""
    records = archived(pages.select("page_id", "url", "html"))
    found = audit(records, second_copy(records))
    named = records.select("page_id", "archive", "offset")
    return found.join(named, ["archive", "offset"], "left").select("page_id", "archive", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), "fault")
