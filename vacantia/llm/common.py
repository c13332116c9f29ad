"""What the text operators share: word columns, byte tables, staged tables and row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACES = " \t\n\x0b\x0c\r"  # the six separators of a plain word, U+0020 and U+0009 to U+000D
SPACE_RUN = r"[ \t-\r]+"

# One byte to one byte: A-Z to a-z, every other ASCII character but digits and letters to a space. Bytes of
# longer UTF-8 sequences stay, so that offsets in the folded text are offsets in the text itself.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage; ``sql`` is left out where no plain SQL states the result."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def plain_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def folded(text: str | None) -> bytes:
    """The UTF-8 bytes with A-Z lowered and a space for each separator: same length as the text's bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


_OPEN: list[list[tuple[str, str | None]]] = []  # folders, and the names of those that are tables of the catalog


def staged(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """Write to the cluster's shared folder and read again: a fixed point that survives lost executors.

    Inside ``scratch`` the table goes when that ends, unless it is kept.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append((path, None))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_in_buckets(df: DataFrame, purpose: str, by: str, buckets: int) -> DataFrame:
    """The same in buckets of a column, as a table of the session's catalog: what is joined on the column comes to it.

    Rows are written where they are made, a file per bucket a task has rows of.
    """
    path, name = shared_dir(df.sparkSession, purpose), f"{purpose.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
    if _OPEN:
        _OPEN[-1].append((path, name))
    return df.sparkSession.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside once the results that stay have been written with ``keep``."""
    made: list[tuple[str, str | None]] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for p, name in made:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(hadoop).delete(path, True)


def with_row_key(df: DataFrame, purpose: str, key: str = "__row") -> DataFrame:
    """A unique number per row, fixed by writing the table once; repeated and null ids are told apart by it."""
    return staged(df.withColumn(key, F.monotonically_increasing_id()), purpose, keep=True)
