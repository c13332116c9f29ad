"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix, and put together in another order.

A unit is a line with its ``\\n``, or what follows the last one. Finding the k-th line end is a select on bytes, done on
eight bytes at a time: the UTF-8 buffer of a whole Arrow batch is viewed as 64-bit words, arithmetic inside each word
leaves the top bit of every byte that is a line end, ``bitwise_count`` counts them per word, the running sum of the
counts is searched for the word that holds the k-th, and the place inside the word is found by clearing lower marks.
The same count over continuation bytes turns byte offsets into code points. Only numbers leave Python: texts are put
together by Spark's own functions.

Cuts and form are drawn from a digest of seed and id, so reruns agree. Null texts count as empty; empty texts, texts that
hold a marker, and those not drawn for a change stay as they are (form ``plain``). A null id draws like the empty
string, rows with equal ids draw equal numbers. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled

# The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

CUTS = "struct<n: bigint, prefix_chars: bigint, middle_chars: bigint>"
CHUNK_BYTES = 8 << 20  # texts are cut in groups of about so many bytes, which bounds the memory of the marks

_BYTES = 0x0101010101010101
_LOW = np.uint64(0x7F * _BYTES)
_TOP = np.uint64(0x80 * _BYTES)
_LINE_ENDS = np.uint64(0x0A * _BYTES)
_ONE = np.uint64(1)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, filled up with zero bytes; always one word more than the bytes need."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def line_end_marks(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that is a line end; exact, as no carry leaves a byte."""
    x = words ^ _LINE_ENDS
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte 10xxxxxx."""
    return words & ~(words << _ONE) & _TOP


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.count = np.bitwise_count(marks).astype(np.int64)
        self.upto = np.cumsum(self.count)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte offset."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (inside << np.uint64(3))) - _ONE
        return self.upto[word] - self.count[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th mark, counted from 1."""
        word = np.searchsorted(self.upto, k, "left")
        skip = k - (self.upto[word] - self.count[word]) - 1
        left = self.marks[word]
        for step in range(7):
            left = np.where(skip > step, left & (left - _ONE), left)
        lowest = left & (~left + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def cut(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and code points of its prefix and middle.

    ``bounds`` are the byte offsets of the texts; the two draws, taken modulo the units + 1, are the units before the
    cuts.
    """
    words = words_of(data)
    ends, inner = Marks(line_end_marks(words)), Marks(continuation_marks(words))
    start, stop = bounds[:-1], bounds[1:]
    before = ends.rank(start)
    closed = ends.rank(stop) - before
    open_end = stop > start
    open_end[open_end] = data[stop[open_end] - 1] != 10
    n = closed + open_end
    a, b = first % (n + 1), second % (n + 1)

    def place(unit: np.ndarray) -> np.ndarray:
        at = np.where(unit == 0, start, stop)
        whole = (unit > 0) & (unit <= closed)
        at[whole] = ends.select((before + unit)[whole]) + 1
        return at

    x, y = place(np.minimum(a, b)), place(np.maximum(a, b))
    chars = lambda lo, hi: hi - lo - (inner.rank(hi) - inner.rank(lo))
    return n, chars(start, x), chars(x, y)


def groups(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``limit`` bytes; a longer text is one by itself."""
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end
        at = end


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    wide = pa.types.is_large_string(texts.type)
    _, offsets, buffer = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    h1, h2 = (x.to_numpy(zero_copy_only=False) for x in (first, second))
    parts = [
        cut(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], h1[i:j], h2[i:j]) for i, j in groups(bounds, CHUNK_BYTES)
    ]
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ([], [], []))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "prefix_chars", "middle_chars"])


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, key: str = "doc_id", out: str = "fim") -> DataFrame:
    """``docs`` with a struct of units, form, code points of prefix and middle (null if plain) and the changed text.

    ``rate`` per cent of the texts are changed, ``spm_rate`` per cent of these to suffix-prefix-middle, the others to
    prefix-suffix-middle.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    text = filled("text")
    staged = docs.select(*names, F.arrow_udf(_cuts, CUTS)(text, h1, h2).alias("__cut"))
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    p, m = F.col("__cut.prefix_chars"), F.col("__cut.middle_chars")
    one = F.lit(1).cast("int")
    prefix = F.substring(text, one, p.cast("int"))
    middle = F.substring(text, (p + 1).cast("int"), m.cast("int"))
    suffix = F.substring(text, (p + m + 1).cast("int"), F.length(text))
    formed = staged.select(*names, "__cut", form.alias("__form"))
    f = F.col("__form")
    output = (
        F.when(f == "plain", text)
        .when(f == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    changed = f != "plain"
    return formed.select(
        *names,
        F.struct(
            F.col("__cut.n").alias("n"), f.alias("form"), F.when(changed, p).alias("prefix_chars"), F.when(changed, m).alias("middle_chars"), output.alias("output")
        ).alias(out),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that a changed output was made of: the parts lie between the markers, which no changed text holds."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
