"""Exact substring dedup: per-shard suffix arrays, merged across shards.

The rule: of the UTF-8 bytes of all texts, a byte goes if it lies in a string of ``LENGTH`` bytes that also starts
earlier (smaller ``doc_id``, null last, then text digest; or earlier in the document). Strings are judged on the input.

1. Equal texts are one class; only its first document is looked into, every byte of the others lies in a copy.
2. Class texts are packed, as the join delivers them, into shards of about ``SHARD_BYTES``. Shards are kept in buckets and
   not moved again: what is found for them is dealt to the buckets.
3. Every string of ``LENGTH`` bytes has an anchor: the least hash of ``GRAM`` bytes inside it. Equal strings have equal
   anchors, so only strings whose anchor occurs twice need a closer look. Shards send each distinct anchor hash once.
4. In each shard, a suffix array over the stretches left is built by Larsson-Sadakane refinement (ranks of 8 bytes, then
   16, 32, ..., sorting only what is not yet told apart), and common prefixes by Kasai's rule, many stretches abreast.
   Neighbours that share ``LENGTH`` bytes are one string: all but its first place go.
5. First places whose anchor also occurs in another shard are sent, as pieces of text, to the task of that anchor. There
   every shard brings its sorted strings, known by 128-bit prints, and binary search finds in which it starts first.

A shard sends a string once, however often it holds it, so a passage in a third of all texts is one row per shard.
Nothing is capped; a text longer than a shard is a shard of its own. Null texts are empty; rows equal in id and text
count as copies of each other; texts shorter than ``LENGTH`` lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import filled, scratch, staged, staged_in_buckets

LENGTH = 100
DEPTH = 128  # the first of 8, 16, 32, ... not below LENGTH
GRAM = 32
SHARD_BYTES = 2 << 20
SHARDS_PER_BUCKET = 4
MAX_BUCKETS = 1 << 14  # of the table of shards; beyond, a bucket holds more of them
ANCHORS_PER_BUCKET = 1 << 18

_U = np.uint64
_P = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _P[0])
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(k: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((k, inverse))
    if have is None or len(have) < n:
        base = pow(int(_P[k]), -1, 1 << 64) if inverse else int(_P[k])
        have = np.full(n, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[k, inverse] = have
    return have[:n]


def window_prints(data: np.ndarray, width: int, k: int = 0) -> np.ndarray:
    """A 64-bit print of each ``width`` bytes, by one running polynomial sum."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(k, False, len(data)), out=total[1:])
    return _mix((total[width:] - total[:-width]) * _powers(k, True, len(data) - width + 1))


def valid_starts(n: int, ends: np.ndarray) -> np.ndarray:
    """Whether a whole string of LENGTH bytes begins here, inside one of the stretches that end at ``ends``."""
    ok = np.ones(n, bool)
    for e in ends:
        ok[max(0, e - LENGTH + 1) : e] = False
    if len(ends) > 1:
        begins = np.concatenate([[0], ends[:-1]])
        short = ends - begins < LENGTH
        for a, b in zip(begins[short], ends[short], strict=True):
            ok[a:b] = False
    return ok


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of strings, the place of the anchor of each, and hashes by place."""
    grams = window_prints(data, GRAM)
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), grams
    bits = _U(max(1, int(len(data)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    window = LENGTH - GRAM + 1
    k, m = 1, low
    while 2 * k <= window:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if window > k:
        m = np.minimum(m[: len(m) - (window - k)], m[window - k :])
    starts = np.flatnonzero(valid_starts(len(data), ends)[: len(m)])
    return starts, (m[starts] & ((_U(1) << bits) - _U(1))).astype(np.int64), grams


def anchor_places(at: np.ndarray) -> np.ndarray:
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that sorts like the bytes; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more (ties in order of place)."""
    n = len(data)
    key = words8(data)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    h = 8
    while True:
        # Each suffix's rank is where its group begins; only groups of several are sorted further.
        groups = np.flatnonzero(head)
        begin = np.repeat(groups, np.diff(np.append(groups, n)))
        if h >= depth or len(groups) == n:
            return sa
        rank = np.empty(n + 1, np.int64)
        rank[sa] = begin + 1
        rank[n] = 0
        single = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~single)
        at = sa[open_]
        ahead = rank[np.minimum(at + h, n)]
        order = np.argsort((begin[open_].astype(np.uint64) << _U(32)) | ahead.astype(np.uint64), kind="stable")
        sa[open_] = at[order]
        ahead, own = ahead[order], begin[open_]
        head[open_] = np.concatenate([[True], (ahead[1:] != ahead[:-1]) | (own[1:] != own[:-1])])
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """For each place the bytes (up to ``cap``) shared with the suffix before it in ``sa``, sorted by ``cap`` bytes.

    Kasai's rule, from one place to the next at most one byte less, is followed in many stretches at once. It holds as
    long as the next places of both suffixes are in the same order; of suffixes that share ``cap`` bytes, which are in
    order of place, this is not given and looked up.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    order = np.empty(n + 1, np.int64)
    order[sa] = np.arange(n)
    order[n] = n
    key = words8(data)
    key = np.concatenate([key, np.zeros(cap + 8, np.uint64)])
    step = max(1, -(-n // lanes))
    place = np.arange(0, n, step)
    out = np.zeros(n, np.int16)
    h, q = np.zeros(len(place), np.int64), np.full(len(place), -1)
    for k in range(step):
        p = place + k
        if p[-1] >= n:
            some = int((p < n).sum())
            p, h, q = p[:some], h[:some], q[:some]
        turned = (h >= cap) & (order[q + 1] > order[p])
        h = np.where(turned, 0, np.maximum(h - 1, 0))
        q = before[p]
        h[q < 0] = 0
        live = np.flatnonzero(q >= 0)
        while len(live):
            x = key[p[live] + h[live]] ^ key[q[live] + h[live]]
            same = x == 0
            part = live[~same]
            if len(part):
                # Whole bytes before the first difference.
                y = x[~same]
                lead = np.zeros(len(y), np.int64)
                for s in (32, 16, 8):
                    top = y >> _U(64 - s) == 0
                    lead += np.where(top, s // 8, 0)
                    y = np.where(top, y << _U(s), y)
                h[part] += lead
            live = live[same]
            h[live] += 8
            live = live[h[live] < cap]
        np.minimum(h, cap, out=h)
        # A prefix can't reach behind the end of the data.
        np.minimum(h, n - np.maximum(p, q), out=h)
        out[p] = h
    return out


def repeated_starts(data: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Of the starts marked in ``ok``, those whose LENGTH bytes also start at an earlier marked place."""
    sa = suffix_array(data, DEPTH)
    shared = common_prefixes(data, sa, DEPTH)
    cuts = shared[sa] < LENGTH
    group = np.cumsum(cuts)
    marked = ok[sa]
    places, group = sa[marked], group[marked]
    if not len(places):
        return np.zeros(len(data), bool)
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    first = np.repeat(np.minimum.reduceat(places, begins), np.diff(np.append(begins, len(group))))
    out = np.zeros(len(data), bool)
    out[places] = places != first
    return out


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# --- Spark steps ---------------------------------------------------------------------------------------------------

SHARD = "shard long, ords array<long>, sizes array<int>, data binary"


def _pack(shard_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0
        # Partition and number in it: no two shards have the same id, whatever they hold.
        number = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([[o for o, _ in held]], pa.list_(pa.int64())), pa.array([[len(t) for _, t in held]], pa.list_(pa.int32())), pa.array([b"".join(t for _, t in held)], pa.binary())],
                ["shard", "ords", "sizes", "data"],
            )

        for batch in batches:
            for ord_, text in zip(batch.column("ord"), batch.column("bytes"), strict=True):
                t = text.as_py()
                if held and size + len(t) > shard_bytes:
                    yield out()
                    number += 1
                    held, size = [], 0
                held.append((ord_.as_py(), t))
                size += len(t)
        if held:
            yield out()

    return pack


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for r in range(batch.num_rows):
            yield {c: batch.column(i)[r] for i, c in enumerate(names)}


def _open(row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(row["data"].as_buffer() if row["data"].as_buffer() is not None else b"", np.uint8)
    return row["shard"].as_py(), np.asarray(row["ords"].values), np.cumsum(np.asarray(row["sizes"].values, np.int64)), data


def _send_anchors(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for row in _rows(batches):
                shard, _, ends, data = _open(row)
                _, at, grams = anchors(data, ends)
                found = np.unique(grams[anchor_places(at)])
                to = found % _U(buckets)
                order = np.argsort(to, kind="stable")
                found, to = found[order], to[order]
                begins = np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1))
                cuts = np.append(begins, len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[begins].astype(np.int64)), pa.array(np.full(len(begins), shard)), pa.array([found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    ["bucket", "shard", "hashes"],
                )

    return send


def _meet(batch: pa.Table) -> pa.Table:
    """Of one bucket: per shard the hashes that another shard has too."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    shards, out = [], []
    for shard, own in zip(batch.column("shard").to_pylist(), parts, strict=True):
        if len(twice):
            k = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            own = own[twice[k] == own]
            if len(own):
                shards.append(shard)
                out.append(own.tobytes())
    return pa.table({"shard": pa.array(shards, pa.int64()), "hashes": pa.array(out, pa.binary())})


LOCAL = "shard long, gone array<struct<a:int,b:int>>, bucket long, ords array<long>, offs array<int>, places array<int>, lens array<int>, text binary"
_LOCAL_ARROW = pa.schema([
    ("shard", pa.int64()), ("gone", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("bucket", pa.int64()), ("ords", pa.list_(pa.int64())),
    ("offs", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("text", pa.binary()),
])


def _spans(a: np.ndarray, b: np.ndarray) -> list[dict]:
    return [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]


def look_into(shard: int, ords: np.ndarray, ends: np.ndarray, data: np.ndarray, elsewhere: np.ndarray, buckets: int) -> list[dict]:
    """Rows of one shard: the bytes that go for a reason inside it, and by bucket the pieces to compare with others."""
    starts, at, grams = anchors(data, ends)
    out: list[dict] = []
    if not len(starts):
        return out
    new = np.diff(at, prepend=-1) != 0
    place = at[new]
    own = grams[place]
    unique, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    far = np.isin(unique, elsewhere, assume_unique=False)
    of = np.cumsum(new) - 1  # anchor number by start
    far_start = far[inverse][of]
    suspect = far_start | (counts > 1)[inverse][of]
    again = np.zeros(len(data), bool)
    if suspect.any():
        # The stretches that suspect strings cover, one behind the other.
        delta = np.zeros(len(data) + 1, np.int64)
        np.add.at(delta, starts[suspect], 1)
        np.add.at(delta, starts[suspect] + LENGTH, -1)
        cover = np.cumsum(delta[:-1]) > 0
        kept = np.flatnonzero(cover)
        ok = np.zeros(len(data), bool)
        ok[starts[suspect]] = True
        again[kept] = repeated_starts(data[kept], ok[kept])
        a, b = runs(again)
        covered = np.zeros(len(data) + 1, np.int64)
        np.add.at(covered, a, 1)
        np.add.at(covered, b - 1 + LENGTH, -1)
        out.append({"shard": shard, "gone": _spans(*runs(np.cumsum(covered[:-1]) > 0)), "bucket": None, "ords": None, "offs": None, "places": None, "lens": None, "text": None})
    send = far_start & ~again[starts]
    if send.any():
        anchor = of[send]
        s = starts[send]
        begin = np.flatnonzero(np.diff(anchor, prepend=-1))
        first, last = s[begin], s[np.append(begin[1:], len(s)) - 1]
        bucket = (own[anchor[begin]] % _U(buckets)).astype(np.int64)
        doc = np.searchsorted(ends, first, side="right")
        off = first - np.concatenate([[0], ends[:-1]])[doc]
        size = last - first + LENGTH
        for k in np.unique(bucket):
            mine = np.flatnonzero(bucket == k)
            text = b"".join(data[first[i] : first[i] + size[i]].tobytes() for i in mine)
            out.append({"shard": shard, "gone": None, "bucket": int(k), "ords": ords[doc[mine]].tolist(), "offs": off[mine].tolist(), "places": first[mine].tolist(), "lens": size[mine].tolist(), "text": text})
    return out


def _local(buckets: int):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for row in _rows(batches):
                shard, ords, ends, data = _open(row)
                lists = row["elsewhere"].as_py() or []
                elsewhere = np.concatenate([np.frombuffer(x, np.uint64) for x in lists]) if lists else np.empty(0, np.uint64)
                made = look_into(shard, ords, ends, data, elsewhere, buckets)
                if made:
                    yield pa.RecordBatch.from_pylist(made, _LOCAL_ARROW)

    return local


def merge_pieces(pieces: list[dict]) -> list[tuple[int, list[dict]]]:
    """Of one bucket: by shard, the bytes whose string starts earlier in another shard.

    Each shard's strings are sorted by print; binary search in the sorted strings of all finds the first place of each.
    """
    number = {o: k for k, o in enumerate(sorted({o for piece in pieces for o in piece["ords"]}))}
    shards = []
    for piece in pieces:
        data = np.frombuffer(piece["text"], np.uint8)
        lens = np.asarray(piece["lens"], np.int64)
        n = lens - LENGTH + 1
        which = np.repeat(np.arange(len(lens)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(lens) - lens)[which] + inside
        a, b = window_prints(data, LENGTH, 0)[at], window_prints(data, LENGTH, 1)[at]
        # The order of all starts as one number: document, then offset.
        start = (np.array([number[o] for o in piece["ords"]], np.int64)[which] << 32) + np.asarray(piece["offs"], np.int64)[which] + inside
        order = np.argsort(a)
        shards.append((a[order], b[order], start[order], (np.asarray(piece["places"], np.int64)[which] + inside)[order]))
    a, b, start = (np.concatenate([s[k] for s in shards]) for k in range(3))
    order = np.argsort(a)
    a, b, start = a[order], b[order], start[order]
    begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    if (b != np.repeat(b[begins], np.diff(np.append(begins, len(b))))).any():
        order = np.lexsort((b, a))  # equal halves of different prints: hardly ever
        a, b, start = a[order], b[order], start[order]
        begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    first = np.minimum.reduceat(start, begins)
    a, b = a[begins], b[begins]
    out = []
    for k, (own_a, own_b, own, place) in enumerate(shards):
        at = np.searchsorted(a, own_a)
        while len(wrong := np.flatnonzero(b[at] != own_b)):
            at[wrong] += 1
        places = np.sort(place[first[at] != own])
        if len(places):
            cut = np.flatnonzero(np.diff(places, prepend=-LENGTH * 2) > 1)
            ends = places[np.append(cut[1:], len(places)) - 1] + LENGTH
            out.append((k, _spans(places[cut], ends)))
    return out


def _merge(batch: pa.Table) -> pa.Table:
    with np.errstate(over="ignore"):
        rows = batch.to_pylist()
        found = merge_pieces(rows)
    return pa.table({"shard": pa.array([rows[k]["shard"] for k, _ in found], pa.int64()), "gone": pa.array([g for _, g in found], _LOCAL_ARROW.field("gone").type)})


RESULT = "ord long, n_removed long, n_spans long, kept_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        _, ords, ends, data = _open(row)
        gone = np.zeros(len(data) + 1, np.int64)
        for spans in row["spans"].as_py() or []:
            if spans:
                np.add.at(gone, [x["a"] for x in spans], 1)
                np.add.at(gone, [x["b"] for x in spans], -1)
        mark = np.cumsum(gone[:-1]) > 0
        begins = np.concatenate([[0], ends[:-1]])
        n_removed, n_spans, digests = [], [], []
        for a, b in zip(begins, ends, strict=True):
            m = mark[a:b]
            n_removed.append(int(m.sum()))
            n_spans.append(len(runs(m)[0]))
            digests.append(hashlib.sha256(data[a:b][~m].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], ["ord", "n_removed", "n_spans", "kept_sha256"])


def class_order(rows: DataFrame) -> DataFrame:
    """``digest, doc_id, n_bytes, ord`` of each distinct text: its first document and its place in the order of all."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    classes = rows.groupBy("digest").agg(F.min(place).alias("p"), F.first("n_bytes").alias("n_bytes")).select("digest", "p.none", "p.doc_id", "n_bytes")
    ranges = staged(classes.repartitionByRange("none", "doc_id", "digest").withColumn("part", F.spark_partition_id().cast("long")), "text-classes")
    order = F.row_number().over(Window.partitionBy("part").orderBy("none", "doc_id", "digest"))
    return staged(ranges.select("digest", "doc_id", "n_bytes", (F.col("part") * (1 << 36) + order).alias("ord")), "text-order", keep=True)


def substring_dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: its bytes, those removed, their maximal runs, and a digest of what stays."""
    with scratch(docs.sparkSession):
        return _dedup(docs, shard_bytes)


def _dedup(docs: DataFrame, shard_bytes: int) -> DataFrame:
    bytes_: Column = filled("text").cast("binary")
    hashed = docs.select("doc_id", bytes_.alias("bytes")).withColumn("digest", F.unhex(F.sha2("bytes", 256)))
    rows = staged(hashed.groupBy("doc_id", "digest").agg(F.first(F.octet_length("bytes")).cast("long").alias("n_bytes"), F.count("*").alias("copies")), "text-digests", keep=True)
    order = class_order(rows)
    # Rows equal in id and text are made one before they are shuffled; the join then finds them by the same columns.
    same = ["digest", F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")]
    long_ = order.where(F.col("n_bytes") >= LENGTH).select(*same, "ord")
    once = hashed.where(F.octet_length("bytes") >= LENGTH).select(*same, "bytes").groupBy("digest", "no_id", "id").agg(F.first("bytes").alias("bytes"))
    texts = once.join(long_, ["digest", "no_id", "id"]).select("ord", "bytes")
    total = order.where(F.col("n_bytes") >= LENGTH).agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    kept_in = int(min(MAX_BUCKETS, 1 + total // (shard_bytes * SHARDS_PER_BUCKET)))
    shards = staged_in_buckets(texts.mapInArrow(_pack(shard_bytes), SHARD), "text-shards", "shard", kept_in)
    buckets = int(max(32, total // (LENGTH - GRAM) * 2 // ANCHORS_PER_BUCKET))

    sent = shards.mapInArrow(_send_anchors(buckets), "bucket long, shard long, hashes binary")
    shared = sent.groupBy("bucket").applyInArrow(_meet, "shard long, hashes binary")
    elsewhere = shared.repartition(kept_in, "shard").groupBy("shard").agg(F.collect_list("hashes").alias("elsewhere"))
    looked = staged(shards.join(elsewhere, "shard", "left").mapInArrow(_local(buckets), LOCAL), "text-repeats")
    pieces = looked.where("bucket is not null").select("bucket", "shard", "ords", "offs", "places", "lens", "text")
    across = pieces.groupBy("bucket").applyInArrow(_merge, "shard long, gone array<struct<a:int,b:int>>")
    spans = looked.where("gone is not null").select("shard", "gone").unionByName(across)
    gone = spans.repartition(kept_in, "shard").groupBy("shard").agg(F.collect_list("gone").alias("spans"))
    found = staged(shards.join(gone, "shard", "left").mapInArrow(_finish, RESULT), "text-kept", keep=True)

    named = order.join(found, "ord", "left").select(F.col("digest").alias("d"), F.col("doc_id").alias("first_id"), "n_removed", "n_spans", "kept_sha256")
    each = rows.join(named, F.col("digest") == F.col("d")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)
    short = F.col("n_bytes") < LENGTH
    return each.select(
        "doc_id", "n_bytes",
        F.when(short, 0).when(first, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(short, 0).when(first, F.col("n_spans")).otherwise(1).cast("long").alias("n_spans"),
        F.when(short, F.lower(F.hex("digest"))).when(first, F.col("kept_sha256")).otherwise(F.sha2(F.lit(b""), 256)).alias("kept_sha256"),
    )
