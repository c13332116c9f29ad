"""Periodic runs, byte-pair encoding and fill-in-middle: against brute force, the tokenizer's own library, and round trips."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import documents, empty, frame, odd, sentence
from tokenizers import Tokenizer

from vacantia.llm import bpe, middle, periodic
from vacantia.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(words):
    """Every lag over the whole sequence; a stretch counts with its smallest lag."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def brute_planted(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(words):
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {k for a, b, q in runs for k in range(a + q, b)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *shown, digest("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)))


@pytest.mark.parametrize("kinds", [1, 2, 3, 6, 25])
def test_runs_equal_all_lags(kinds):
    rng = random.Random(kinds)
    for _ in range(120):
        words = [str(rng.randrange(kinds)) for _ in range(rng.randrange(0, 220))]
        if words and rng.random() < 0.7:
            a = rng.randrange(len(words))
            p = rng.randrange(1, (len(words) - a) // 2 + 2)
            words[a:] = [words[a + (i - a) % p] for i in range(a, len(words))]
        assert [tuple(map(int, r)) for r in periodic.runs_of(words)] == sorted(brute_runs(words), key=lambda r: (r[0], r[2]))


def test_runs_of_long_sequences_take_little_time():
    n = 150_000
    assert periodic.runs_of(["a"] * n).tolist() == [[0, n, 1]]
    assert periodic.runs_of(["a", "b"] * (n // 2)).tolist() == [[0, n, 2]]
    block = [str(k) for k in range(n // 3)]
    assert periodic.runs_of(["x"] + block * 3 + ["y"]).tolist() == [[1, 1 + 3 * len(block), len(block)]]
    a, b = ["a"], ["a", "b"]
    while len(b) < 4000:
        a, b = b, b + a
    assert len(periodic.runs_of(b)) == len(brute_runs(b)) > 100


def test_splitting_goes_on_until_nothing_changes():
    # 7 occurs once; only after it has split the words, 2 and 1 occur once in what is left.
    ids = np.array([1, 2, 7, 2, *([5] * 12), 1])
    assert [(int(a), int(b)) for a, b in periodic.surviving(ids)] == [(4, 16)]
    assert periodic.surviving(np.array([], np.int64)) == []


def test_runs_of_texts(spark):
    rng = random.Random(3)
    refrain = sentence(rng, 9, 1000)
    extra = [(900 + k, t, "en", "s", 0) for k, t in enumerate((" ".join([refrain] * 3), "na " * 13, "na " * 11, " ".join([refrain, "x", refrain]), "\t".join(["é ü"] * 8)))]
    docs = odd(spark).select("doc_id", "text", "n_words", "kept", "key").unionByName(frame(spark, extra).select("doc_id", "text", *[F.lit(0).alias(c) for c in ("n_words", "kept", "key")]))
    rows = docs.collect()
    out = periodic.with_runs(docs)
    assert out.columns == [*docs.columns, "periodic"]
    got = sorted(((r.doc_id, r.text, tuple((x.start, x.start + x.length, x.period) for x in r.periodic.runs), r.periodic.collapsed) for r in out.collect()), key=repr)
    want = []
    for r in rows:
        words = WORD.findall(r.text or "")
        runs = sorted(brute_runs(words), key=lambda x: (x[0], x[2]))
        gone = {k for a, b, q in runs for k in range(a + q, b)}
        want.append((r.doc_id, r.text, tuple(runs), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert any(len(x[2]) for x in got)
    assert periodic.with_runs(empty(spark)).count() == 0


def test_planted_runs_query(spark, sf, tmp_path):
    rows = [(i, sentence(random.Random(i), 20 + i, 300), "", "", 0) for i in range(90)] + [(None, "a b " * 9, "", "", 0), (3, None, "", "", 0), (3, "", "", "", 0)]
    chosen = [i for i in range(300, 500) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, t, "", "", 0) for i, t in zip(chosen, (None, "", " \n", "one", "a b", "x " * 40), strict=False)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((r[0], *brute_digest(brute_planted(r[0], r[1]))) for r in rows), key=repr)
    whole = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(whole)
    for r in whole:
        if len(r.text or "") < 6000:
            assert got[r.doc_id] == brute_digest(brute_planted(r.doc_id, r.text))


# --- byte-pair encoding --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.PrefixBpe(f.read())


ODD_TEXTS = [
    "", " \n\t", "Don't we'll I'VE", "ΑΣ ΟΔΟΣ σς İstanbul ẞ ǅ", "é Å ﬁ ﷺ", "日本語のテキスト、中文 한국어", "👩‍👩‍👧 🇩🇪 \U0001f9d1🏽", "1234567 ½ Ⅷ ٣",
    "<|endoftext|>a<|startoftext|><|ENDOFTEXT|> <|endoftext|", "</w> <w> ##x", "a" * 3000, "ab" * 2500 + "!" * 2500, "\x00\x01\x7f​﻿­", "naïve café x", "ẛ̣ क़",
    "aaa'sss'tt ''s 'S", "=" * 77 + "-" * 1000, "Σ" * 9, "ꙮ" * 50, "\U00010ffff ",
]


def test_ids_equal_the_library(library, encoder):
    rng = random.Random(5)
    texts = list(ODD_TEXTS)
    letters = "etaoinshrdlu" + "ETAOIN" + " '.,-!?" + "äßéœЖあ1٣\n"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x11000), rng.randrange(0x1F300, 0x1FB00)))) for _ in range(60)) for _ in range(200)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_every_token_and_joined_tokens(library, encoder):
    """Each token's own letters, and letters of two tokens side by side, where joins across the border show."""
    rng = random.Random(6)
    plain = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha()]
    for text in [*plain, *(rng.choice(plain) + rng.choice(plain) for _ in range(20_000))]:
        assert list(encoder.encode_piece(text.lower())) == library.encode(text, add_special_tokens=False).ids, text


def test_each_prefix_has_one_last_token(encoder):
    """Of the tokens that end a prefix, exactly one is compatible with what comes before it."""
    rng = random.Random(7)
    for _ in range(200):
        word = "".join(rng.choice("etainsrhl") for _ in range(12))
        last = {0: None}
        for end in range(1, 13):
            fits = [(e - n + 1, i) for e, (n, i) in encoder.suffixes.iter(word[:end]) if e + 1 == end]
            good = [i for begin, i in fits if begin == 0 or encoder.compatible(last[begin], i)]
            assert len(good) == 1
            last[end] = good[0]


def test_codec_on_odd_rows(spark, library):
    codec = bpe.Codec(spark, VOCABULARY)
    extra = frame(spark, [(800 + k, t, None, None, None) for k, t in enumerate(ODD_TEXTS) if "\x00" not in t])
    docs = odd(spark).select("doc_id", "text", "found", "key").unionByName(extra.select("doc_id", "text", F.lit(1).alias("found"), F.lit(2).alias("key")))
    out = docs.withColumn("ids", codec.encode("text")).withColumn("back", codec.decode("ids")).withColumn("packed", bpe.packed("ids")).withColumn("trip", codec.round_trip("text"))
    assert out.columns[:4] == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.back == library.decode(ids, skip_special_tokens=False)
        assert bytes(r.packed) == bytes(r.trip.packed) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.trip.n_tokens == len(ids) and r.trip.decoded == r.back
    assert empty(spark).select(codec.decode(codec.encode("text"))).collect() == []
    assert spark.range(1).select(codec.decode(F.lit(None).cast("array<int>")).alias("x")).first().x == ""


def test_other_models_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="decoder"):
        bpe.PrefixBpe(f.read())


def test_bpe_query(spark, sf, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


# --- fill-in-middle ------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_marks_in_words():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([10, 9, 11, 0x8A, 0x0A ^ 0x80, 0, 255, 0x80, 0xBF, 0xC3], np.uint8), size)
        words = middle.words_of(data)
        for marks, wanted in ((middle.line_end_marks(words), data == 10), (middle.continuation_marks(words), (data & 0xC0) == 0x80)):
            m = middle.Marks(marks)
            places = np.flatnonzero(wanted)
            assert m.rank(np.arange(size + 1)).tolist() == np.concatenate(([0], np.cumsum(wanted))).tolist()
            assert m.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_fim_equals_lists_of_lines(spark, monkeypatch, rate, spm):
    rng = random.Random(2)
    odd_texts = ["\n", "\n\n\n", "a\n", "a", "\nä", "日\n本\r\n語", "x<P>y\nz", "<S", "<\nP>", "<S>", "no <M", "\U0001f600\n" * 30, "a\x00\n\x85b c\n"]
    odd_texts += ["".join(rng.choice("a\né日\U0001f600 ") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    odd_texts.append("line of ä\n" * 200_000)
    rows = [(i, t, "", "", 0) for i, t in enumerate(odd_texts)] + [(None, "a\nb\nc", "", "", 0)] * 2 + [(3, None, "", "", 0), (4, "", "", "", 0)]
    docs = frame(spark, rows).select("*", F.lit(1).alias("fim_n"), F.lit("z").alias("form"), F.lit(2).alias("n"), F.lit(3).alias("output")).repartition(3)
    out = middle.fill_in_middle(docs, rate=rate, spm_rate=spm)
    assert out.columns == [*docs.columns, "fim"]
    checked = out.withColumn("back", middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(checked) == len(rows)
    for r in checked:
        assert tuple(r.fim) == brute_fim(r.doc_id, r.text, 7, rate, spm)
        assert r.back == (r.text or "")
    assert middle.fill_in_middle(empty(spark)).count() == 0


def test_cut_in_groups_of_texts():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("a\né"), rng.integers(0, 30))) for _ in range(80)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    h = rng.integers(0, 1 << 32, (2, 80))
    whole = middle.cut(data, bounds, *h)
    for limit in (1, 20, 10_000):
        parts = [middle.cut(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], h[0][i:j], h[1][i:j]) for i, j in middle.groups(bounds, limit)]
        assert all((np.concatenate(x) == w).all() for x, w in zip(zip(*parts, strict=True), whole, strict=True))


def test_documents_with_shared_fixture(spark):
    assert all(tuple(r.fim) == brute_fim(r.doc_id, r.text) for r in middle.fill_in_middle(documents(spark)).collect())
