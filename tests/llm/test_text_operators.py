"""The operators for training text on small fixtures, against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, graph, html, licenses, lines, mixing, near, quality, suffix, toxicity, warc
from vacantia.llm.common import FOLD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def texts(seed=1):
    """Nulls, empties, a very long text, exact and near copies, shared lines and passages."""
    rng = random.Random(seed)
    base = sentence(rng, 300)
    passage = sentence(rng, 60)
    line = sentence(rng, 25)
    out = [None, "", "   \n\t\n ", "one", "Zwei WÖRTER", base, base, base + "\n" + line, line + "\nmore of it\n" + line]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"x{rng.random()}"
        out.append(" ".join(w))
    for _ in range(6):
        out.append(sentence(rng, rng.randrange(20, 90)) + " " + passage + "\n" + sentence(rng, 30) + "\n" + line)
    out.append(sentence(rng, 4000, 30) + "\n" + "\n".join(sentence(rng, 6, 5) for _ in range(300)))
    out.append("ab" * 400 + "\x00tail " * 30)
    return out


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(spark, seed=1):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts(seed))]
    return frame(spark, rows)


def odd(spark):
    """Null and repeated ids, whole rows twice, and extra columns named like the operators' own."""
    base = documents(spark).collect()
    rows = [tuple(r) for r in base] + [tuple(base[5]), (None, base[6].text, None, None, None), (None, None, None, None, None), (5, "other text " * 30, "de", "q", 1)]
    extra = ["found", "stats", "digest", "n_words", "kept", "key", "bound", "rule", "shard", "mix_order"]
    return frame(spark, rows).select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])


def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(9)
    items = [(k, sentence(rng, n)) for k, n in enumerate((3, 10, 11, 40, 12))] + [(7, None), (8, "  "), (None, "null id words"), (1, sentence(rng, 14))]
    return frame(spark, items, "item_id long, text string")


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_learns_stems_and_scores_all(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = sentence(rng, 60).split()
        if bad:
            words.insert(rng.randrange(60), f"grumo{''.join(rng.choice('aeiklnt') for _ in range(4))}")
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 4:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, "idiot " * 3, "en", "s", 0), (3, "again", "x", "y", 1)]
    labels += [(7, 1, 1), (7, 1, 0), (None, 1, 1), (9, 1, None), (99999, 1, 1)]
    docs, given = frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, given).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    again = toxicity.toxicity(docs, given).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_toxicity_without_labels_and_without_documents(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, [(1, "you idiot", "", "", 0), (2, "fine day", "", "", 0)]), none).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    flip = lambda p: np.where(rng.random(4000) < p, ~y, y).astype(np.int8)
    copy = flip(0.4)
    post = toxicity.label_model(np.stack([flip(0.1), flip(0.15), copy, copy, copy, np.full(4000, -1, np.int8)], axis=1))
    assert ((post > 0.5) == y).mean() > 0.85


def test_label_model_learns_from_rows_without_a_label():
    """Rows without gold are decided by the voters, better with gold on the other rows than with none at all."""
    rng = np.random.default_rng(1)
    n = 6000
    y = rng.random(n) < 0.3
    flip = lambda p: np.where(rng.random(n) < p, ~y, y).astype(np.int8)
    voters = [flip(0.15), flip(0.2), flip(0.25), flip(0.45)]
    free = np.arange(n) % 2 == 0
    gold = np.where(free, -1, y).astype(np.int8)
    right = lambda g: (((toxicity.label_model(np.stack([*voters, g], axis=1))) > 0.5) == y)
    half, full, none = right(gold), right(y.astype(np.int8)), right(np.full(n, -1, np.int8))
    assert full.mean() > 0.97 and half[~free].mean() > 0.97
    best_single = max((v == y)[free].mean() for v in voters)
    assert half[free].mean() > best_single - 0.01 and half[free].mean() >= none[free].mean() - 0.01


def test_unlabelled_documents_teach_the_classifier(spark):
    """A word that only stands in unlabelled documents, next to known abuse, gets a weight."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = sentence(rng, 30).split() + (["idiot", "moron"] if bad else [])
        if i >= 300 and bad:
            words.append("you are stupid")
        rows.append((i, " ".join(words), "", "", 0))
        if i < 300:
            labels.append((i, 1, int(bad)))
    docs, given = frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")
    free = toxicity.unlabelled_of(docs, given, 10_000).collect()
    assert {r.doc_id for r in free} == {i for i in range(300, 900) if zlib.crc32(str(i).encode()) % 5}
    assert 0 < toxicity.unlabelled_of(docs, given, 100).count() < 200
    with_free = toxicity.fit(docs, given)
    without = toxicity.fit(docs, given, unlabelled=0)
    pattern = len(with_free.terms) + list(toxicity.PATTERNS).index("you_are")
    assert with_free.weights[pattern] > without.weights[pattern] == 0
    odd_docs = docs.unionByName(frame(spark, [(5, None, "", "", 0), (5, "", "", "", 0), (None, None, "", "", 0)] * 2)).withColumn("toxic", F.lit("clash")).withColumn("family", F.lit(1))
    assert toxicity.toxicity(odd_docs, given).count() == 906


# --- suffix arrays -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(1, 6))])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = random.Random(3)
    part = bytes(rng.choice(alphabet) for _ in range(300))
    data = part * 3 + part[:40] * 5 + bytes(rng.choice(alphabet) for _ in range(200))
    d = np.frombuffer(data, np.uint8)
    sa = suffix.suffix_array(d, 64)
    assert [data[i : i + 64] for i in sa] == sorted(data[i : i + 64] for i in range(len(data)))
    shared = suffix.common_prefixes(d, sa, 64, lanes=7)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        n = next((k for k in range(64) if data[a + k : a + k + 1] != data[b + k : b + k + 1] or max(a, b) + k >= len(data)), 64)
        assert shared[b] == n


def brute_repeats(rows):
    first, out = set(), {}
    for key, b in rows:
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in first:
                mark[s : s + 100] = b"\x01" * 100
            else:
                first.add(b[s : s + 100])
        spans = len(re.findall(rb"\x01+", bytes(mark)))
        out[key] = (len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes", [2000, 4 << 20])
def test_substring_dedup(spark, shard_bytes):
    docs = documents(spark)
    want = brute_repeats(sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.substring_dedup(docs, shard_bytes).collect()}
    assert got == want
    assert suffix.substring_dedup(empty(spark)).count() == 0


def test_shards_are_shuffled_once(spark, monkeypatch):
    """What is found for the shards comes to their buckets; the table of shards goes in the end."""
    plans, stage = {}, suffix.staged
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def seen(df, purpose, keep=False):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return stage(df, purpose, keep)

    monkeypatch.setattr(suffix, "staged", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert suffix.substring_dedup(documents(spark), 2000).count() == documents(spark).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for purpose in ("text-repeats", "text-kept"):
        join = next(i for i, x in enumerate(plans[purpose]) if "Join" in x)
        own = plans[purpose][join + 1 : next(i for i, x in enumerate(plans[purpose]) if i > join and "Scan" in x) + 1]
        assert "Bucketed: true" in own[-1] and not any("Exchange" in x for x in own)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("text_shards")]


def test_substring_dedup_of_odd_rows(spark):
    docs = odd(spark)
    got = suffix.substring_dedup(docs).collect()
    assert len(got) == docs.count()
    ordered = sorted(((r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).digest()), (r.text or "").encode()) for r in docs.collect())
    want = brute_repeats([(k, b) for k, (_, b) in enumerate(ordered)])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want.values())


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_substring_dedup_of_repeated_rows(spark, parts):
    """Rows that occur one to six times, dealt over several partitions and into many small shards."""
    rng = random.Random(parts)
    passage = sentence(rng, 40)
    rows = []
    for i in range(60):
        text = sentence(rng, rng.randrange(10, 80)) + (f" {passage} " if i % 3 else "") + sentence(rng, 10)
        rows += [(i if i % 7 else None, text)] * (1 + i % 6 if i % 2 else 1)
    rows += [(1, "another text of the same document " * 4)] * 3
    docs = frame(spark, rows, "doc_id long, text string").repartition(parts)
    got = suffix.substring_dedup(docs, 3000).collect()
    ordered = sorted((d is None, d or 0, hashlib.sha256(t.encode()).digest(), t.encode()) for d, t in rows)
    want = brute_repeats([(k, r[3]) for k, r in enumerate(ordered)])
    ids = {k: (None if r[0] else r[1]) for k, r in enumerate(ordered)}
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == sorted(((ids[k], *w) for k, w in want.items()), key=repr)


# --- near duplicates -----------------------------------------------------------------------------------------------


def shingles(text):
    w = PLAIN.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(texts(seed))]
    base = sentence(rng, 150).split()
    for k in range(60):  # copies with up to eight edits: some are linked only through others
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((100 + k, " ".join(w)))
    docs = frame(spark, [(i, t, "", "", 0) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd(spark)
    got = near.near_duplicates(docs).collect()
    assert len(got) == docs.count() and near.near_duplicates(empty(spark)).count() == 0
    kept = near.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts_of = [shingles(r.text) for r in kept.collect()]
    full = [s for s in texts_of if s]
    assert all(100 * len(a & b) < 85 * len(a | b) for k, a in enumerate(full) for b in full[:k])
    assert len(full) == len({c for _, c, k in brute_components([(k, r.text) for k, r in enumerate(docs.collect())]).values()} - {k for k, r in enumerate(docs.collect()) if not shingles(r.text)})


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in graph.components(frame(spark, edges, "u long, v long"), "test").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 140)}
    assert graph.components(frame(spark, [], "u long, v long"), "none").count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        x = rng.integers(0, 2**63, 4000).astype(np.uint64)
        a, b = near.band_keys(x[:3000], 400, 1), near.band_keys(x[300:3300], 400, 1)
    assert abs((a == b).mean() - 2700 / 3300) < 0.08


# --- WARC ----------------------------------------------------------------------------------------------------------


def test_merkle_audit_finds_every_fault(spark):
    pages = frame(spark, [(i, f"http://x/{i}" if i % 7 else None, f"<p>{'x' * (i * 37 % 5000)}</p>" if i % 11 else None) for i in range(300)] + [(None, "u", "h"), (5, "u", "h"), (5, "u", "h")], "page_id long, url string, html string")
    ours = warc.archived(pages, 64)
    assert warc.audit(ours, ours).count() == 0
    first = ours.orderBy("archive", "offset").collect()
    spans = [(r.archive, r.offset, len(r.record)) for r in first]
    for (a, o, n), (b, p, _) in zip(spans[:-1], spans[1:], strict=True):
        assert b > a or p == o + n
    bad, lost = spans[10][:2], spans[150][:2]
    at = lambda k: (F.col("archive") == k[0]) & (F.col("offset") == k[1])
    theirs = ours.where(~at(lost)).withColumn("record", F.when(at(bad), F.concat("record", F.lit(b"!"))).otherwise(F.col("record")))
    theirs = theirs.unionByName(ours.where(at(bad)).withColumn("offset", F.lit(10**9).cast("long")))
    got = {((r.archive, r.offset), r.fault) for r in warc.audit(ours, theirs).collect()}
    assert got == {(bad, "changed"), (lost, "missing"), ((bad[0], 10**9), "extra")}
    none = pages.limit(0)
    assert warc.replica_faults(none).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------------


def fold_words(text):
    return (text or "").encode().translate(FOLD).split()


def brute_hits(text, items):
    w = fold_words(text)
    windows = collections.defaultdict(set)
    for key, t in items:
        v = fold_words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1) if v else ():
            windows[tuple(v[k : k + n])].add(str(key))
    hit, found = set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if (x := tuple(w[i : i + n])) in windows:
                hit.update(range(i, i + n))
                found |= windows[x]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [100, 16 << 20])
def test_decontamination(spark, bench, monkeypatch, limit):
    monkeypatch.setattr(decontaminate.find_passages, "__defaults__", ("found", 10, limit))
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    by = {k: t for k, t in items if t}
    rows = list(enumerate(texts())) + [(100, f"before {by[3]} after"), (101, by[0].upper() + "!" + by[0]), (102, " ".join(by[2].split()[1:11])), (103, " ".join(by[2].split()[1:10])), (104, by[2].replace(" ", ", ") + " é " + by[4])]
    docs = frame(spark, [(i, t, "", "", 0) for i, t in rows])
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows}
    clean = decontaminate.without_benchmark(odd(spark).unionByName(docs, allowMissingColumns=True), bench)
    assert {r.doc_id for r in clean.collect()} & set(range(100, 105)) == {103}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_hits_map_back_to_the_original(spark, bench):
    item = next(r.text for r in bench.collect() if r.item_id == 3)
    text = "Größe? " + item.replace(" ", " -- ").upper() + " ende"
    r = decontaminate.find_passages(frame(spark, [(1, text, "", "", 0)]), bench).first().found
    assert text.encode()[r.first_bytes[0] : r.end_bytes[0]].decode() == item.replace(" ", " -- ").upper()


# --- main text -----------------------------------------------------------------------------------------------------

LONG = "This is a paragraph of the article, long enough to count, with commas, and more words in it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<script>x='<p>no</p>'</script><style>p{}</style>", ""),
        (f"<nav><a href=/>Menu</a></nav><article><h1>Title</h1><p>{LONG}<p>{LONG}</article><footer>&copy; x</footer>", f"Title {LONG} {LONG}"),
        (f"<div class=sidebar><p>{LONG}</p></div><div id=content><p>{LONG}</p><div class=ad>Buy</div><p>x &eacute;&#33; {LONG}</p></div>", f"{LONG} x é! {LONG}"),
        (f"<div><p>{LONG}</p></div><div class='comments'><p>Reader: {LONG} {LONG} {LONG}</p></div>", LONG),
        (f"<article><p><b>{LONG}<br><p>{LONG}</p></article><footer>cut", f"{LONG} {LONG}"),
        (f"<form><p>{LONG}</p></form><main><p>{LONG}</p><aside>{LONG}</aside><table><tr><td>1<td>2</table></main>", f"{LONG} 1 2"),
        (f"<article><p>{LONG}</p><!-- <p>no</p> --><ul><li>one<li>two</ul><pre>a\n  b</pre></article>", f"{LONG} one two a b"),
        (f"<body><div hidden>{LONG}</div><div style='display: none'>{LONG}</div><section><p>a < b, {LONG}</p></section>", f"a < b, {LONG}"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *((f"<div class='{name}'><article><p>{LONG}</p></article></div><div>&copy; us</div>", LONG) for name in (
            "container has-sidebar", "content no-sidebar", "page-with-comments", "elementor-widget-container", "wp-widget", "search-result-page", "share-enabled", "sidebar-left", "site cookies-accepted")),
        (f"<div class='sidebar-left'><div class=sidebar>Links, and more of them</div><p>{LONG}</p></div>", LONG),
        ("".join(f"<div class='elementor-widget'><p>{k} {LONG}</p></div>" for k in range(5)), " ".join(f"{k} {LONG}" for k in range(5))),
        (f"<article><div class='search-block'><p>{LONG} {LONG}</p></div><p>{LONG}</p></article>", f"{LONG} {LONG} {LONG}"),
        (f"<div class=comments><p>{LONG}</p></div>", LONG),
        (f"<div><p>{LONG}</p></div><div class=comments><article class=comment><p>{LONG} {LONG} {LONG}</p></article></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class='cookie-consent'><p>{LONG} {LONG} {LONG}</p></div><div class=sidebar><p>{LONG} {LONG}</p></div>", LONG),
    ],
)
def test_main_text_below_names_of_the_layout(page, want):
    assert html.main_text(page) == want


SECTION = "".join(f"<p>{k} {LONG} {LONG}</p>" for k in range(10))
SECTION_TEXT = " ".join(f"{k} {LONG} {LONG}" for k in range(10))
REST = "<h2>Later</h2><p>Short.</p><h3>Deep</h3><ul><li>one<li>two</ul><pre>a  b</pre><table><tr><td>1</table><figure><figcaption>Seen</figcaption></figure>"
REST_TEXT = "Later Short. Deep one two a b 1 Seen"
LINKS = "<ul><li><a href=/1>Another page of ours</a><li><a href=/2>And one more</a></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><section>{SECTION}</section><section>{REST}</section>{REST}</article>", f"{SECTION_TEXT} {REST_TEXT} {REST_TEXT}"),
        (f"<body><div><h1>Title</h1><div>{SECTION}</div>{REST}</div></body>", f"Title {SECTION_TEXT} {REST_TEXT}"),
        (f"<body><div><div><div>{SECTION}</div></div><div><div>{REST}</div></div></div></body>", f"{SECTION_TEXT} {REST_TEXT}"),
        (f"<main><div>{LINKS}</div><div><p>Lead</p></div><article><div>{SECTION}</div>{LINKS}</article><div>{LINKS}</div></main><div>us</div>", f"Lead {SECTION_TEXT} Another page of ours And one more"),
        (f"<body><div>{LINKS}</div><div>{SECTION}</div><div><p>End</p></div></body>", f"{SECTION_TEXT} End"),
        (f"<article><main>{LINKS}<div>{SECTION}</div></main>{LINKS}</article>", f"Another page of ours And one more {SECTION_TEXT} Another page of ours And one more"),
        (f"<div><article><p>{LONG}</article><article>{SECTION}</article><article>Tail</article></div>", f"{LONG} {SECTION_TEXT} Tail"),
    ],
)
def test_main_text_keeps_uneven_parts(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("empty", ["<svg/>", "<svg class='i' />", "<SVG viewBox='0 0 1 1'/>", "<math/>", "<svg><path d='M0 0'/></svg>", "<svg class=i/><path/></svg>"])
def test_main_text_goes_on_after_empty_drawings(empty):
    for more in ("", "<svg><text>no</text></svg>"):
        assert html.main_text(f"<article><p>{LONG} {empty}{LONG}</p><p>{LONG}</p>{more}</article>") == f"{LONG} {LONG} {LONG}"


TEASER = "<article><h3><a href=/3>Another story of ours</a></h3><p>It tells what happened, and why it matters.</p></article>"
CONSENT = "<div><p>We store data on your device, to measure visits and to improve this site. You may agree or decline.</p><button>Agree</button></div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # Headers of the page go, headers of the article stay.
        (f"<body><header><h1>SITE NAME</h1><p>All the news that we have, every day of the week.</p></header><article><header><h1>Title</h1></header>{SECTION}</article></body>", f"Title {SECTION_TEXT}"),
        *((f"<body><div {name}><p>SITE NAME, all the news of the week</p></div><div><h1>Title</h1>{SECTION}</div></body>", f"Title {SECTION_TEXT}") for name in ("class=header", "id=site-header", "class='page-header dark'", "class=branding", "role=banner", "id=masthead")),
        (f"<body><header>SITE</header><main><header><h2>Title</h2></header><div class=header>Lead</div>{SECTION}</main></body>", f"Title Lead {SECTION_TEXT}"),
        (f"<body><div class=post><div class=entry-header><h1>Title</h1></div><h2 class=header>Part</h2>{SECTION}</div></body>", f"Title Part {SECTION_TEXT}"),
        # A form around the page does not empty it; its controls go, and forms beside or inside the article.
        (f"<body><form action=/p><nav>{LINKS}</nav><div><label>Find</label><input name=q><select><option>all</select></div><article>{SECTION}</article><button>Send</button></form></body>", SECTION_TEXT),
        (f"<body><form><div>{SECTION}</div></form></body>", SECTION_TEXT),
        (f"<article>{SECTION}<form><p>Leave a word, please, we read them all.</p><textarea>x</textarea></form></article>", SECTION_TEXT),
        # Teasers and unnamed notices beside the article.
        (f"<body><article>{SECTION}</article><section>{TEASER * 4}</section></body>", SECTION_TEXT),
        (f"<body><div>{TEASER}{TEASER}<article>{SECTION}</article>{TEASER}</div></body>", SECTION_TEXT),
        (f"<body>{CONSENT}<h1>Title</h1><article>{SECTION}</article></body>", f"Title {SECTION_TEXT}"),
    ],
)
def test_main_text_of_whole_sites(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "deep text, at last, with commas, and more",
        "<div><p>deep, " * 4000,
        "<b>" * 20_000 + "x" + "</i>" * 20_000 + "</b>" * 20_000,
        "<i>" * 10_000 + "<b>" * 10_000 + "x" + "</i>" * 10_000,
        "<p><table><tr><td>" + "<div>" * 20_000 + "x",
        "<div class=sidebar><article><p>some text, of the page</p>" * 3000,
        "".join(f"<div class='nav-{k} menu'><p>some text, of the page {k}" for k in range(3000)),
        "<article><form>" * 5000 + "x, y",
        "<ul><li>" * 8000 + "</ul>" * 9000 + "x",
        "<header>" * 9000 + "x, and y",
    ],
)
def test_main_text_takes_linear_time(page):
    start = time.perf_counter()
    assert html.main_text(page)
    assert time.perf_counter() - start < 3


class Plain(HTMLParser):
    """Text of the article element without anything that is named as not belonging to it: enough for the given pages."""

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("nav", "footer", "script", "style") or tag == "div" and dict(attrs).get("class") == "ad"
        if tag in ("p", "h1", "li", "div", "ul", "br"):
            self.blocks.append(" ") if tag == "br" else self.blocks.append("\n")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if self.skip:
            self.skip -= tag in ("nav", "footer", "script", "style", "div")

    def handle_data(self, data):
        if self.inside > 0 and not self.skip:
            self.blocks.append(data)


def test_main_text_equals_a_plain_reader(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    differ = 0
    for r in html.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        plain = Plain()
        plain.feed(r.html or "")
        want = " ".join(" ".join(b.split()) for b in "".join(plain.blocks).split("\n") if b.split())
        differ += r.text != want
    assert differ == 0


def test_main_text_of_a_table(spark):
    pages = frame(spark, [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "u", "<p>é</p>"), (2, "v", "<p>" + "word " * 50_000)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in html.extract_pages(pages.withColumn("text", F.lit("clash"))).collect())
    assert got == [(0, 1, 1), (1, len(LONG), len(LONG)), (2, 0, 0), (2, 249_999, 249_999)]
    assert html.extract_pages(pages.limit(0)).count() == 0


# --- quality rules -------------------------------------------------------------------------------------------------


def brute_stats(text):
    t = text or ""
    w = PLAIN.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    rows = [x for x in t.split("\n") if PLAIN.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(rows) - len(set(rows)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base(spark):
    more = ["a b c d e f g h " * 3, "x " * 7, "x " * 8, "x " * 9, "$$$ ### <b>|", "é ü ö\n\né ü ö\n é"]
    rows = list(enumerate(texts() + more))
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_verdicts(frame(spark, [(i, t, "", "", 0) for i, t in rows]), none).collect()}
    for i, t in rows:
        assert got[i][:6] == brute_stats(t), i
        assert got[i][6] == (not brute_stats(t)[5])
    assert quality.quality_verdicts(empty(spark), none).count() == 0


def test_quality_rules_are_learned(spark):
    rng = random.Random(8)
    rows, labels = [], []
    letters = str.maketrans("0123456789", "abcdefghij")
    for i in range(900):
        w = sentence(rng, 60).translate(letters).split()
        kind = i % 9
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            w = [rng.choice(["p", "q", "r"]) for _ in w]
        elif kind == 2:
            w[0] += "#"  # one symbol is not junk
        rows.append((i, " ".join(w), "en", "s", 0))
        if i % 2:
            labels.append((i, 0 if kind < 2 else 1, 0))
    labels += [(None, 0, 0), (5, None, 0), (10**6, 1, 1)]
    docs, given = frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, given).collect()}
    assert all(got[i].kept == (i % 9 > 1) for i in range(900))
    plan = quality.quality_verdicts(docs, given)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    kept = quality.kept_documents(odd(spark), given)
    assert kept.columns == odd(spark).columns and kept.count() > 0


# --- mixing --------------------------------------------------------------------------------------------------------


def test_targets_reshare_the_excess():
    got = mixing.targets([100, 10, 1000, 0], [3, 1, 2, 3])
    assert [float(x) for x in got] == [200, 20, 1445, 0] and sum(got) == 1665


def test_split_tree_is_exact_and_spread():
    counts = np.array([10_000, 3, 0, 700])
    got = mixing.split_tree(counts, 12, 1)
    assert (got.sum(0) == counts).all() and (got >= 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 1 and abs(got[:, 0] / got.sum(1) - 10_000 / 10_703).max() < 0.05
    assert (got == mixing.split_tree(counts, 12, 1)).all()


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, int(rng.paretovariate(1.1) * 20) % 3000), "en", rng.choice(["a", "b", "b", "b", "c", "d", None]), 0) for i in range(4000)]
    rows += [(9001, None, "en", "a", 0), (9002, "", "en", "only empty", 0), (9003, "x y", "en", "", 0), (None, "null id here", "en", "b", 0)]
    docs = frame(spark, rows)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    size = {(r[0]): len(PLAIN.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals = collections.Counter()
    for i, n in size.items():
        totals[source[i]] += n
    order = sorted((s for s in totals if s is not None)) + [None]
    want = dict(zip(order, mixing.targets([totals[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))]), strict=True))
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and abs(r.target - float(want[s])) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.01 * float(want[s]) + 1, s
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()), key=repr)
    out = mixing.mixed(docs).collect()
    assert collections.Counter(r.doc_id for r in out if size[r.doc_id]) == collections.Counter({r.doc_id: r.taken // r.size for r in got if r.size and r.taken})
    assert len({r.mix_shard for r in out}) > 20


def test_mixture_of_odd_rows(spark):
    out = mixing.mixed(odd(spark))
    assert out.columns == [c for c in odd(spark).columns if c != "mix_order"] + ["mix_shard", "mix_pass", "mix_order"] and out.count() > 0
    assert mixing.mix_report(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


# --- lines ---------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=lines.MIN_WORDS):
    """All runs of lines with enough words, in order; later copies are marked."""
    seen, gone, own = set(), collections.defaultdict(set), {}
    for i, t in rows:
        own[i] = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate((t or "").split("\n")) if PLAIN.search(x)]
        words = [len(PLAIN.findall(x)) for _, x in own[i]]
        for a in range(len(words)):
            total, key = 0, []
            for b in range(a, min(len(words), a + 60)):
                total += words[b]
                key.append(own[i][b][1])
                if total >= least:
                    if tuple(key) in seen:
                        gone[i].update(own[i][k][0] for k in range(a, b + 1))
                    seen.add(tuple(key))
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(6)
    rows = list(enumerate(texts()))
    for k in range(80):
        rows.append((100 + k, "\n".join(rng.choice([f"line {x} " * rng.choice([1, 2]) for x in range(6)] + ["", " "]) for _ in range(rng.randrange(1, 40)))))
    docs = frame(spark, [(i, t, "", "", 0) for i, t in rows])
    want = brute_lines(rows)
    got = {r.doc_id: r.kept_sha256 for r in lines.line_dedup(docs).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    plan = lines.line_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_dedup_of_odd_rows(spark):
    docs = odd(spark)
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert all(r.n_chars == len(r.text) for r in out.where("doc_id is not null and doc_id <> 5").collect() if r.text is not None)
    assert lines.line_dedup(empty(spark)).count() == 0


# --- licences ------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = fold_words(text)
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.encode().split()
        places = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += places
        labels |= {label} if places else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    more = [
        "Licensed CC-BY 4.0 and CC BY-NC. All Rights  Reserved!", "the lesser GENERAL public license, general public license version 3", "All rights\nreserved all rights reserved",
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nnext", "ccby cc bya", "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "é SPDX-License-Identifier:",
    ]
    rows = list(enumerate(texts() + more))
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, [(i, t, "", "", 0) for i, t in rows])).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), i
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    n = len(rows) - len(more)
    assert got[n + 3].labels == "apache-2.0,bsd-3-clause,mit" and got[n + 5].labels == "gpl-2.0-only" and got[n + 6].labels == ""
    assert licenses.license_scan(empty(spark)).count() == 0
    assert "license" in licenses.with_licenses(odd(spark)).columns


@pytest.mark.parametrize(
    ("line", "value", "names"),
    [
        ("MIT", 0.9, ["mit"]), ("MIT OR GPL-3.0", 0.9, ["mit", "gpl-3.0"]), ("MIT AND GPL-3.0 OR CC0-1.0", 1.0, ["mit", "gpl-3.0", "cc0-1.0"]),
        ("MIT AND (GPL-3.0 OR CC-BY-NC-4.0)", 0.4, ["mit", "gpl-3.0", "cc-by-nc-4.0"]), ("GPL-2.0 WITH X-exception AND MIT", 0.7, ["gpl-2.0", "mit"]),
        ("(MIT", 0.9, ["mit"]), ("MIT AND", 0.9, ["mit"]), ("AND MIT", 0.5, []), ("", 0.5, []), (") MIT", 0.5, []),
    ],
)
def test_license_expressions(line, value, names):
    got = licenses.parse_expression(line)
    assert got[0] == pytest.approx(value) and got[1] == names


def test_license_expressions_end_at_line_or_next_tag():
    tag = "SPDX-License-Identifier:"
    got = licenses.scan(f"é {tag} MIT or\n{tag} (Apache-2.0 and\tISC) x {tag}\n{tag} {tag} Zlib {tag} BSD-3-Clause with é", licenses.phrase_automaton())
    assert got[5] == "apache-2.0,bsd-3-clause,isc,mit,zlib" and got[0] == 33


@pytest.mark.parametrize("part", ["SPDX-License-Identifier: MIT\n", "SPDX-License-Identifier: MIT or ", "SPDX-License-Identifier: (", "all rights reserved "])
def test_license_scan_of_very_many_tags_is_linear(part):
    text = part * 100_000
    start = time.perf_counter()
    licenses.scan(text, licenses.phrase_automaton())
    assert time.perf_counter() - start < 5
    many = "".join(f"SPDX-License-Identifier: lic{k}-{k % 7}\n" for k in range(30_000))
    start = time.perf_counter()
    assert licenses.scan(many, licenses.phrase_automaton())[5].count(",") == 29_999
    assert time.perf_counter() - start < 5


def test_outermost_labels():
    rng = random.Random(2)
    labels = {"-".join(rng.choice("ab.c") for _ in range(rng.randrange(1, 4))) for _ in range(60)}
    assert licenses.outermost(labels) == {x for x in labels if not any(y.startswith(f"{x}-") for y in labels)}
