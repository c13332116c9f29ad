"""Registered text queries against their SQL, and the pipeline stage by stage against brute force."""

import collections
import random

import pytest

import corpus_pipeline
from oracle_check import compare, connect
from test_text_operators import brute_components, brute_hits, brute_lines, brute_stats, shingles
from vacantia.llm import quality
from vacantia.llm.near import without_near_duplicates
from vacantia.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])[0] == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    good = steps["quality_rules"](spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert good.columns == columns and set(rows(good)) == {i for i, k in verdict.items() if k}
    assert not any(brute_stats(r.text)[5] for r in good.collect())

    shorter = steps["line_dedup"](spark, good, sf)
    want = {i: t for i, t in brute_lines(sorted((r.doc_id, r.text) for r in good.collect())).items() if t.strip() or not rows(good)[i].text.strip()}
    assert shorter.columns == columns and {i: r.text for i, r in rows(shorter).items()} == want
    assert all(r.n_chars == len(r.text) for r in shorter.collect())

    single = steps["near_dedup"](spark, shorter, sf)
    parts = brute_components(sorted((r.doc_id, r.text) for r in shorter.collect()), corpus_pipeline.NEAR_PERCENT)
    assert single.columns == columns and set(rows(single)) == {i for i, (_, _, kept) in parts.items() if kept}

    clean = steps["benchmark_decontamination"](spark, single, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert clean.columns == columns and set(rows(clean)) == {r.doc_id for r in single.collect() if not brute_hits(r.text, items)[4]}

    mixed = steps["source_mixing"](spark, clean, sf)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(rows(clean)) and set(times.values()) <= {1, 2}
    taken = sum(len(r.text.split()) for r in mixed.collect())
    assert abs(taken - 1.5 * sum(len(r.text.split()) for r in clean.collect())) < 0.05 * taken
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, mixed.collect()))


def test_pipeline_links_near_copies_from_080(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(270)]
    far = [*base[:20], *(f"x{k}" if k % 40 == 0 else w for k, w in enumerate(base[20:]))]  # seven edits: under 0.8
    near = [f"y{k}" if k in (30, 80, 130, 180, 230) else w for k, w in enumerate(base)]  # five edits: 241 of 291 shingles
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper())]
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert 0.80 <= alike(sets[0], sets[1]) < 0.85 and max(alike(sets[k], sets[2]) for k in (0, 1)) < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in without_near_duplicates(docs).collect()) == [1, 2, 3]
