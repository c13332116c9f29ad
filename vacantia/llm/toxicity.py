"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

* Terms: of a bounded sample of labelled documents, words and word beginnings are counted by label, and the terms that
  tell most are kept. Of documents that share the smallest of their three-word shingles, likely copies, one counts. With the fixed lexicons and patterns below they make up the voters: a voter says
  toxic where one of its terms stands in the text, clean where none does (and abstains on texts without words).
* Label model: two classes, each voter with its own rates per class, the given labels being one more voter, which
  abstains on a sample of documents without a label. Rates and posteriors are fitted on both by expectation maximisation;
  voters that agree beyond what the class explains share their weight.
* Classifier: a logistic regression over the terms and patterns present in a text, fitted to the posterior labels of all
  of these documents, labelled or not. It
  scores every whole text, one pass, by the distinct terms in it. Scores use nothing but the text.

``sample`` bounds the labelled documents used for fitting, ``unlabelled`` those without a label, ``n_terms`` the terms kept; all are chosen by hash and by
weight, alike at every size. Statistics that need no label are not taken from a sample.

Null and empty texts have no terms and get the score of the intercept. Labels that are null, contradict each other, or
belong to no document are left out; documents with null ids are scored but never learned from. Without labels of both
kinds only the fixed lexicons speak.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled, staged

SAMPLE = 40_000
UNLABELLED = 20_000
N_TERMS = 4_000
LEAST_DOCS = 6  # toxic documents a learned term must stand in
HELD_OUT = 5

# Fixed lexicons of everyday abuse.
LEXICONS = {
    "insult_nouns": "idiot moron imbecile loser clown scum trash jerk creep freak fool dimwit scumbag dumbass bastard coward pig vermin",
    "insult_words": "stupid worthless pathetic disgusting dumb ugly retarded useless brainless spineless despicable repulsive",
    "hate_words": "hate despise loathe detest",
    "threat_words": "kill murder strangle stab lynch exterminate",
    "german": "idiot dummkopf trottel arschloch blödmann abschaum vollidiot scheiße",
    "french": "idiot imbécile crétin connard salaud ordure abruti débile",
    "spanish": "idiota imbécil estúpido cabrón gilipollas basura asqueroso tonto",
}
PATTERNS = {
    "you_are": re.compile(r"\b(?:you|u)(?:'re| are| r)\s+(?:such\s+)?(?:a|an|so|all)?\s*(?:idiot|stupid|moron|loser|pathetic|worthless|disgusting)", re.IGNORECASE),
    "shut_up": re.compile(r"\b(?:shut up|go to hell|drop dead|get lost|kill yourself)\b", re.IGNORECASE),
    "shouting": re.compile(r"\b(?:[A-Z]{4,}\s+){3,}"),
    "many_marks": re.compile(r"[!?]{4,}"),
}
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7, 8)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Distinct words and beginnings of longer words (``abcd*``)."""
    distinct = set(_WORD.findall(text.lower()))
    out = set(distinct)
    for k in BEGINNINGS:
        out.update(f"{w[:k]}*" for w in distinct if len(w) > k)
    return out


def present(text: str, known: dict[str, int]) -> list[int]:
    """Indices of the known terms in a text, without building terms that nobody knows."""
    distinct = set(_WORD.findall(text.lower()))
    found = {known[w] for w in distinct if w in known}
    for k in BEGINNINGS:
        found.update(known[s] for w in distinct if len(w) > k and (s := f"{w[:k]}*") in known)
    return sorted(found)


def patterns_in(text: str) -> list[int]:
    return [k for k, p in enumerate(PATTERNS.values()) if p.search(text)]


def family_of(texts: pd.Series) -> pd.Series:
    """The smallest hash of three neighbouring words: equal for most near copies."""
    out = []
    for t in texts:
        words = _WORD.findall(t.lower())
        out.append(min(map(" ".join, zip(words, words[1:], words[2:], strict=False)), key=xxhash.xxh64_intdigest, default=" ".join(words)))
    return pd.Series(out, dtype=object)


def chosen(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows by hash of their doc_id; all of them if there are no more."""
    n = rows.count()
    return rows if n <= sample else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample / n))


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, text, toxic`` of about ``sample`` labelled documents outside the held-out fold, chosen by hash of the id."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top").select("doc_id", "toxic")
    found = docs.select("doc_id", filled("text").alias("text")).join(chosen(one, sample), "doc_id")
    return found.withColumn("family", F.pandas_udf(family_of, "string")("text"))


def unlabelled_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, text`` of about ``sample`` documents outside the held-out fold that no label speaks of."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).distinct()
    free = ids.join(labels.select("doc_id"), "doc_id", "left_anti")
    return docs.select("doc_id", filled("text").alias("text")).join(chosen(free, sample), "doc_id")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts[1].keys() | counts[0].keys())
        made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], ["term", "clean", "toxic"])
        counts[0].clear()
        counts[1].clear()
        return made

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            counts[1 if toxic.as_py() else 0].update(terms_of(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield out()
    yield out()


def telling_terms(labelled: DataFrame, n_terms: int) -> list[tuple[str, int, int]]:
    """The terms whose presence speaks most for toxic: term, clean and toxic documents."""
    # Of a family the text that comes first in order of its characters: a rerun takes the same one.
    labelled = labelled.groupBy("family", "toxic").agg(F.min("text").alias("text"))
    totals = labelled.agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") != 0, 1)).alias("toxic")).first()
    if not totals["clean"] or not totals["toxic"]:
        return []
    counts = labelled.select("text", "toxic").mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    base = totals["toxic"] / totals["clean"]
    odds = F.log((F.col("toxic") + 0.5) / ((F.col("clean") + 0.5) * base))
    # Weight of the evidence, and only terms of which toxic documents make up most.
    best = counts.where(F.col("toxic") >= LEAST_DOCS).where(F.col("toxic") > 4 * F.col("clean")).withColumn("weight", F.col("toxic") * odds)
    return [(r["term"], r["clean"], r["toxic"]) for r in best.orderBy(F.desc("weight"), "term").limit(n_terms).collect()]


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray  # terms, then patterns, then voters
    intercept: float
    voters: dict[int, list[int]]  # by term

    def score(self, text: str | None) -> float:
        t = text or ""
        at = widened(present(t, self.terms) + [len(self.terms) + k for k in patterns_in(t)], len(self.terms) + len(PATTERNS), self.voters)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[at].sum(), -30, 30))))


def widened(at: list[int], width: int, voters: dict[int, list[int]]) -> list[int]:
    """Terms and patterns, and behind them the voters that see one of these."""
    return at + sorted({width + v for i in at for v in voters.get(i, ())})


def voters_of(terms: dict[str, int], learned: list[str], groups: int = 4) -> list[set[int]]:
    """Voters as sets of term indices: each lexicon, and the learned terms by kind and group."""
    out = [{terms[w] for w in words.split()} for words in LEXICONS.values()]
    kinds: dict[tuple[str, int], set[int]] = {}
    for rank, t in enumerate(learned):
        kind = f"beginning {len(t) - 1}" if t.endswith("*") else "word"
        kinds.setdefault((kind, rank % groups), set()).add(terms[t])
    return out + list(kinds.values())


def label_model(votes: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of class 1 per row from votes in 0, 1 and -1 (abstains); the last column are the given labels.

    Correlations: voters whose votes go together within a class, as far as the rates explain, share one weight.
    """
    m = votes.shape[1]
    given = votes[:, -1]
    yes, no = votes == 1, votes == 0
    share_of_yes = yes.sum(1) / np.maximum((yes | no).sum(1), 1)
    post = np.where(given == 1, 0.95, np.where(given == 0, 0.05, 0.1 + 0.8 * share_of_yes)).astype(float)
    share = np.ones(m)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rates = []
        for w in (post, 1 - post):
            on, off = (yes * w[:, None]).sum(0), (no * w[:, None]).sum(0)
            rates.append((on + 0.5) / (on + off + 1.0))
        one, zero = rates
        centred = np.where(votes >= 0, votes - (post[:, None] * one + (1 - post[:, None]) * zero), 0.0)
        spread = np.sqrt((centred**2).sum(0) + 1e-9)
        corr = np.abs((centred.T @ centred) / np.outer(spread, spread))
        corr[:, -1] = corr[-1, :] = 0.0
        np.fill_diagonal(corr, 1.0)
        share = 1 / np.where(corr > 0.2, corr, 0).sum(0).clip(1)
        up, down = np.log(one / zero) * share, np.log((1 - one) / (1 - zero)) * share
        raw = np.log(prior / (1 - prior)) + yes @ up + no @ down
        new = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        if np.abs(new - post).max() < 1e-5:
            post = new
            break
        post = new
    return post


def logistic(rows: list[list[int]], width: int, post: np.ndarray, ridge: float = 0.01, rounds: int = 2_000) -> tuple[np.ndarray, float]:
    """Weights and intercept for sparse 0/1 rows and soft labels; full-batch steps scaled per weight."""
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(width), float(np.log(np.clip(post.mean(), 1e-3, 0.5) / (1 - np.clip(post.mean(), 1e-3, 0.5))))
    g2, gb2, step = np.full(width, 1e-8), 1e-8, 1.0
    for _ in range(rounds):
        z = b + np.bincount(owner, w[flat], len(rows)) if len(flat) else np.full(len(rows), b)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - post
        grad = (np.bincount(flat, err[owner], width) if len(flat) else 0) + ridge * w
        g2 += grad**2
        gb2 += err.sum() ** 2
        w -= step * grad / np.sqrt(g2)
        b -= step * err.sum() / np.sqrt(gb2)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_terms: int = N_TERMS, unlabelled: int = UNLABELLED) -> Model:
    labelled = staged(sample_of(docs, labels, sample), "toxic-sample")
    learned = [t for t, _, _ in telling_terms(labelled, n_terms)]
    words = dict.fromkeys([w for x in LEXICONS.values() for w in x.split()] + learned)
    terms = {t: k for k, t in enumerate(words)}
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def found(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([present(t, known) + [len(known) + k for k in patterns_in(t)] + ([] if _WORD.search(t) else [-1]) for t in texts])

    others = unlabelled_of(docs, labels, unlabelled).withColumn("toxic", F.lit(None).cast(labelled.schema["toxic"].dataType))
    both = labelled.select("doc_id", "toxic", "text").unionByName(others)
    # Rows of one document that see the same terms are one: a document repeated very often is one short list.
    seen = both.select("doc_id", "toxic", F.pandas_udf(found, "array<int>")("text").alias("at"))
    got = seen.distinct().collect()  # about ``sample + unlabelled`` short lists
    voters = voters_of(terms, learned)
    width = len(terms) + len(PATTERNS)
    where: dict[int, list[int]] = {}
    for v, members in enumerate(voters):
        for t in sorted(members):
            where.setdefault(t, []).append(v)
    got.sort(key=lambda r: (r["doc_id"], r["at"]))
    given = [-1 if r["toxic"] is None else 1 if r["toxic"] else 0 for r in got]
    if not {0, 1} <= set(given):  # nothing to learn from: any word of a fixed lexicon counts
        weights = np.zeros(width + len(voters))
        weights[width : width + len(LEXICONS)] = 4.0
        return Model(terms, weights, -2.0, where)
    votes = np.zeros((len(got), len(voters) + len(PATTERNS) + 1), np.int8)
    rows = []
    for r, row in enumerate(got):
        at = [i for i in row["at"] if i >= 0]
        if len(at) < len(row["at"]):
            votes[r, :] = -1
        for i in at:
            if i >= len(terms):
                votes[r, len(voters) + i - len(terms)] = 1
            for v in where.get(i, ()):
                votes[r, v] = 1
        votes[r, -1] = given[r]
        rows.append(widened(at, width, where))
    weights, intercept = logistic(rows, width + len(voters), label_model(votes))
    return Model(terms, weights, intercept, where)


def with_scores(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype=float)

    return docs.withColumn(out, F.pandas_udf(score, "double")(filled("text")))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: whether it is in the held-out fold, its score, and the class at 0.5."""
    model = fit(docs, labels, sample)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
