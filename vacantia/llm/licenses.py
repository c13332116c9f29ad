"""Licence scan: an Aho-Corasick pass for notice phrases and identifier tags, a shunting-yard parser for expressions.

Phrases are matched on folded words (see ``common.FOLD``), each framed by spaces, all in one pass over the whole text.
Where the words of an identifier tag end, the rest of that line of the original text, up to the next tag in it, is read
as a licence expression of identifiers, ``and``, ``or``, ``with`` and parentheses. Every identifier becomes a label. The score says how freely
the text may be used: the least free of all its statements, where ``and`` takes the smaller side, ``or`` the larger,
and ``with`` moves the licence halfway towards free. Without any statement it is 0.5.

Null and empty texts have no words, no labels and the score 0.5; an expression that does not parse still gives the
labels of the identifiers read up to there. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import filled, folded

# The phrases and labels every scan reports.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notice phrases, as folded words.
NOTICE_PHRASES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "public domain": "public-domain",
    "released into the public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
_NOTICE_LABELS = frozenset(NOTICE_PHRASES.values())
TAG_PHRASES = ("spdx license identifier",)

# How freely a text under a licence family may be used; the longest matching beginning of a label counts.
FREEDOM = {
    "0bsd": 1.0, "agpl": 0.3, "apache": 0.9, "bsd": 0.9, "cc-by": 0.8, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.5,
    "cc0": 1.0, "gpl": 0.4, "isc": 0.9, "lgpl": 0.5, "mit": 0.9, "mpl": 0.6, "proprietary": 0.0, "public-domain": 1.0,
    "reserved": 0.0, "unlicense": 1.0,
}
UNKNOWN = 0.5

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    fits = [k for k in FREEDOM if label == k or label.startswith(f"{k}-")]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def parse_expression(line: str, at: int = 0, stop: int | None = None) -> tuple[float, list[str]]:
    """Value and identifiers of the licence expression in ``line[at:stop]``; reading stops where none can go on."""
    stop = len(line) if stop is None else stop
    values: list[float] = []
    pending: list[str] = []
    labels: list[str] = []

    def apply() -> None:
        kind, right = pending.pop(), values.pop()
        left = values.pop()
        values.append(max(left, right) if kind == "or" else min(left, right) if kind == "and" else (left + 1) / 2)

    operand = True  # whether an identifier or an opening parenthesis comes next
    depth = 0  # open parentheses
    while True:
        while at < stop and line[at] in " \t":
            at += 1
        m = _TOKEN.match(line, at, stop)
        if not m:
            break
        word = m.group().lower()
        if operand and word == "(":
            pending.append(word)
            depth += 1
        elif operand and word != ")" and word not in _BINDS:
            excepted = bool(pending) and pending[-1] == "with"
            values.append(1.0 if excepted else freedom(word))
            labels += [] if excepted else [word]
            operand = False
        elif not operand and word in _BINDS:
            while pending and pending[-1] != "(" and _BINDS[pending[-1]] >= _BINDS[word]:
                apply()
            pending.append(word)
            operand = True
        elif not operand and word == ")" and depth:
            while pending[-1] != "(":
                apply()
            pending.pop()
            depth -= 1
        else:
            break
        at = m.end()
    if operand and pending and pending[-1] != "(":
        pending.pop()  # an operator without its right side
    pending = [x for x in pending if x != "("]
    while pending and len(values) > 1:
        apply()
    return (values[-1] if values else UNKNOWN), labels


def phrase_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, tuple[str | None, str | None]] = {p: (BASE_PHRASES.get(p), NOTICE_PHRASES.get(p)) for p in (*BASE_PHRASES, *NOTICE_PHRASES, *TAG_PHRASES)}
    for phrase, (base, more) in kinds.items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, base, more))
    found.make_automaton()
    return found


def tagged_expressions(text: str, raw: bytes, tags: list[tuple[int, int]]) -> Iterator[tuple[float, list[str]]]:
    """The expression behind each tag (first word, end word): the rest of its line, up to the next tag in it."""
    if not tags:
        return
    inside = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
    firsts, lasts = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    # One character per byte: what is not ASCII ends an expression in any case.
    line = text.encode("utf-8", "surrogatepass").decode("latin-1")
    breaks = np.append(np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 10), len(line))
    begins = lasts[[end - 1 for _, end in tags]]
    stops = np.minimum(breaks[np.searchsorted(breaks, begins)], np.append(firsts[[first for first, _ in tags[1:]]], len(line)) if len(tags) > 1 else len(line))
    for at, stop in zip(begins.tolist(), stops.tolist(), strict=True):
        while at < stop and line[at] in " \t:=":
            at += 1
        value, names = parse_expression(line, at, stop)
        if names:
            yield value, names


def outermost(labels: set[str]) -> set[str]:
    """Labels without those that a longer one of the same family says more exactly."""
    order = sorted(labels)
    return {x for x in order if not ((k := bisect_left(order, f"{x}-")) < len(order) and order[k].startswith(f"{x}-"))}


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    raw = folded(text)
    words = raw.split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    values: list[float] = []
    hits = list(automaton.iter(joined))
    if hits:
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        ends = np.searchsorted(spaces, [at for at, _ in hits]).tolist()
        tags = []
        for end, (_, (length, base_label, label)) in zip(ends, hits, strict=True):
            if base_label:
                base.add(base_label)
                starts.append(end - length)
            if label:
                labels.add(label)
            if not base_label and not label:
                tags.append((end - length, end))
        for value, names in tagged_expressions(text or "", raw, tags):
            values.append(value)
            labels.update(names)
        families = outermost(base | labels)
        tagged = {n for n in families if values and n in labels and n not in _NOTICE_LABELS}
        values += [freedom(x) for x in families - tagged]
    labels |= base
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=UNKNOWN),
    )


_AUTOMATON: list[ahocorasick.Automaton] = []


def _scan(texts: pd.Series) -> pd.DataFrame:
    if not _AUTOMATON:
        _AUTOMATON.append(phrase_automaton())
    names = [x.split()[0] for x in RESULT.split(", ")]
    out = pd.DataFrame([scan(t, _AUTOMATON[0]) for t in texts], columns=names)
    return out.astype({c: "Int64" for c in ("first_word", "last_word")})


def with_licenses(docs: DataFrame, out: str = "license") -> DataFrame:
    """``docs`` with a struct of what was found in the whole text."""
    return docs.withColumn(out, F.pandas_udf(_scan, RESULT)(filled("text")))


def license_scan(docs: DataFrame) -> DataFrame:
    return with_licenses(docs.select("doc_id", "text"), "found").select("doc_id", "found.*")
