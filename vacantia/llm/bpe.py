"""Byte-pair encoding and decoding by dynamic programming over prefixes.

Merging pairs in order of rank gives every prefix of a piece exactly one last token. That token is found without merging:
an automaton of the whole vocabulary lists, for each prefix, the tokens that are its suffixes; the one that follows the
last token of the shorter prefix in a compatible pair is the last token of this prefix. Back-pointers from the full
length give the ids. Time is linear in the length of a piece, however long it is.

Two tokens are a compatible pair if merging never joins them across the border. Around the border, the left token passes
through the right spine of its merge tree and the right token through the left spine of its own. A merge of a node of
one with a node of the other happens if its rank comes before the node on the left is merged into its parent, and not
after the node on the right is (equal ranks are merged from left to right).

Vocabulary, normaliser and splitting rule come from the tokenizer's file, read once on the driver and sent to the workers (a
few MB, independent of the data). Null texts count as empty: no ids, the empty text. Pieces repeat, so each worker
keeps the ids of those it has met last, up to twice ``KNOWN_PIECES``; that only saves time. Other columns pass through untouched.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vacantia.llm.common import filled

KNOWN_PIECES = 250_000  # of each of two generations
KNOWN_PAIRS = 1_000_000
IDS_HELD = 1 << 18
PIECE_CHARS = 64  # longer pieces aren't kept
NEVER = 1 << 60

# Fixed value: the splitting rule of the public word-level tokenizer file.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Below this character every text is in composed form, and lower case stays below it (but for one character).
LATIN_END = 0x180
_BEYOND = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]|\u0130")


def latin_pieces() -> re.Pattern[str]:
    """The same rule for lower-case text of characters below ``LATIN_END``, as plain character classes."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": []}
    for c in map(chr, range(LATIN_END)):
        kind = "Z" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind].append(re.escape(c))
    letters, numbers, spaces = ("".join(kinds[k]) for k in "LNZ")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """Results of a function by its argument: those asked for last, in two generations of ``KNOWN_PIECES``."""

    def __init__(self, of: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.of, self.earlier = of, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        found = self.earlier.get(key)
        if found is None:
            found = self.of(key)
        if len(key) <= PIECE_CHARS:
            if len(self) >= KNOWN_PIECES:
                self.earlier = dict(self)
                self.clear()
            self[key] = found
        return found


class PrefixBpe:
    """Encoder of a tokenizer file whose model is BPE; what it can't express is refused."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        unlike = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)}
        if model["type"] != "BPE" or unlike:
            raise ValueError(f"not a plain BPE model: {model['type']} {unlike}")
        if spec.get("decoder"):
            raise ValueError("only tokenizers without a decoder of their own are decoded")
        # Normalising and splitting into pieces are the file's own rules, run by the library that defines them.
        rules = Tokenizer.from_str(source)
        self.normalize = rules.normalizer.normalize_str if rules.normalizer else lambda text: text
        self.split = rules.pre_tokenizer.pre_tokenize_str if rules.pre_tokenizer else lambda text: [(text, (0, len(text)))]
        # Western texts are split by plain classes of the same rule, which is several times faster.
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        usual = parts[0].get("pattern") == {"Regex": WORD_RULE} and parts[0].get("invert") and [x["type"] for x in parts[1:]] == ["ByteLevel"]
        self.latin = latin_pieces() if usual and steps == ["NFC", "Replace", "Lowercase"] else None
        self.letters = byte_letters()
        self.added = sorted(((a["content"], a["id"]) for a in spec["added_tokens"]), key=lambda x: -len(x[0]))
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("only added tokens that are matched as they stand are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.text_of = {i: t for t, i in chain(self.vocab.items(), self.added)}
        self._trees(model["merges"])
        self._automaton()
        self.words, self.pieces = Remembered(self.encode_word), Remembered(self.encode_piece)
        self.pairs: dict[int, bool] = {}

    def _trees(self, merges: list) -> None:
        """Merge of each token, rank of each pair, and symbols of each token that merging can reach."""
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        self.symbols: dict[int, str] = {}
        last = chr(0x10FFFF)  # a last symbol is another symbol than the same character inside a piece
        for token, i in self.vocab.items():
            inner = token.removesuffix(self.end) if self.end else token
            if len(token) == 1:
                self.symbols[i] = token
            elif self.end and len(inner) == 1 and inner != token:
                self.symbols[i] = inner + last
        for r, merge in enumerate(merges):
            a, b = (self.vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = self.vocab[(merge if isinstance(merge, str) else "".join(merge)).replace(" ", "")]
            self.rank[a, b] = r
            if a in self.symbols and b in self.symbols and whole not in self.made and self._compatible_but_for(a, b, r):
                self.made[whole] = (r, a, b)
                self.symbols[whole] = self.symbols[a] + self.symbols[b]
        self.last = last

    def _compatible_but_for(self, a: int, b: int, r: int) -> bool:
        """Whether merging reaches the pair before its own merge, of rank ``r``."""
        return self._joined_at(a, b) == r

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The nodes at one edge of a token's merge tree, each with the rank at which it is merged into the next."""
        out = [(token, NEVER)]
        while token in self.made:
            r, token = self.made[token][0], self.made[token][1 + side]
            out.append((token, r))
        return out

    def _joined_at(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of two tokens, or ``NEVER``."""
        right = self._spine(b, 0)
        first = NEVER
        for u, up_u in self._spine(a, 1):
            for v, up_v in right:
                r = self.rank.get((u, v), NEVER)
                if r < up_u and r <= up_v and r < first:
                    first = r
        return first

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        return self._test(a, b) if known is None else known

    def _test(self, a: int, b: int) -> bool:
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        fits = self.pairs[a << 32 | b] = self._joined_at(a, b) == NEVER
        return fits

    def _automaton(self) -> None:
        self.whole = {symbols: i for i, symbols in self.symbols.items()}
        self.suffixes = ahocorasick.Automaton()
        for i, symbols in self.symbols.items():
            # The symbols of a token, so that the offset of a match's last symbol tells where it starts.
            self.suffixes.add_word(symbols, (len(symbols), i))
        self.suffixes.make_automaton()

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the unique last token of each prefix, then back from the end."""
        symbols = piece + self.last if self.end else piece
        whole = self.whole.get(symbols)
        if whole is not None:
            return (whole,)  # a token is the last one of its own text
        size = len(symbols)
        token = [-1] * (size + 1)
        start = [0] * (size + 1)
        pairs = self.pairs
        found = 0  # the longest prefix whose last token is known; matches come by their end
        for at, (length, i) in self.suffixes.iter(symbols):
            if at < found:
                continue
            begin = at + 1 - length
            if begin:
                before = token[begin]
                if before < 0:
                    continue
                fits = pairs.get(before << 32 | i)
                if not (self._test(before, i) if fits is None else fits):
                    continue
            found = at + 1
            token[found], start[found] = i, begin
        out = []
        at = size
        while at:
            if token[at] < 0:
                raise ValueError("a piece holds a symbol that the vocabulary lacks")
            out.append(token[at])
            at = start[at]
        return tuple(reversed(out))

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word as it stands in a text; visible ASCII letters stand for themselves."""
        if word.isascii() and word.isprintable():
            return self.encode_piece(word)
        letters = self.letters
        return self.encode_piece("".join([letters[b] for b in word.encode()]))

    def _plain(self, text: str, out: list[int]) -> None:
        if self.latin is not None and (text.isascii() or not _BEYOND.search(text)):
            out.extend(chain.from_iterable(map(self.words.__getitem__, self.latin.findall(text.lower()))))
        else:
            out.extend(chain.from_iterable([self.pieces[piece] for piece, _ in self.split(self.normalize(text))]))

    def encode(self, text: str, out: list[int] | None = None) -> list[int]:
        """Ids of a text, added to ``out``; added tokens are found in the text as it stands, what lies between is encoded."""
        out = [] if out is None else out
        at = 0
        while True:
            near = min(((p, -len(c), c, i) for c, i in self.added if (p := text.find(c, at)) >= 0), default=None)
            if near is None:
                self._plain(text[at:], out)
                return out
            self._plain(text[at : near[0]], out)
            out.append(near[3])
            at = near[0] + len(near[2])

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens of the ids, separated by a space each; unknown ids are left out."""
        try:
            return " ".join(map(self.text_of.__getitem__, ids))
        except KeyError:
            return " ".join([t for i in ids if (t := self.text_of.get(i)) is not None])


_LOADED: dict[str, PrefixBpe] = {}


def _loaded(shared: Broadcast) -> PrefixBpe:
    """Built once per Python worker; only the last one stays."""
    key, source = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixBpe(source)
    return _LOADED[key]


def _encoded(bpe: PrefixBpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where those of each text begin and end."""
    flat: list[int] = []
    full: list[np.ndarray] = []  # ids as numbers of four bytes, moved there before the list grows long
    sizes = [0]
    for text in texts:
        before = len(flat)
        bpe.encode(text.as_py(), flat)
        sizes.append(len(flat) - before)
        if len(flat) >= IDS_HELD:
            full.append(np.array(array("i", flat)))
            flat.clear()
    return np.concatenate([*full, np.array(array("i", flat), np.int32)]), np.cumsum(sizes)


class Codec:
    """Columns that encode texts and decode ids with one tokenizer file.

    Python functions that use each other's columns may be run once for every use: take :meth:`round_trip` where both ways
    are wanted.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            shared = spark.sparkContext.broadcast((uuid.uuid4().hex, f.read()))

        @F.arrow_udf("array<int>")
        def encoded(texts: pa.Array) -> pa.Array:
            ids, ends = _encoded(_loaded(shared), texts)
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

        @F.arrow_udf("string")
        def decoded(ids: pa.Array) -> pa.Array:
            bpe = _loaded(shared)
            return pa.array((bpe.decode(np.asarray(x.values).tolist()) if x.is_valid else "" for x in ids), pa.string())

        @F.arrow_udf("struct<n_tokens: bigint, packed: binary, decoded: string>")
        def both(texts: pa.Array) -> pa.Array:
            bpe = _loaded(shared)
            ids, ends = _encoded(bpe, texts)
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array((x.astype("<u4").tobytes() for x in parts), pa.binary()),
                pa.array((bpe.decode(np.frombuffer(x.astype("<u4").tobytes(), "<u4").tolist()) for x in parts), pa.string()),
            ]
            return pa.StructArray.from_arrays(columns, names=["n_tokens", "packed", "decoded"])

        self._encoded, self._decoded, self._both = encoded, decoded, both

    def encode(self, text: Column | str) -> Column:
        return self._encoded(filled(text))

    def decode(self, ids: Column | str) -> Column:
        return self._decoded(ids)

    def round_trip(self, text: Column | str) -> Column:
        """Struct of the number of ids, the ids as little-endian unsigned 32-bit numbers, and the text decoded from these."""
        return self._both(filled(text))


def _packed(ids: pa.Array) -> pa.Array:
    return pa.array((np.asarray(x.values, "<u4").tobytes() if x.is_valid else b"" for x in ids), pa.binary())


def packed(ids: Column | str) -> Column:
    """Ids as little-endian unsigned 32-bit numbers."""
    return F.arrow_udf(_packed, "binary")(ids)
