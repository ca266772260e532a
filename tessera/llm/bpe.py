"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of neighbouring symbols that occurs inside no vocabulary token can never be joined by any merge, so a
word may be cut between them for certain; the fragments are encoded independently and their ids concatenated.
Words and fragments repeat across documents, so each worker keeps a memo of both, bounded in bytes.

Defined cases: a null text is the empty text and has no ids; long texts are encoded whole; equal texts give equal
ids; an empty table gives an empty table; columns of the input other than the output's pass through unchanged,
and an input column named like the output is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, with_columns

#: Upper bound of a vocabulary file that is broadcast to the executors, in bytes.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes, roughly, that a worker's memos of words and of fragments hold at most, and that an entry takes beside its parts.
WORD_BYTES, FRAGMENT_BYTES, ENTRY_BYTES = 28 << 20, 6 << 20, 150
#: Symbols of a fragment up to which pairs are joined one by one, not in passes.
SHORT = 64
_SPACE = regex.compile(r"\p{White_Space}+")
_CONTROLS = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable Latin-1, else the next code point from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Memo(dict):
    """A dictionary of text keys that computes missing values and starts anew when it holds too many bytes."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.held = compute, limit, 0

    def __missing__(self, key):
        value = self.compute(key)
        size = ENTRY_BYTES + len(key) + len(value)
        if size > self.limit // 64:
            return value  # a giant isn't worth its room
        self.held += size
        if self.held > self.limit:
            self.clear()
            self.held = size
        self[key] = value
        return value


class WordBpe:
    """A word-level BPE vocabulary in the tokenizers library's JSON form: NFC, lower case, white space dropped, end-of-word suffix."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.symbols = byte_symbols()
        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # what begins no special token needs no search for one
        self.marks = {t[0] for t in self.special}
        # the pairs inside tokens, with their rank if they are joined
        self.never = len(self.ranks)
        self.inside: dict[tuple[str, str], int] = {}
        for token in self.vocab:
            parts = self._symbols(token)
            for pair in zip(parts, parts[1:]):
                if pair not in self.inside:
                    self.inside[pair] = self.ranks.get(pair, self.never)
        self.word_ids = Memo(self._word, WORD_BYTES)
        self.fragment_ids = Memo(self._fragment, FRAGMENT_BYTES)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*token]

    def _parts(self, word: str) -> list[str]:
        """The word's byte symbols, the last with the suffix."""
        parts = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        return parts

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        """The word's byte symbols, cut wherever no token has the pair inside."""
        parts = self._parts(word)
        cuts = [0, *(i for i in range(1, len(parts)) if (parts[i - 1], parts[i]) not in self.inside), len(parts)]
        return [tuple(parts[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _word(self, run: str) -> bytes:
        out = []
        for word in self.words.findall(run):
            parts = self._parts(word)
            order = [self.inside.get(p, -1) for p in zip(parts, parts[1:])]
            if -1 not in order:
                out.append(self._merge(parts, order))
                continue
            cuts = [0, *(i for i, r in enumerate(order, 1) if r == -1), len(parts)]
            out += [self.fragment_ids["\x00".join(parts[a:b])] for a, b in zip(cuts, cuts[1:])]
        return b"".join(out)

    def _fragment(self, key: str) -> bytes:
        parts = key.split("\x00")
        return self._merge(parts, [self.inside[p] for p in zip(parts, parts[1:])])

    def _merge(self, parts: list[str], order: list[int]) -> bytes:
        """The pair of lowest rank is joined, of equal ones the first, until none is left; order: the pairs' ranks."""
        if len(parts) > SHORT:
            parts = self._passes(parts)
        else:
            rank, never = self.ranks.get, self.never
            while order and (best := min(order)) < never:
                at = order.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del order[at]
                if at:
                    order[at - 1] = rank((parts[at - 1], parts[at]), never)
                if at < len(order):
                    order[at] = rank((parts[at], parts[at + 1]), never)
        return array("I", [self.vocab[p] for p in parts if p in self.vocab]).tobytes()

    def _passes(self, parts: list[str]) -> list[str]:
        """The same for long fragments: a pass joins a pair everywhere, left to right; what it makes ranks higher."""
        rank, never = self.ranks.get, self.never
        while len(parts) > 1:
            order = [rank(p, never) for p in zip(parts, parts[1:])]
            best = min(order)
            if best == never:
                break
            joined, at, last = [], 0, len(parts) - 1
            while at <= last:
                both = at < last and order[at] == best
                joined.append(parts[at] + parts[at + 1] if both else parts[at])
                at += 1 + both
            parts = joined
        return parts

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # Python splits at four control characters more than the pattern of white space does
        runs = _SPACE.split(text.lower()) if _CONTROLS.search(text) else text.lower().split()
        known, words, out = self.word_ids, self.words.findall, []
        for r in runs:
            # no word goes beyond a run, as the words' pattern matches no white space
            if r.isalpha():
                out.append(known[r])
            else:
                out += [known[w] for w in words(r)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.specials.split(text) if p)


class Tokens:
    """The text of each id."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        known = {i: t for t, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.tokens = [known.get(i) for i in range(max(known, default=-1) + 1)]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the library does without a decoder; unknown ids are left out."""
        tokens, n = self.tokens, len(self.tokens)
        found = [tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]
        return " ".join([t for t in found if t is not None] if None in found else found)


class Codec:
    """Both directions of a vocabulary; each part is made when it is first asked for."""

    def __init__(self, spec: str):
        self.spec = spec

    @cached_property
    def bpe(self) -> WordBpe:
        return WordBpe(self.spec)

    @cached_property
    def tokens(self) -> Tokens:
        return Tokens(self.spec)


def _vocabulary(df: DataFrame, path: str):
    spec = Path(path).read_text(encoding="utf-8")
    if len(spec.encode("utf-8")) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(spec)


_loaded: dict[str, Codec] = {}


def _codec(spec: str) -> Codec:
    """The worker's codec, one vocabulary at a time."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = Codec(spec)
    return _loaded[spec]


def _out(df: DataFrame, drop: tuple[str, ...], new: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in (*drop, *new)] + [T.StructField(n, k) for n, k in new.items()])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """df with a binary column of ids (little-endian uint32); vocabulary is the tokenizer file's path on the driver."""
    shared = _vocabulary(df, vocabulary)
    schema = _out(df, () if keep_text else (text,), {ids: T.BinaryType()})

    def run(b: pa.RecordBatch):
        bpe = _codec(shared.value).bpe
        t = with_columns(b, **{ids: pa.array([bpe.encode(x or "") for x in b.column(text).to_pylist()], pa.binary())})
        return t.select(schema.names)

    return arrow_map(df, schema, run)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its binary id column; null ids give the empty text."""
    shared = _vocabulary(df, vocabulary)
    schema = _out(df, (), {text: T.StringType()})

    def run(b: pa.RecordBatch):
        tokens = _codec(shared.value).tokens
        t = with_columns(b, **{text: pa.array([tokens.decode(x or b"") for x in b.column(ids).to_pylist()], pa.string())})
        return t.select(schema.names)

    return arrow_map(df, schema, run)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df without its text, with the ids and the text decoded from them: one pass, one Python worker a core."""
    shared = _vocabulary(df, vocabulary)
    schema = _out(df, (text,), {ids: T.BinaryType(), decoded: T.StringType()})

    def run(b: pa.RecordBatch):
        codec = _codec(shared.value)
        found = [codec.bpe.encode(x or "") for x in b.column(text).to_pylist()]
        t = with_columns(b, **{ids: pa.array(found, pa.binary()), decoded: pa.array([codec.tokens.decode(x) for x in found], pa.string())})
        return t.select(schema.names)

    return arrow_map(df, schema, run)
