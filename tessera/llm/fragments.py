"""Texts cut where no token of a public vocabulary can cross, and the tokenizer's answers for the fragments.

A byte-level vocabulary's pattern lets white space only begin a token, so one begins at every single space between two
characters that are no white space; a piece vocabulary is cut there where no piece holds a space after another
character. What lies between such spaces is a fragment: it is encoded alone, with the space before it, and the answers
are put together. Vocabularies for which this isn't certain by their settings get whole texts.

Fragments repeat across documents, so a worker remembers their answers, bounded in bytes; what it doesn't know goes to
the library in batches of like bytes. Long texts are cut into windows at such spaces first, so that a task holds the
fragments of one window at a time, whatever a text's length.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.bpe import MAX_VOCABULARY_BYTES, byte_symbols

#: Bytes of text that are handled together, bytes of a batch for the library, and characters of a long text's window.
SLICE_BYTES, BATCH_BYTES, WINDOW_CHARS = 4 << 20, 1 << 18, 1 << 20
#: Bytes, roughly, that a worker's memo holds at most, and that an entry takes beside its key and value.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 120
#: A single space between two characters that are no white space.
_CUT = re.compile(r" (?<=\S )(?=\S)")
#: The sign for a space in a piece vocabulary.
MARK = "▁"


def windows(text: str, chars: int) -> Iterator[str]:
    """The text in parts of about `chars` characters; each but the first had a space before it, at which it was cut."""
    at = 0
    while len(text) - at > chars and (m := _CUT.search(text, at + chars)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def by_bytes(b: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes; a longer text is a slice of its own."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
        if held and held + n > limit:
            yield b.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < b.num_rows:
        yield b.slice(begin)


def balanced(texts: list[str], limit: int) -> Iterator[list[str]]:
    """The texts in as few batches as `limit` characters each allow, of like sizes."""
    total = sum(map(len, texts))
    share = total / -(-total // limit) if total else 1
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += len(t)
        if held >= share:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Known(dict):
    """Answers for texts, remembered up to so many bytes; `answer` takes a list of unknown texts, an entry holds about so many bytes beside its text."""

    def __init__(self, answer: Callable[[list[str]], list], limit: int = MEMO_BYTES, entry: int = ENTRY_BYTES):
        super().__init__()
        self.answer, self.limit, self.entry, self.held = answer, limit, entry, 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def learn(self, texts: set[str]) -> None:
        """Afterwards every one of the texts has its answer here; what was known before may be gone."""
        new = [t for t in texts if t not in self]
        cost = lambda x: sum(map(len, x)) + self.entry * len(x)
        if self and self.held + cost(new) > self.limit:
            self.forget()
            new = list(texts)
        for batch in balanced(new, BATCH_BYTES):
            self.update(zip(batch, self.answer(batch), strict=True))
        self.held += cost(new)


def token_lengths(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


def split_ids(vocabulary: ByteLevel | Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text after a space, put together, and where each text's begin and end.

    Texts between whose ends a cut is certain are encoded as one; where the tokens' bytes tell their ends, each has its
    own. The others are encoded one by one.
    """
    smooth = [i for i, t in enumerate(texts) if t and not t[0].isspace() and not t[-1].isspace()]
    if not vocabulary.cuts or any(MARK in t for t in texts):
        smooth = [i for i in smooth if vocabulary.cuttable(texts[i])]
    size = np.full(len(texts), -1, np.int64)
    parts: list[tuple[list[int], np.ndarray]] = []
    for some in vocabulary.alike(texts, smooth):
        ids = vocabulary.joined([texts[i] for i in some])
        ends = np.cumsum(vocabulary.length[ids])
        want = np.cumsum([1 + (len(t) if t.isascii() else len(t.encode("utf-8"))) for t in map(texts.__getitem__, some)])
        at = np.searchsorted(ends, want)
        if len(ends) and at[-1] < len(ends) and (ends[at] == want).all():
            size[some] = np.diff(at, prepend=-1)
            parts.append((some, ids))
    if len(rest := np.flatnonzero(size < 0).tolist()):
        found = vocabulary.after_space([texts[i] for i in rest])
        size[rest] = [len(x) for x in found]
        parts.append((rest, np.array([i for x in found for i in x], np.int64)))
    edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.empty(int(edges[-1]), np.int64)
    for some, ids in parts:
        n = size[some]
        out[np.repeat(edges[some] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
    return out, edges


#: Characters below this one have had their classes in all versions that the libraries use.
SETTLED = "\u0250"


class ByteLevel:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, spec: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain_specials
        d = json.loads(spec)
        split = d.get("pre_tokenizer") or {}
        whole = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"])
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.cuts = bool(plain and not whole and d.get("normalizer") is None and d["model"]["type"] == "BPE")
        self.special = [t["content"] for t in d["added_tokens"] if not plain_specials]
        of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        known = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(known.values(), default=-1) + 1)
        for token, i in known.items():
            self.bytes[i] = b"".join(of[c] for c in token) if all(c in of for c in token) else token.encode("utf-8")
        self.length = token_lengths(self.bytes)
        self.quick = self.by_ranks(d["model"]["vocab"], d["model"]["merges"]) if self.cuts else None

    def by_ranks(self, vocab: dict[str, int], merges: list):
        """The same vocabulary in the tiktoken library, which is quicker; None if its ids aren't in the order of its merges."""
        import public_tokenizers
        from tiktoken import Encoding

        singles = byte_symbols()
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        first = min((vocab[m] for m in made), default=0)
        if [vocab[m] for m in made] != list(range(first, first + len(made))) or not all(c in singles for t in vocab for c in t) or any(vocab.get(s, first) >= first for s in singles):
            return None
        return Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={}).encode_to_numpy

    def cuttable(self, text: str) -> bool:
        return self.cuts

    def settled(self, text: str) -> bool:
        """Whether ranks give the same ids: the characters' classes are settled, and no special token is in it."""
        return self.quick is not None and (text.isascii() or max(text) < SETTLED) and not any(s in text for s in self.special)

    def alike(self, texts: list[str], of: list[int]) -> Iterator[list[int]]:
        """The given texts' numbers, those that go by ranks apart from those for the library."""
        if self.settled("".join(texts)):
            parts = [of]
        else:
            parts = [[], []]
            for i in of:
                parts[self.settled(texts[i])].append(i)
        yield from filter(None, parts)

    def joined(self, texts: list[str]) -> np.ndarray:
        """The ids of texts alike, each after a space, as one text."""
        text = " " + " ".join(texts)
        if self.settled(texts[0]):
            return self.quick(text, disallowed_special=()).astype(np.int64)
        return np.array(self.encoded([text])[0].ids, np.int64)

    def encoded(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def after_space(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoded([" " + t for t in texts])]


class Pieces:
    """A piece vocabulary in the sentencepiece library's form."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = lib = SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        n, t = spec.normalizer_spec, spec.trainer_spec
        inner = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        user = any(p.type == p.USER_DEFINED for p in spec.pieces)
        merges = t.model_type == t.BPE  # others weigh a whole text's pieces against each other
        self.cuts = not inner and not user and merges and n.add_dummy_prefix and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not t.treat_whitespace_as_suffix
        self.bytes = [bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(MARK, " ").encode("utf-8") for i in range(lib.vocab_size())]
        self.length = token_lengths(self.bytes)

    def cuttable(self, text: str) -> bool:
        """A text's own marks are spaces to the library."""
        return self.cuts and MARK not in text

    def alike(self, texts: list[str], of: list[int]) -> Iterator[list[int]]:
        yield from filter(None, [of])

    def joined(self, texts: list[str]) -> np.ndarray:
        return np.array(self.library.encode(" ".join(texts), num_threads=1), np.int64)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    #: The library itself puts a space before each text.
    after_space = encoded


def load(name: str, data: bytes, plain_specials: bool = False) -> ByteLevel | Pieces:
    return Pieces(data) if name.endswith(".model") else ByteLevel(data.decode("utf-8"), plain_specials)


def fragments(text: str) -> list[str]:
    return _CUT.split(text)


def shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary file's bytes on all executors; path is on the driver."""
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


_loaded: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """What a worker makes once and keeps for later tasks, one at a time."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


def counter(name: str, data: bytes) -> Counter:
    return once(("counter", name, hash(data)), partial(Counter, name, data))


class Counter:
    """Numbers of tokens of whole texts."""

    def __init__(self, name: str, data: bytes, limit: int = MEMO_BYTES):
        self.vocabulary = load(name, data)
        self.inner = Known(lambda x: np.diff(split_ids(self.vocabulary, x)[1]).tolist(), limit)

    def count(self, texts: list[str]) -> list[int]:
        # whole is what goes to the library as it is: beginnings, which have no space before them, and uncut texts
        whole, rest, owner, held, found = [], [], [], 0, [0] * len(texts)

        def settle():
            self.inner.learn({f for r in rest for f in r})
            get = self.inner.__getitem__
            for i, r in zip(owner, rest):
                found[i] += sum(map(get, r))
            rest.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if not self.vocabulary.cuttable(text):
                whole.append(text)
                continue
            for k, part in enumerate(windows(text, WINDOW_CHARS)):
                cut = fragments(part)
                if k == 0:
                    whole.append(cut[0])
                    cut = cut[1:]
                rest.append(cut)
                owner.append(i)
                held += len(part)
                if held > WINDOW_CHARS:
                    settle()
                    held = 0
        settle()
        begun = (len(e) for batch in balanced(whole, BATCH_BYTES) for e in self.vocabulary.encoded(batch))
        return [a + b for a, b in zip(found, begun, strict=True)]
