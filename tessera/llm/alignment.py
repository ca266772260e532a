"""Alignment of the tokens that two tokenizers make of the same texts.

Both sides' tokens cover the bytes of a space and the text. In each slice of documents pandas.merge_asof, keyed by
document, finds for every token's start the other side's token that covers it; both directions together give all
overlaps. Overlaps that end together are links; the bytes where they end cut the tokens into groups.

How often an id pair is linked is counted over all documents: a slice adds up its own pairs, Spark the slices'. The
sums go back to the slices whose documents hold the pair, so no task or driver ever holds the whole table, and tokens
are never rows: a document's links are codes of its slice's pairs, written once and met by the sums slice by slice.
Rows are documents and pairs, so whatever a reader, a sort or a task holds at a time is one slice or less, however
many slices it goes through.

Encoding goes by fragments between spaces that no token of either side crosses, see fragments.

Defined cases: texts that are null or empty, or whose tokens' bytes on either side differ from a space and the text
(for instance where a text holds the piece vocabulary's own sign for a space), have no tokens: zeros and empty groups;
long texts are aligned whole, a document being the least unit of a slice; equal texts have equal tokens and groups;
rows that repeat an id, or have none, are documents of their own, and each copy counts; a pair's count equal to the
highest of its second id is best, ties included; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import give_back, materialise, small_batches
from tessera.llm.fragments import ENTRY_BYTES, ByteLevel, Known, Pieces, by_bytes, fragments, load, once, shared_vocabulary, split_ids, windows

#: Bytes of text of a slice, whose pairs are added up together; bits of an id in a pair's key.
SLICE_BYTES, ID_BITS = 4 << 20, 31
#: Bytes, roughly, of the fragments that a worker remembers; bytes of text that are aligned together.
MEMO_BYTES, TOGETHER_BYTES = 64 << 20, 1 << 19
#: Characters of a text whose fragments are looked up together.
WINDOW_CHARS = 1 << 20
#: What follows a token in a document's groups: another of its side, the other side, the next group, nothing.
_SIGNS = [b",", b"|", b";", b""]


class Side:
    """One tokenizer: the ids of fragments, the bytes of ids, and how ids are written in a document's groups."""

    def __init__(self, vocabulary: ByteLevel | Pieces):
        self.vocabulary, self.bytes, self.length = vocabulary, vocabulary.bytes, vocabulary.length
        width = len(str(len(self.bytes))) + 1
        shown = [f"{i}".encode() + s for i in range(len(self.bytes)) for s in _SIGNS]
        self.shown = np.array(shown, f"S{width}").view(np.uint8).reshape(len(shown), width)
        self.shown_length = np.array([len(s) for s in shown], np.int64)

    def answer(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text after a space; None where their bytes aren't the space and the text."""
        ids, edges = split_ids(self.vocabulary, texts)
        want = [b" " + t.encode("utf-8") for t in texts]
        data = ids.astype("<u4").tobytes()
        out: list[bytes | None] = [data[4 * a : 4 * b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        lengths = np.diff(np.concatenate([[0], np.cumsum(self.length[ids])])[edges])
        if b"".join([self.bytes[i] for i in ids.tolist()]) != b"".join(want) or lengths.tolist() != list(map(len, want)):
            made = lambda o: b"".join([self.bytes[i] for i in np.frombuffer(o, "<u4").tolist()])
            out = [o if made(o) == w else None for o, w in zip(out, want)]
        return out


class Aligner:
    """Two tokenizers over the same texts."""

    def __init__(self, one: ByteLevel | Pieces, two: ByteLevel | Pieces, limit: int = MEMO_BYTES):
        self.sides = [Side(one), Side(two)]
        self.known = Known(lambda texts: list(zip(*(s.answer(texts) for s in self.sides))), limit, ENTRY_BYTES + 180)

    def encoded(self, texts: list[str]) -> list[list[bytes] | None]:
        """The ids of a space and each text on both sides; None where they don't give its bytes. No text, no tokens."""
        found: list[list[list[bytes]] | None] = [[[], []] if t else None for t in texts]
        waiting, held = [], 0

        def settle():
            self.known.learn({f for _, cut in waiting for f in cut})
            for i, cut in waiting:
                if found[i] is not None:
                    got = [self.known[f] for f in cut]
                    one, two = [x for x, _ in got], [x for _, x in got]
                    if None in one or None in two:
                        found[i] = None
                    else:
                        found[i][0].append(b"".join(one))
                        found[i][1].append(b"".join(two))
            waiting.clear()

        for i, text in enumerate(texts):
            if text:
                whole = not all(s.vocabulary.cuttable(text) for s in self.sides)
                for part in [text] if whole else windows(text, WINDOW_CHARS):
                    waiting.append((i, [part] if whole else fragments(part)))
                    held += len(part)
                    if held > WINDOW_CHARS:
                        settle()
                        held = 0
        settle()
        return [f and [b"".join(x) for x in f] for f in found]

    def aligned(self, texts: list[str]) -> dict:
        """Of a slice's texts: the numbers of tokens, groups and links of each, its groups' digest, its links as pairs."""
        found = self.encoded(texts)
        some = np.array([i for i, f in enumerate(found) if f], np.int64)
        ids = [np.frombuffer(b"".join(f[k] for f in found if f), "<u4").astype(np.int64) for k in (0, 1)]
        n = [np.array([len(f[k]) // 4 if f else 0 for f in found], np.int64) for k in (0, 1)]
        ends = [np.cumsum(s.length[x]) for s, x in zip(self.sides, ids)]
        doc = [np.repeat(some, m[some]) for m in n]
        starts = [e - s.length[x] for e, s, x in zip(ends, self.sides, ids)]
        a, b = overlaps(starts, doc)
        together = np.flatnonzero(ends[0][a] == ends[1][b])
        together = together[np.argsort(a[together])]
        link = [a[together], b[together]]
        out = {"n_a": n[0], "n_b": n[1], "n_links": np.bincount(doc[0][link[0]], minlength=len(texts))}
        last = [np.zeros(len(x), bool) for x in ids]
        last[0][link[0]] = True
        last[1][link[1]] = True
        out["n_groups"] = np.bincount(doc[0][last[0]], minlength=len(texts))
        out["digests"] = self.digests(ids, n, last, len(texts))
        out["pairs"] = (ids[0][link[0]] << ID_BITS) | ids[1][link[1]]
        return out

    def digests(self, ids: list[np.ndarray], n: list[np.ndarray], last: list[np.ndarray], docs: int) -> list[str]:
        """SHA-256 of each document's groups as text; the empty text for documents without tokens."""
        a, b = (np.cumsum(x) - x for x in last)  # the group of each token
        groups = int(last[0].sum())
        size_a, size_b = np.bincount(a, minlength=groups), np.bincount(b, minlength=groups)
        # a group's tokens of both sides follow each other
        at = [np.arange(len(a)) + (np.cumsum(size_b) - size_b)[a], np.arange(len(b)) + np.cumsum(size_a)[b]]
        sign = [np.where(last[0], 1, 0), np.where(last[1], 2, 0)]
        final = np.cumsum(n[1])[n[1] > 0] - 1
        sign[1][final] = 3
        width = max(s.shown.shape[1] for s in self.sides)
        chars = np.zeros((len(a) + len(b), width), np.uint8)
        length = np.zeros(len(chars), np.int64)
        for s, x, where, mark in zip(self.sides, ids, at, sign):
            code = x * len(_SIGNS) + mark
            chars[where, : s.shown.shape[1]] = s.shown[code]
            length[where] = s.shown_length[code]
        flat = chars[chars != 0].tobytes()
        edges = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n[0] + n[1])])].tolist()
        view = memoryview(flat)
        return [hashlib.sha256(view[x:y]).hexdigest() if x < y else "" for x, y in zip(edges, edges[1:])]


def overlaps(starts: list[np.ndarray], doc: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens of the two sides that share bytes, each once. Starts count on from document to document."""
    a, b = (pd.DataFrame({"start": s, "doc": d, "token": np.arange(len(s))}) for s, d in zip(starts, doc))
    ab = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
    ba = pd.merge_asof(b, a, on="start", by="doc", suffixes=("_b", "_a"))
    # tokens that start together were found from the first side
    ba = ba[starts[0][ba["token_a"].to_numpy()] != ba["start"].to_numpy()]
    return tuple(np.concatenate([ab[c].to_numpy(), ba[c].to_numpy()]).astype(np.int64) for c in ("token_a", "token_b"))


#: What is known of each document in its slice; the rest of a row's columns is of pairs.
_PER_DOC = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}
_OF_PAIR = {"code": T.IntegerType(), "pair": T.LongType(), "n": T.LongType()}


def slices(docs: DataFrame, one: str, two: str, doc_id: str, text: str) -> DataFrame:
    """(slice, id, n_a, n_b, n_groups, n_links, groups_sha256, codes) of each document, codes numbering its links' pairs in their order, and (slice, code, pair, n) of each pair of a slice."""
    shared = [shared_vocabulary(docs, p) for p in (one, two)]
    of_doc = [T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(k, v) for k, v in _PER_DOC.items()), T.StructField("codes", T.BinaryType())]
    schema = T.StructType([T.StructField("slice", T.LongType()), *of_doc, *(T.StructField(k, v) for k, v in _OF_PAIR.items())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [s.value for s in shared]
        aligner = once(("aligner", one, two, *map(hash, data)), lambda: Aligner(*(load(p, d, plain_specials=True) for p, d in zip((one, two), data))))
        number, held, size = TaskContext.get().partitionId() << 40, [], 0

        def rows(own: dict, n: int) -> pa.RecordBatch:
            own["slice"] = np.full(n, number)
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in own else own[f.name].cast(f.type) if isinstance(own[f.name], pa.Array) else pa.array(own[f.name], f.type) for f in target], schema=target)

        def settled() -> Iterator[pa.RecordBatch]:
            pairs, codes, counts = np.unique(np.concatenate([x["pairs"] for x in held]), return_inverse=True, return_counts=True)
            codes = codes.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            own = {k: np.concatenate([x[k] for x in held]) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [d for x in held for d in x["digests"]]}
            own |= {"id": pa.concat_arrays([x["ids"] for x in held]), "codes": binaries(codes, own["n_links"])}
            yield rows(own, len(own["id"]))
            yield rows({"code": np.arange(len(pairs)), "pair": pairs, "n": counts}, len(pairs))

        for b in batches:
            for part in by_bytes(b, text, TOGETHER_BYTES):
                texts = [t or "" for t in part.column(text).to_pylist()]
                held.append(aligner.aligned(texts) | {"ids": part.column(doc_id)})
                size += sum(map(len, texts))
                if size >= SLICE_BYTES:
                    yield from settled()
                    number, held, size = number + 1, [], 0
                    give_back()  # what the slice's arrays took isn't kept beside the next one's
        if held:
            yield from settled()
            held.clear()
        aligner.known.forget()  # the worker lives on beside those of later stages
        give_back()

    return small_batches(docs.select(doc_id, text)).mapInArrow(run, schema)


def binaries(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """The values' bytes, the first n[0] of them in the first row and so on."""
    edges = np.concatenate([[0], np.cumsum(n)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def summed(links: pa.Array, n: np.ndarray, code: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """For each document the sums of the values of its links; links: each one's codes as bytes, n how many these are; values go by code."""
    links = links.cast(pa.large_binary())
    _, offsets, data = links.buffers()
    low, high = np.frombuffer(offsets, np.int64)[[links.offset, links.offset + len(links)]]
    total = int(n.sum())
    kind = np.dtype("<u2" if high - low == 2 * total else "<u4")
    codes = np.frombuffer(data, kind, total, int(low)) if total else np.empty(0, kind)
    edges, out = np.concatenate([[0], np.cumsum(n)]), []
    for v in values:
        by_code = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        by_code[code] = v
        out.append(np.diff(np.concatenate([[0], np.cumsum(by_code[codes])])[edges]))
    return out


def alignments(docs: DataFrame, one: str, two: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; one and two are paths on the driver."""
    held = materialise(slices(docs, one, two, doc_id, text), "slices")
    parts = held.where("code is not null").select("slice", "code", "pair", "n")
    totals = parts.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("second", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    # tables of their own, so that joins on a frequent pair or id can be split
    totals = materialise(totals, "pairs")
    best = totals.groupBy("second").agg(F.max("total").alias("most"))
    counted = materialise(totals.join(best, "second").select("pair", "total", (F.col("total") == F.col("most")).alias("best")), "counted")
    back = parts.select("slice", "code", "pair").join(counted, "pair").select(F.col("slice").alias("of_slice"), "code", "total", "best")
    found = held.where("code is null").drop(*_OF_PAIR)
    schema = T.StructType([docs.schema[doc_id], *(T.StructField(k, T.LongType()) for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    target = to_arrow_schema(schema)

    def run(own: pa.Table, sums: pa.Table) -> pa.Table:
        own, sums = own.combine_chunks(), sums.combine_chunks()
        plain = {c: own[c].chunk(0) for c in own.column_names}
        code, total, best = (sums[c].to_numpy() for c in ("code", "total", "best"))
        count_sum, n_best = summed(plain["codes"], plain["n_links"].to_numpy(), code, total, best)
        new = {doc_id: plain["id"], "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.Table.from_arrays([(new[f.name] if f.name in new else plain[f.name]).cast(f.type) for f in target], schema=target)

    return small_batches(found).groupBy("slice").cogroup(back.groupBy("of_slice")).applyInArrow(run, schema)
