"""Line deduplication with two Bloom filters.

One filter holds the hashes of lines seen once, the other of lines seen again. Tasks build both over their own
documents as sparse bit positions; merging two tasks' filters marks as seen again what either has so or what both
have seen. Only lines whose hash the second filter holds, the suspected repeats, are shuffled: counted exactly by
a 128-bit digest of the key, with the one document that keeps the line. A filter never misses a repeat, so the
result is exact whatever its size; a small filter only lets more lines be shuffled.

The repeated keys are sent to all tasks while they are MAX_SENT at most, so that texts stay where they are; beyond
that each document's lost keys are joined with it by id.

Defined cases: null and empty texts are one empty line; keys shorter than the least length always stay; a key that
repeats within one document counts once; documents without an id are left as they are and not counted; rows that
repeat an id count as one document; long texts are taken whole; an empty table gives an empty table; other columns
pass through, but input columns named like the output's, `__id` or `__digests` are replaced or dropped.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, materialise, small_batches, with_columns

#: Keys of fewer code points stay; documents that must hold a key before it goes.
MIN_CHARS, MIN_DOCUMENTS = 40, 5
#: Bits of the filters for each line that counts; positions of each line; least and most bits of a filter (powers of 2).
BITS_A_LINE, POSITIONS, MIN_BITS, MAX_BITS = 16, 2, 1 << 16, 1 << 29
#: Bits of a filter's part that is merged on its own.
PART_BITS = 1 << 22
#: Pieces of a part, one from each task, that are merged at a time.
FAN_IN = 64
#: Repeated keys that are sent to all tasks at most: 24 bytes each.
MAX_SENT = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\x0b\x0c\r"


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line of a text in UTF-8."""
    return [line.strip(_SPACE) for line in text.translate(_LOWER).split(b"\n")]


def digest(key: bytes, min_chars: int) -> bytes | None:
    """The key's digest; None if it has fewer code points than min_chars."""
    if len(key) < 4 * min_chars and (len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars)):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_digests(text: bytes | None, min_chars: int) -> list[bytes]:
    """Digests of the text's distinct keys that are long enough."""
    if not text or len(text) < min_chars:
        return []
    return list({d for k in set(line_keys(text)) if (d := digest(k, min_chars)) is not None})


def positions(found: list[bytes], bits: int) -> np.ndarray:
    """POSITIONS bit positions of each digest: one row a digest."""
    halves = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    steps = np.arange(POSITIONS, dtype=np.uint64)
    return ((halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(docs: DataFrame, text: str, min_chars: int) -> int:
    """A power of 2 of bits for all lines that can count: one pass over the lengths, no line is looked at."""
    size = F.octet_length(text)
    lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.sum(F.least(lines, (size / min_chars).cast("int"))).alias("n")).first()["n"] or 0
    return int(min(MAX_BITS, max(MIN_BITS, 1 << (int(n) * BITS_A_LINE - 1).bit_length() if n else 0)))


def _packed(at: np.ndarray) -> bytes:
    """Ascending positions within a part, compressed: as differences, or as bits where they are many."""
    if len(at) > PART_BITS // 32:
        bits = np.zeros(PART_BITS, bool)
        bits[at] = True
        return b"b" + zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    return b"d" + zlib.compress(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    if data[:1] == b"b":
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def repeat_filter(docs: DataFrame, doc_id: str, text: str, bits: int, min_chars: int) -> np.ndarray:
    """The filter of lines seen again, as bytes of 8 bits; its size is bounded by MAX_BITS."""
    kinds = pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("once", pa.binary()), ("again", pa.binary())])
    parts = "part long, piece long, once binary, again binary"

    def build(batches):
        once, again = np.empty(0, np.int64), np.empty(0, np.int64)
        pending: list[np.ndarray] = []
        held = 0

        def fold():
            nonlocal once, again, pending, held
            at, n = np.unique(np.concatenate([once, *pending]), return_counts=True)
            again = np.union1d(again, at[n > 1])
            once, pending, held = at, [], 0

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                if i is not None and (found := line_digests(x, min_chars)):
                    # a document adds each of its bits once
                    pending.append(np.unique(positions(found, bits)))
                    held += len(pending[-1])
            if held > 1 << 21:
                fold()
        fold()
        piece = TaskContext.get().partitionId()
        for part in np.unique(once // PART_BITS).tolist():
            lo, hi = part * PART_BITS, (part + 1) * PART_BITS
            cut = [a[np.searchsorted(a, lo) : np.searchsorted(a, hi)] - lo for a in (once, again)]
            yield pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "once": [_packed(cut[0])], "again": [_packed(cut[1])]}, kinds)

    def merge(t: pa.Table) -> pa.Table:
        once, again = np.zeros(PART_BITS, bool), np.zeros(PART_BITS, bool)
        for o, a in zip(t.column("once"), t.column("again")):
            at = _unpacked(o.as_py())
            again[at[once[at]]] = True
            again[_unpacked(a.as_py())] = True
            once[at] = True
        return pa.table({"part": t.column("part")[:1], "piece": t.column("piece")[:1], "once": [_packed(np.flatnonzero(once))], "again": [_packed(np.flatnonzero(again))]}, kinds)

    source = small_batches(docs.select(doc_id, text))
    pieces = source.rdd.getNumPartitions()
    found = source.mapInArrow(build, parts)
    while True:
        # a group has FAN_IN pieces of one part at most, whatever the number of tasks
        found = found.withColumn("piece", F.expr(f"piece div {FAN_IN}")).groupBy("part", "piece").applyInArrow(merge, parts)
        pieces = -(-pieces // FAN_IN)
        if pieces <= 1:
            break
    out = np.zeros(max(bits, PART_BITS) // 8, np.uint8)
    for row in found.select("part", "again").toLocalIterator():
        part = np.zeros(PART_BITS, bool)
        part[_unpacked(row["again"])] = True
        at = row["part"] * PART_BITS // 8
        out[at : at + PART_BITS // 8] = np.packbits(part, bitorder="little")
    return out


def repeated_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_documents: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of the suspected repeats, and (digest, keeper) of the keys that enough documents hold."""
    spark = docs.sparkSession
    bits = filter_bits(docs, text, min_chars)
    shared = spark.sparkContext.broadcast(repeat_filter(docs, doc_id, text, bits, min_chars).tobytes())
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("digest", T.BinaryType())])

    def suspects(b: pa.RecordBatch):
        again = np.frombuffer(shared.value, np.uint8)
        ids, digests = [], []
        for i, x in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            if i is not None and (found := line_digests(x, min_chars)):
                at = positions(found, bits)
                hit = (again[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
                if hit.any():
                    digests += [d for d, h in zip(found, hit.tolist()) if h]
                    ids += [i] * int(hit.sum())
        return pa.table({"id": pa.array(ids, b.schema.field(0).type), "digest": pa.array(digests, pa.binary())}) if ids else None

    # read twice: once to count, once to pick
    held = materialise(arrow_map(docs.select(doc_id, text), schema, suspects), "suspects")
    counted = held.groupBy("digest").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
    # a table of its own: the join may send it whole where it is small, and split a hot line's documents where it isn't
    return held, materialise(counted.where(F.col("n") >= min_documents).drop("n"), "repeated")


class Keepers:
    """The repeated keys and the documents that keep them, in order of the digests' first halves, which must be distinct."""

    def __init__(self, digests: list[bytes], keepers: np.ndarray):
        halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.argsort(halves[:, 0])
        self.first, self.second, self.keeper = halves[order, 0], halves[order, 1], keepers[order]

    @property
    def distinct(self) -> bool:
        return bool((self.first[1:] != self.first[:-1]).all())

    def gone(self, found: list[bytes], doc) -> np.ndarray:
        """Which digests the document loses."""
        halves = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.first, halves[:, 0]), len(self.first) - 1)
        return (self.first[at] == halves[:, 0]) & (self.second[at] == halves[:, 1]) & (self.keeper[at] != doc)


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: str = "kept", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with columns `kept` (the remaining lines), n_lines and n_dropped."""
    docs = docs.drop("__id", "__digests")
    held, repeated = repeated_keys(docs, doc_id, text, min_chars, min_documents)
    new = [T.StructField(kept, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in {f.name for f in new}] + new)
    keepers = None
    if (n := repeated.count()) <= MAX_SENT:
        sent = repeated.toArrow()
        keepers = Keepers(sent["digest"].to_pylist(), np.array(sent["keeper"].to_pylist()))
    if keepers is not None and keepers.distinct:
        source, shared = docs, docs.sparkSession.sparkContext.broadcast(keepers)
        of = lambda b: b.column(doc_id).to_pylist()
        gone = lambda found, i: shared.value.gone(found, i) if n and i is not None else np.zeros(len(found), bool)
    else:
        lost = held.join(repeated, "digest").where("id <> keeper").groupBy(F.col("id").alias("__id")).agg(F.collect_set("digest").alias("__digests"))
        source = docs.join(lost, docs[doc_id] == lost["__id"], "left").drop("__id")
        of = lambda b: [None if x is None else set(x) for x in b.column("__digests").to_pylist()]
        gone = lambda found, lost: np.array([bool(lost) and d in lost for d in found], bool)

    def run(b: pa.RecordBatch):
        texts, n_lines, n_dropped = [], [], []
        for x, own in zip(utf8(b.column(text)), of(b)):
            keys = line_keys(x or b"")
            digests = [digest(k, min_chars) for k in keys]
            found = list({d for d in digests if d is not None})
            drop = {d for d, g in zip(found, gone(found, own).tolist()) if g} if found else set()
            stay = [z for z, d in zip(x.split(b"\n"), digests) if d not in drop] if drop else None
            texts.append((x or b"") if stay is None else b"\n".join(stay))
            n_lines.append(len(keys))
            n_dropped.append(0 if stay is None else len(keys) - len(stay))
        return with_columns(b, **{kept: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}).select(schema.names)

    return arrow_map(source, schema, run)
