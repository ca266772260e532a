"""Bottom-k fingerprints of shingle hashes.

A fingerprint holds the k smallest distinct 64-bit hashes of a text's shingles (below k: all of them). Two
fingerprints merge into that of the union, so a text may be sketched in parts; from them follow estimates of
distinct shingles, resemblance and containment, exact while a union has no more than k shingles.

Defined cases: a null text is the empty text, which has no hashes; two empty texts resemble each other by 1, an
empty and another by 0; with fewer words than a shingle the whole sequence is one; long texts are sketched whole;
equal texts give equal fingerprints; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, with_columns
from tessera.llm.shingles import shingle_hashes

#: Hashes in a fingerprint.
K = 128
SPACE = float(1 << 64)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        # a few more than k, in case some repeat; all of them where that isn't enough
        low = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection by that of the union: the share of the union's sketch that both hold."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def packed(a: np.ndarray) -> bytes:
    return a.astype("<u8").tobytes()


def unpacked(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", "<u8")


def fingerprint(text: str | None, k: int = K, words: int = 5) -> np.ndarray:
    return sketch(shingle_hashes(text, words), k)


def with_fingerprints(df: DataFrame, columns: dict[str, str], drop: bool = False, k: int = K, words: int = 5) -> DataFrame:
    """df with the packed sketch (little-endian unsigned 64-bit hashes, ascending) of each text column; columns: text to sketch.

    The last few texts are remembered, as a text may come again in the next row. drop: without the text columns.
    """
    gone = {*columns.values(), *(columns if drop else ())}
    schema = T.StructType([f for f in df.schema.fields if f.name not in gone] + [T.StructField(n, T.BinaryType()) for n in columns.values()])

    def run(b: pa.RecordBatch):
        lists = [b.column(c).to_pylist() for c in columns]
        made, recent = [[] for _ in columns], {}
        for row in zip(*lists):
            now = {x: recent[x] if x in recent else packed(fingerprint(x, k, words)) for x in dict.fromkeys(row)}
            for out, x in zip(made, row):
                out.append(now[x])
            recent = now
        return with_columns(b, **{n: pa.array(m, pa.binary()) for n, m in zip(columns.values(), made)}).select(schema.names)

    return arrow_map(df, schema, run)


def compare(df: DataFrame, pairs: dict[str, tuple[str, str]], k: int = K) -> DataFrame:
    """df with the estimates between packed sketch columns: near_x, contained_x (the first in the second) for each named pair, and distinct_c for each column."""
    sketches = list(dict.fromkeys(c for p in pairs.values() for c in p))
    new = [f"{what}_{name}" for name in pairs for what in ("near", "contained")] + [f"distinct_{c}" for c in sketches]
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, T.DoubleType()) for n in new])

    def run(batch: pa.RecordBatch):
        found = {c: [unpacked(x) for x in batch.column(c).to_pylist()] for c in sketches}
        values = {f"distinct_{c}": [distinct(x, k) for x in found[c]] for c in sketches}
        for name, (a, b) in pairs.items():
            values[f"near_{name}"] = [resemblance(x, y, k) for x, y in zip(found[a], found[b])]
            values[f"contained_{name}"] = [containment(x, y, k) for x, y in zip(found[a], found[b])]
        return with_columns(batch, **{n: pa.array(values[n], pa.float64()) for n in new}).select(schema.names)

    return arrow_map(df, schema, run)


def merged(df: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for each value of `by`, of the union of its parts.

    Each task first merges what it has of each value, so a value with a third of all rows sends one sketch a task.
    """
    kind = df.schema[by]
    schema = T.StructType([kind, T.StructField(fingerprint, T.BinaryType())])

    def partial(batches):
        for b in batches:
            parts: dict = {}
            for key, x in zip(b.column(by).to_pylist(), b.column(fingerprint).to_pylist()):
                parts[key] = merge(parts[key], unpacked(x), k) if key in parts else unpacked(x)[:k]
            rows = pa.table({by: pa.array(parts.keys(), b.schema.field(by).type), fingerprint: pa.array(map(packed, parts.values()), pa.binary())})
            yield from rows.to_batches()

    def final(parts: pa.Table) -> pa.Table:
        total = np.empty(0, "<u8")
        for x in parts.column(fingerprint).to_pylist():
            total = merge(total, unpacked(x), k)
        return pa.table({by: parts.column(by)[:1].combine_chunks(), fingerprint: pa.array([packed(total)], pa.binary())})

    return df.select(by, fingerprint).mapInArrow(partial, schema).groupBy(by).applyInArrow(final, schema)
