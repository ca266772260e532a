"""Which rows of a table may have a key of another: a Bloom filter, so that texts stay in place and only hits are shuffled.

Tasks set the bits of a part each; the filter is bounded by MAX_BITS, beyond which more rows are hits. Every key that
was put in is a hit, so an exact join of the hits gives what a join of all rows would give.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key at least, of a filter at least and at most, of a part; positions of a key.
BITS_A_KEY, MIN_BITS, MAX_BITS, PART_BITS, POSITIONS = 12, 1 << 16, 1 << 28, 1 << 16, 3


def positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(POSITIONS)]


def may_be_in(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """Tells of a column whether its value may be one of the keys; true for all that are."""
    bits = max(MIN_BITS, min(MAX_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))

    def pack(t: pa.Table) -> pa.Table:
        own = np.zeros(PART_BITS, bool)
        own[t.column("bit").to_numpy()] = True
        return pa.table({"part": t.column("part")[:1], "packed": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    at = keys.select(F.explode(F.array(*positions(F.col(key), bits))).alias("at"))
    parts = at.select(F.expr(f"at div {PART_BITS}").alias("part"), F.expr(f"at % {PART_BITS}").alias("bit")).groupBy("part").applyInArrow(pack, "part long, packed binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        lo = row["part"] * PART_BITS // 8
        out[lo : lo + PART_BITS // 8] = np.frombuffer(row["packed"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(out.tobytes())

    @F.pandas_udf("boolean")
    def hit(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        held = np.frombuffer(shared.value, np.uint8)
        found = np.ones(len(a), bool)
        for s in (a, b, c):
            x = s.to_numpy()
            found &= (held[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(found)

    return lambda column: hit(*positions(F.col(column), bits))
