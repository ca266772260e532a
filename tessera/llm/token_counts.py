"""Numbers of tokens of whole texts, without their ids.

Texts reach a task in Arrow batches, which are dealt anew into slices of like bytes; long texts are split at boundaries
that no token crosses. The tokenizer's own library encodes fragments in batches, and numbers alone leave the task:
no shuffle, and no ids. See fragments for the boundaries.

Defined cases: a null text counts as the empty text, which has no tokens; equal texts have equal counts; texts of any
length are counted whole; rows that repeat an id, or have none, are counted each by its own text; an empty table gives
an empty table; other columns pass through, and input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import give_back, small_batches, with_columns
from tessera.llm.fragments import SLICE_BYTES, by_bytes, counter, shared_vocabulary


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """df without its texts, with their UTF-8 bytes and tokens; vocabulary is the path of a .json or .model file on the driver."""
    shared, name = shared_vocabulary(df, vocabulary), vocabulary
    kept = [f for f in df.schema.fields if f.name not in (text, n_tokens, n_bytes)]
    schema = T.StructType([*kept, T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, text, SLICE_BYTES):
                texts = pc.fill_null(part.column(text), "")
                counts = counter(name, shared.value).count(texts.to_pylist())
                new = {n_bytes: pc.binary_length(texts).cast(pa.int64()), n_tokens: pa.array(counts, pa.int64())}
                yield from with_columns(part, **new).select(schema.names).cast(target).to_batches()
        give_back()

    return small_batches(df).mapInArrow(run, schema)
