"""Shared helpers: table access, materialised intermediate tables, Arrow maps and word rules."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.lineage import cut as materialise  # noqa: F401  what a stage needs more than once is written to the shared folder

#: ASCII white space that separates words in the contracts.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that become Python objects at a time; bounds a task's memory.
SLICE_ROWS = 500
#: Rows of an Arrow batch at most: documents are long, and each Python pass of a task holds batches off the heap.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_ROWS rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > BATCH_ROWS or int(conf.get(name)) <= 0:
        conf.set(name, BATCH_ROWS)
    return df


def give_back() -> None:
    """Returns what this task used to the system: the worker lives on, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, schema: T.StructType, batch: Callable[[pa.RecordBatch], pa.Table | None]) -> DataFrame:
    """mapInArrow of one function on at most SLICE_ROWS rows at a time, its output cast to schema."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                if (out := batch(b.slice(at, SLICE_ROWS))) is not None:
                    yield from out.cast(target).to_batches()
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def with_columns(b: pa.RecordBatch, **columns: pa.Array) -> pa.Table:
    """The batch with columns replaced or appended, in this order."""
    t = pa.Table.from_batches([b])
    for name, values in columns.items():
        at = t.schema.get_field_index(name)
        t = t.append_column(name, values) if at < 0 else t.set_column(at, name, values)
    return t
