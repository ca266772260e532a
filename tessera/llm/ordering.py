"""Neighbours in a global order, without sorting all rows in one task.

The order key is cut into ranges at approximate quantiles, a bounded number of values. Each range is sorted alone;
the first row of the following range is added to each as its edge, so every row finds its successor in its range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions

#: Ranges for each shuffle partition, and at most; both bound what the driver holds.
RANGES_A_PARTITION, MAX_RANGES = 8, 20_000


def with_next(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with `value` of the row that follows by `key` ascending; after the last row comes the first.

    Rows of equal keys follow each other by `value`. Rows without a key come first of all.
    """
    spark, df = df.sparkSession, df.drop(out)
    partitions = shuffle_partitions(spark)
    ranges = min(MAX_RANGES, RANGES_A_PARTITION * partitions)
    keys = df.select(F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("k"))
    shares = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.percentile_approx("k", shares, 20 * ranges).alias("cuts"), F.count("*").alias("n")).first()
    if not found["n"]:
        return df.withColumn(out, F.col(value))
    cuts = np.unique(np.array(found["cuts"], np.int64))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.fillna(-(1 << 63)).astype("int64").to_numpy(), "right")).astype("int32")

    # a plain column for the ranges' first keys, so that no row is a null there
    placed = df.withColumn("__key", F.coalesce(F.col(key), F.lit(-(1 << 63)))).withColumn("__range", range_of("__key"))
    firsts = sorted(keys.withColumn("r", range_of("k")).groupBy("r").agg(F.min("k").alias("first")).collect(), key=lambda x: x["r"])
    before = [(firsts[i]["first"], firsts[i - 1]["r"], i == 0) for i in range(len(firsts))]
    edges = F.broadcast(spark.createDataFrame(before, "__key long, __before int, __wraps boolean"))
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("edge"))
    edge = F.struct(F.col("__before").alias("r"), F.lit(1).alias("edge"))
    spread = (
        placed.join(edges, "__key", "left")
        .withColumn("__at", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, edge))))
        .select(*(F.col(c) for c in df.columns), "__key", F.col("__at.r").alias("__range"), F.col("__at.edge").alias("__edge"))
        .repartitionByRange(partitions, "__range")
    )
    follows = Window.partitionBy("__range").orderBy("__edge", "__key", value)
    return spread.withColumn(out, F.lead(value).over(follows)).where("__edge = 0").select(*df.columns, out)
