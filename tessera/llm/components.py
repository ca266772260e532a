"""Connected components of an edge table, wholly as joins and aggregations.

Alternating large-star and small-star steps hang every node below the least node it can reach; each step is a
minimum by node, combined before the shuffle, and a join that adaptive execution may split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of an edge can reach. Self loops and repeats do no harm."""
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select("v", "u"))
        # a table of its own, so that the join on a hot node can be split; later joins have few edges a node
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(least).distinct(), "edges")
    raise RuntimeError(f"components aren't found after {MAX_ROUNDS} rounds")
