"""Bounded traversal and fixpoints over an edge table, as loops of joins.

Each round joins the edges with the newest nodes alone and writes what it found to the shared folder, so plans stay
short and a lost executor costs one round. Which side of a join is sent whole is left to adaptive execution, which
knows the sizes: a frontier is small near its roots and may be large later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators.layering import layers  # noqa: F401


def reach_ways(edges: DataFrame, roots: DataFrame, depth: int, source: str = "from", target: str = "to", seq: str = "seq", root_id: str = "id") -> DataFrame:
    """Nodes that reach a root over at most `depth` edges, followed backwards: (id, depth, predecessor, rank).

    A node has its depth of first discovery. Among edges that discover it in one round the first in queue order
    counts: by the rank of the node it leads to, then by seq; that node is its predecessor. Ranks order the nodes of one
    depth as a queue would: rows sorted over ranges are numbered as they are written. No path travels, see paths().
    Roots need no edge and ids no symbol; depth <= 0 gives the roots alone.
    """
    arrows = edges.select(F.col(source).alias("id"), F.col(target).alias("predecessor"), F.col(seq).cast("long").alias("seq"))
    ranked = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    start = roots.select(F.col(root_id).alias("id")).distinct()
    newest = cut(ranked(start, "id").select("id", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema[root_id].dataType).alias("predecessor"), "rank"), "reach")
    visited = newest
    for level in range(1, depth + 1):
        met = newest.select(F.col("id").alias("predecessor"), F.col("rank").alias("before")).join(arrows, "predecessor")
        met = met.select("id", F.struct("before", "seq", "predecessor").alias("way"))
        first = met.join(visited.select("id"), "id", "left_anti").groupBy("id").agg(F.min("way").alias("way")).select("id", "way.*")
        newest = cut(ranked(first, "before", "seq", "id").select("id", F.lit(level).alias("depth"), "predecessor", "rank"), "reach")
        if newest.isEmpty():
            break
        visited = visited.union(newest)
    return visited


def paths(ways: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, path) of the asked ids, from the root, rebuilt from reach_ways(): a join a step for those nodes alone."""
    steps = ways.select(F.col("id").alias("at"), F.col("predecessor").alias("next"))
    most = ways.agg(F.max("depth")).first()[0] or 0
    found = asked.select("id").distinct().join(ways.select("id", "predecessor"), "id").select("id", F.array("id").alias("path"), F.col("predecessor").alias("at"))
    for _ in range(most):
        longer = F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path"))
        found = found.join(steps, "at", "left").select("id", longer.alias("path"), F.col("next").alias("at"))
    return found.select("id", "path")


def reverse_reach(edges: DataFrame, roots: DataFrame, depth: int, source: str = "from", target: str = "to", seq: str = "seq", root_id: str = "id") -> DataFrame:
    """(id, depth, predecessor, path) of reach_ways(), with the path of every node."""
    ways = reach_ways(edges, roots, depth, source, target, seq, root_id)
    return ways.drop("rank").join(paths(ways, ways), "id")


def reach_depths(edges: DataFrame, roots: DataFrame, depth: int, source: str = "from", target: str = "to", root_id: str = "id") -> DataFrame:
    """(id, depth) of reach_ways(), for those who don't ask for ways: no path travels, and targets are made distinct before they meet what is known."""
    arrows = edges.select(F.col(source).alias("id"), F.col(target).alias("to_id"))
    newest = cut(roots.select(F.col(root_id).alias("id")).distinct().withColumn("depth", F.lit(0)), "reach")
    visited = newest
    for level in range(1, depth + 1):
        met = newest.select(F.col("id").alias("to_id")).join(arrows, "to_id").select("id").distinct()
        newest = cut(met.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)), "reach")
        if newest.isEmpty():
            break
        visited = visited.union(newest)
    return visited


def edges_used(edges: DataFrame, reached: DataFrame, depth: int, target: str = "to") -> DataFrame:
    """Edges whose target is reached at less than `depth`, parallel and cyclic ones included."""
    # written, so that its size is known before any edge is shuffled: the last level, which is most of what is reached, isn't in it
    open_ = cut(reached.where(F.col("depth") < depth).select(F.col("id").alias(target)), "open")
    return edges.join(open_, target, "left_semi")


def closure(pairs: DataFrame, starts: DataFrame, source: str, target: str, start: str) -> DataFrame:
    """(start, node): whatever each start leads to over one or more pairs, without bound and without the start."""
    steps = pairs.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct()
    newest = cut(starts.select(F.col(start).alias("start")).distinct().withColumn("node", F.col("start")), "closure")
    seen = newest
    while True:
        more = newest.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        newest = cut(more.join(seen, ["start", "node"], "left_anti"), "closure")
        if newest.isEmpty():
            return seen.where("node <> start")
        seen = seen.union(newest)


def inherited(bases: DataFrame, own: DataFrame, node: str, base: str, item: str) -> DataFrame:
    """(node, item): the items of each node and of all that it goes back to; bases: one base a node at most, own: (node, item).

    Each round doubles how far back a node sees: it adds the items of the node at the end of its view, and sees what
    that one sees. A chain takes the logarithm of its length in rounds, and so does a cycle, whose views never end.
    """
    ahead = cut(bases.select(F.col(node).alias("a"), F.col(base).alias("b")).where("a is not null and b is not null"), "bases")
    have = cut(own.select(F.col(node).alias("a"), F.col(item).alias("item")).distinct(), "items")
    for _ in range(ahead.count().bit_length() + 1):
        if ahead.isEmpty():
            break
        have = cut(have.union(ahead.join(have.withColumnRenamed("a", "b"), "b").select("a", "item")).distinct(), "items")
        ahead = cut(ahead.join(ahead.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "bases")
    return have.select(F.col("a").alias(node), F.col("item").alias(item))


def propagate(edges: DataFrame, roots: DataFrame, allowed: Column, source: str = "from", target: str = "to") -> DataFrame:
    """Nodes (id) that reach a root backwards over allowed edges alone, to the fixpoint."""
    steps = cut(edges.where(F.coalesce(allowed, F.lit(False))).select(F.col(source).alias("id"), F.col(target).alias("to_id")), "steps")
    newest = cut(roots.select("id").distinct(), "seen")
    seen = newest
    while True:
        more = newest.select(F.col("id").alias("to_id")).join(steps, "to_id").select("id").distinct()
        newest = cut(more.join(seen, "id", "left_anti"), "seen")
        if newest.isEmpty():
            return seen
        seen = seen.union(newest)
