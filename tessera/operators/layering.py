"""Layers of a dependency graph: the longest chain below each node, cycles included, as rounds of joins.

A node has its layer as soon as all it depends on have theirs, so a graph without cycles takes as many rounds as it has
layers. What is left then reaches a cycle. Its strongly connected components are found by colours: every node takes the
least name among those that reach it, and the nodes of a colour that reach the one it is named after are its component.
Components take part in the rounds as a whole.

Within a component the layers follow the order of a depth-first visit by name, in which a node in progress counts as 0.
That order depends on where the visit enters: at the end of the least path of names that leads there, which is found
from the top in rounds too. Only a component's own edges are gathered, in one task each; one with more than
CYCLE_EDGES of them is refused, as such a visit has no parallel form.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut

#: Edges within one component at most.
CYCLE_EDGES = 1_000_000


def layers(dependencies: DataFrame, nodes: DataFrame, source: str = "from_project", target: str = "to_project", node: str = "project") -> DataFrame:
    """(project, layer): the longest chain of dependencies below each node, leaves 0.

    Cycles depend on the order of visits, by name: a node in progress counts as 0, so a node that depends on itself has
    layer 1 at least. Repeated rows count once; dependencies on what is no node count; rows without a name are left out.
    """
    names = nodes.select(F.col(node).alias("a")).where("a is not null").distinct()
    pairs = cut(dependencies.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null").distinct(), "dependencies")
    edges = pairs.where("a <> b")
    loops = pairs.where("a = b").select("a", F.lit(0).alias("best"))
    every = names.union(edges.select("a")).union(edges.select("b")).distinct()
    start = every.join(loops, "a", "left").select("a", F.coalesce("best", F.lit(-1)).alias("best"))
    counts = edges.groupBy("a").agg(F.count("*").alias("open"))
    waiting = cut(start.join(counts, "a", "left").select("a", F.coalesce("open", F.lit(0)).alias("open"), "best"), "waiting")
    known, waiting = settled(waiting, edges)
    if not waiting.isEmpty():
        known = known.union(with_cycles(edges.join(waiting.select("a"), "a", "left_semi"), waiting, known, names))
    return names.join(known, "a").select(F.col("a").alias(node), "layer")


def settled(waiting: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, layer) of the nodes below which there is no cycle, and what still waits: (a, open, best)."""
    layer = (F.col("best") + 1).alias("layer")
    newest = waiting.where("open = 0").select("a", layer)
    waiting, known, rounds = waiting.where("open > 0"), newest, 0
    while not newest.isEmpty() and not waiting.isEmpty():
        met = edges.join(newest.select(F.col("a").alias("b"), "layer"), "b").groupBy("a").agg(F.count("*").alias("met"), F.max("layer").alias("most"))
        left = cut(waiting.join(met, "a", "left").select("a", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("best", "most").alias("best")), "waiting")
        newest, waiting, rounds = left.where("open = 0").select("a", layer), left.where("open > 0"), rounds + 1
        known = known.union(newest)
        if rounds % 16 == 0:
            known = cut(known, "layers")  # a plan of few tables
    return known, waiting


def fixpoint(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, least): the least label of all that reach a node over edges (a, b), its own included; start: (a, least)."""
    newest = known = cut(start, "labels")
    while True:
        met = newest.join(edges, "a").groupBy(F.col("b").alias("a")).agg(F.min("least").alias("met"))
        joined = cut(known.join(met, "a", "left").select("a", F.least("least", "met").alias("least"), (F.col("met") < F.col("least")).alias("changed")), "labels")
        newest, known = joined.where("changed").select("a", "least"), joined.select("a", "least")
        if newest.isEmpty():
            return known


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(a) of the start and all that its nodes lead to over edges (a, b)."""
    found = newest = cut(start.distinct(), "seen")
    while not newest.isEmpty():
        newest = cut(newest.join(edges, "a").select(F.col("b").alias("a")).distinct().join(found, "a", "left_anti"), "seen")
        found = found.union(newest)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(a, unit): the strongly connected component of each node of the edges (a, b), by its least name."""
    out, rest = None, edges
    nodes = cut(edges.select("a").union(edges.select("b")).distinct(), "nodes")
    while True:
        # what nothing leads to, or what leads to nothing, is alone
        while True:
            both = rest.select("a").distinct().join(rest.select(F.col("b").alias("a")).distinct(), "a")
            inner = cut(rest.join(both, "a", "left_semi").join(both.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "inner")
            done = inner.count() == rest.count()
            rest = inner
            if done:
                break
        live = rest.select("a").union(rest.select("b")).distinct()
        alone = nodes.join(live, "a", "left_anti").select("a", F.col("a").alias("unit"))
        out = alone if out is None else out.union(alone)
        if rest.isEmpty():
            return cut(out, "units")
        colour = fixpoint(live.select("a", F.col("a").alias("least")), rest)
        ends = rest.join(colour.withColumnRenamed("least", "c"), "a").join(colour.select(F.col("a").alias("b"), F.col("least").alias("d")), "b")
        same = cut(ends.where("c = d").select(F.col("b").alias("a"), F.col("a").alias("b")), "same")  # backwards
        found = reached(colour.where("a = least").select("a"), same)
        members = cut(colour.join(found, "a", "left_semi").select("a", F.col("least").alias("unit")), "members")
        out = out.union(members)
        nodes = cut(live.join(members, "a", "left_anti"), "nodes")
        rest = cut(rest.join(nodes, "a", "left_semi").join(nodes.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "inner")


def entries(edges: DataFrame, units: DataFrame, own: DataFrame, names: DataFrame) -> DataFrame:
    """(unit, path): the least path of names by which a depth-first visit comes to each unit; own: (unit, a, b) within units."""
    ends = edges.join(units, "a").join(units.select(F.col("a").alias("b"), F.col("unit").alias("to_unit")), "b").where("unit <> to_unit")
    over = cut(ends.select("a", "b", F.col("to_unit").alias("unit")), "over")
    begun = names.join(units, "a").select("unit", F.array("a").alias("path"))
    waiting = cut(units.select("unit").distinct().join(over.groupBy("unit").agg(F.count("*").alias("open")), "unit", "left").select("unit", F.coalesce("open", F.lit(0)).alias("open")), "waiting")
    best = cut(begun.groupBy("unit").agg(F.min("path").alias("path")), "paths")
    out = None
    while True:
        ready = best.join(waiting.where("open = 0"), "unit", "left_semi")
        out = ready if out is None else out.union(ready)
        waiting = waiting.where("open > 0")
        if waiting.isEmpty():
            return out
        # the way on to each member of the units that are ready
        rows = ready.join(own, "unit").groupBy("unit").applyInPandas(visited, "a string, path array<string>")
        single = ready.join(own.select("unit").distinct(), "unit", "left_anti").select(F.col("unit").alias("a"), "path")
        newest = cut(rows.union(single), "ways")
        met = over.join(newest, "a").groupBy("unit").agg(F.count("*").alias("met"), F.min(F.concat("path", F.array("b"))).alias("way"))
        left = cut(waiting.join(met, "unit", "left").join(best, "unit", "left").select("unit", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.least("path", "way").alias("path")), "paths")
        waiting, best = left.select("unit", "open"), left.select("unit", "path")


def visited(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, path) of a component's nodes, by a depth-first visit by name from the end of the path that leads to it."""
    below = adjacency(rows)
    path = list(rows["path"].iloc[0])
    out, found = [(path[-1], path)], {path[-1]}
    stack = [(path, iter(below[path[-1]]))]
    while stack:
        way, rest = stack[-1]
        for b in rest:
            if b not in found:
                found.add(b)
                out.append((b, [*way, b]))
                stack.append((out[-1][1], iter(below[b])))
                break
        else:
            stack.pop()
    return pd.DataFrame(out, columns=["a", "path"])


def adjacency(rows: pd.DataFrame) -> dict[str, list[str]]:
    if len(rows) > CYCLE_EDGES:
        raise ValueError(f"more than {CYCLE_EDGES} dependencies within one cycle")
    below: dict[str, list[str]] = {}
    for a, b in sorted(zip(rows["a"], rows["b"])):
        below.setdefault(a, []).append(b)
    return below


def layered(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, layer) of a component's nodes; rows: its edges (a, b), entry, and what a's other dependencies come to (best, -1 without any)."""
    below = adjacency(rows)
    outside = dict(zip(rows["a"], rows["best"]))
    entry = rows["entry"].iloc[0]
    found: dict[str, int] = {}
    best, active, stack = {entry: outside[entry]}, {entry}, [(entry, iter(below[entry]))]
    while stack:
        top, rest = stack[-1]
        for b in rest:
            if b in found or b in active:
                best[top] = max(best[top], found.get(b, 0))
                continue
            stack.append((b, iter(below[b])))
            active.add(b)
            best[b] = outside[b]
            break
        else:
            stack.pop()
            active.discard(top)
            found[top] = best[top] + 1
            if stack:
                best[stack[-1][0]] = max(best[stack[-1][0]], found[top])
    return pd.DataFrame(sorted(found.items()), columns=["a", "layer"])


def with_cycles(edges: DataFrame, waiting: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """(a, layer) of the nodes that reach a cycle; edges: all of theirs, waiting: (a, open, best) with the best of what is known below."""
    left = cut(edges.join(waiting.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"), "left")
    if not waiting.join(names, "a", "left_anti").isEmpty():
        # no visit comes to what no node leads to
        seen = reached(names.join(waiting, "a", "left_semi").select("a"), left)
        left, waiting = cut(left.join(seen, "a", "left_semi").select("a", "b"), "left"), waiting.join(seen, "a", "left_semi")
    units = components(left)
    tagged = left.join(units, "a").join(units.select(F.col("a").alias("b"), F.col("unit").alias("to_unit")), "b")
    own = cut(tagged.where("unit = to_unit").select("unit", "a", "b"), "own")
    over = cut(tagged.where("unit <> to_unit").select("unit", "a", "b"), "over")
    entry = cut(entries(left, units, own, names).join(own.select("unit").distinct(), "unit", "left_semi").select("unit", F.element_at("path", -1).alias("entry")), "entries")
    open_ = over.groupBy("unit").agg(F.count("*").alias("open"))
    state = cut(waiting.join(units, "a").join(open_, "unit", "left").select("unit", "a", F.coalesce(open_["open"], F.lit(0)).alias("open"), "best"), "state")
    out = None
    while True:
        ready, rest = state.where("open = 0"), state.where("open > 0")
        single = ready.join(own.select("unit").distinct(), "unit", "left_anti").select("a", (F.col("best") + 1).cast("long").alias("layer"))
        cyclic = own.join(ready.select("unit", "a", "best"), ["unit", "a"]).join(entry, "unit").select("unit", "a", "b", "best", "entry")
        newest = cut(single.union(cyclic.groupBy("unit").applyInPandas(layered, "a string, layer long")), "layers").select("a", F.col("layer").cast("int").alias("layer"))
        out = newest if out is None else out.union(newest)
        if rest.isEmpty():
            return out
        met = over.join(newest.select(F.col("a").alias("b"), "layer"), "b").groupBy("unit", "a").agg(F.count("*").alias("met"), F.max("layer").alias("most"))
        joined = rest.join(met, ["unit", "a"], "left")
        fewer = F.col("open") - F.coalesce(F.sum("met").over(Window.partitionBy("unit")), F.lit(0))
        state = cut(joined.select("unit", "a", fewer.alias("open"), F.greatest("best", "most").alias("best")), "state")
