import random

import pytest
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators import graph, impact

EDGE = "`from` string, `to` string, kind string, file string, line int, via string, seq long"


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, k, f, n, v, i) for i, (a, b, k, f, n, v) in enumerate(rows)], EDGE)


def bfs(pairs, root, depth):
    """Queue order, as a single thread would do it."""
    found, queue = {root: (0, None)}, [root]
    for node in queue:
        if found[node][0] >= depth:
            continue
        for a, b in pairs:
            if b == node and a not in found:
                found[a] = (found[node][0] + 1, node)
                queue.append(a)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_reverse_reach_is_queue_order(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(30)]
    edges = edges_of(spark, [(a, b, "call", "f", 1, None) for a, b in pairs])
    rows = graph.reverse_reach(edges, spark.createDataFrame([("n0",)], "id string"), 3).collect()
    assert {x["id"]: (x["depth"], x["predecessor"]) for x in rows} == bfs(pairs, "n0", 3)
    for x in rows:
        assert x["path"][0] == "n0" and x["path"][-1] == x["id"] and len(x["path"]) == x["depth"] + 1


def test_depths_alone_are_those_of_the_ways(spark):
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", i) for i, (a, b) in enumerate([(1, 0), (2, 0), (2, 1), (3, 2), (0, 3), (4, 3), (5, 4), (4, 3), (1, 1)])], "`from` string, `to` string, seq long")
    start = spark.createDataFrame([("n0",), ("n0",)], "id string")
    for depth in (0, 2, 3):
        want = sorted((r["id"], r["depth"]) for r in graph.reverse_reach(edges, start, depth).collect())
        assert sorted((r["id"], r["depth"]) for r in graph.reach_depths(edges, start, depth).collect()) == want
    assert [impact.clamped(d) for d in (-3, 1, 5, 99)] == [1, 1, 5, 10]


def test_groups_by_size_and_samples(spark):
    rows = spark.createDataFrame([(str(i), "ab"[i % 3 == 0], i % 2, f"d{9 - i}") for i in range(9)], "id string, project string, depth int, display string")
    got = [(r["project"], r["depth"], r["display"]) for r in impact.by_group_size(rows).collect()]
    assert [p for p, *_ in got] == ["a"] * 6 + ["b"] * 3 and got[:6] == sorted(got[:6])
    assert impact.sampled(rows, 4).collect() == impact.sampled(rows.repartition(5), 4).collect() and impact.sampled(rows, 4).count() == 4


def test_depth_zero_and_unknown_root(spark):
    edges = edges_of(spark, [("B", "A", "call", "f", 1, None)])
    for root, depth in (("A", 0), ("X", 5)):
        assert [x["id"] for x in graph.reverse_reach(edges, spark.createDataFrame([(root,)], "id string"), depth).collect()] == [root]


def test_edges_used_counts_parallel_and_cyclic_edges(spark):
    edges = edges_of(spark, [("B", "A", "call", "f", 1, "interface"), ("B", "A", "call", "f", 2, "interface"), ("A", "B", "read", "f", 3, None), ("C", "B", "call", "f", 4, "override")])
    reached = graph.reverse_reach(edges, spark.createDataFrame([("A",)], "id string"), 1)
    used = graph.edges_used(edges, reached, 1)
    assert impact.via_counts(used).first().asDict() == {"via_interface": 2, "via_override": 0, "via_mediatr": 0, "via_delegate": 0, "edges_used": 2}


def test_fan_in_counts_distinct_callers(spark):
    rows = [("B", "A", "call", "f", i, None) for i in range(3)] + [("C", "A", k, "f", 9, None) for k in ("read", "write", "inherits")]
    rows += [("D", "A", "new", "f", 1, "interface"), ("A", "A", "call", "f", 2, None)]
    assert impact.fan_in(edges_of(spark, rows)).first().asDict() == {"to": "A", "direct_fan_in": 2, "inferred_only": 1}


def test_confirmation_passes_where_one_path_is_sure(spark):
    symbols = spark.createDataFrame([("Impl.M", "M", "Impl", 0), ("Sib.M", "M", "Sib", 1), ("Up", "Up", "T", 2)], "id string, name string, containingType string, seq long")
    edges = edges_of(spark, [("Bridge", "Impl.M", "call", "f", 1, "interface"), ("Bridge", "Sib.M", "call", "f", 1, "interface"), ("Bridge", "Impl.M", "call", "f", 7, None), ("Other", "Impl.M", "call", "f", 2, "interface"), ("Other", "Sib.M", "call", "f", 2, "interface")])
    bound = spark.createDataFrame([("T:Sib",)], "impl string")
    used = impact.with_confirmation(edges, symbols, impact.confirmed_types(bound))
    sure = {x["id"] for x in graph.propagate(used, spark.createDataFrame([("Impl.M",)], "id string"), F.col("confirmed")).collect()}
    assert sure == {"Impl.M", "Bridge"}


def test_no_evidence_confirms(spark):
    symbols = spark.createDataFrame([("Impl.M", "M", "Impl", 0)], "id string, name string, containingType string, seq long")
    edges = edges_of(spark, [("X", "Impl.M", "call", "f", 1, "interface")])
    none = spark.createDataFrame([], "impl string")
    assert impact.with_confirmation(edges, symbols, impact.confirmed_types(none)).first()["confirmed"]


@pytest.mark.parametrize("ep, tests, hops, any_ep, inter, want", [(2, 0, 0, 22, 0, 2), (0, 0, 0, 0, 3, None), (0, 0, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0), (1, 0, 0, 1, 1, 1), (40, 1, 9, 40, 0, 10), (0, 0, 4, 5, 0, 0)])
def test_risk_score(spark, ep, tests, hops, any_ep, inter, want):
    row = spark.createDataFrame([(ep, tests, hops, any_ep, inter)], "a long, b long, c long, d long, e long")
    assert row.select(impact.risk_score(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e")).alias("s")).first()["s"] == want


def test_layers_with_a_cycle(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], "from_project string, to_project string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "project string")
    assert {r[0]: r[1] for r in graph.layers(deps, nodes).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0, "e": 0}


def test_closure_ends_on_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "x string, y string")
    got = {tuple(r) for r in graph.closure(pairs, pairs.where("x = 'a'"), "x", "y", "x").collect()}
    assert got == {("a", "b"), ("a", "c")}


def test_a_long_line_of_bases_takes_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, label: made.append(label) or cut(df, label))
    n = 10_000
    bases = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("w", "unknown")], "className string, baseName string")
    own = spark.createDataFrame([("c0", "m0"), ("c5000", "m1"), ("y", "m2"), ("z", "m3"), ("s", "m4"), ("s", "m4"), ("unknown", "m5")], "className string, member string")
    got = {tuple(r) for r in graph.inherited(bases, own, "className", "baseName", "member").collect()}
    want = {(f"c{i}", "m0") for i in range(n)} | {(f"c{i}", "m1") for i in range(5000, n)} | {(a, m) for a in "xyz" for m in ("m2", "m3")} | {("s", "m4"), ("w", "m5"), ("unknown", "m5")}
    assert got == want and len(made) <= 2 + 2 * 15


def test_confirmation_looks_up_unsure_interface_edges_alone(spark, monkeypatch):
    kept = {}

    def noted(module):
        own = module.cut

        def run(df, label="step"):
            out = own(df, label)
            kept[label] = sorted(r[0] for r in out.collect())
            return out

        monkeypatch.setattr(module, "cut", run)

    noted(graph), noted(impact)
    edges = edges_of(spark, [("B", "A", "call", "f", 1, "interface"), ("B", "S", "call", "f", 1, "interface"), ("C", "B", "call", "f", 2, None), ("D", "C", "call", "f", 3, None), ("E", "S", "new", None, 4, "interface")])
    reached = graph.reach_depths(edges, spark.createDataFrame([("A",), ("S",)], "id string"), 2)
    used = graph.edges_used(edges, reached, 2)
    assert kept["open"] == ["A", "B", "E", "S"]
    symbols = spark.createDataFrame([(x, x, f"T{x}", i) for i, x in enumerate("ABCDES")], "id string, name string, containingType string, seq long")
    told = impact.with_confirmation(used, symbols, impact.confirmed_types(spark.createDataFrame([("T:TA",), ("T:TB",), ("T:TA",)], "impl string")), sites=edges)
    assert kept["targets"] == ["A", "S"] and kept["sure"] == ["A"]
    assert sorted((r["from"], r["to"], r["confirmed"]) for r in told.collect()) == [("B", "A", True), ("B", "S", False), ("C", "B", True), ("E", "S", True)]
