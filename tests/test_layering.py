"""Layers against a single-threaded depth-first visit."""

import random

import pytest

from tessera.operators import layering


def visit(pairs, names):
    below = {}
    for a, b in sorted(set(pairs)):
        below.setdefault(a, []).append(b)
    found = {}

    def go(n, active):
        best = -1
        for b in below.get(n, []):
            best = max(best, found.get(b, 0) if b in found or b in active else go(b, active | {b}))
        found[n] = best + 1
        return found[n]

    for n in sorted(names):
        if n not in found:
            go(n, {n})
    return {n: found[n] for n in names}


def run(spark, pairs, names):
    deps = spark.createDataFrame(pairs, "from_project string, to_project string")
    rows = layering.layers(deps, spark.createDataFrame([(n,) for n in names], "project string")).collect()
    assert len(rows) == len(set(names))
    return {r["project"]: r["layer"] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_with_cycles(spark, seed):
    r = random.Random(seed)
    names = [f"p{r.randrange(100)}" for _ in range(18)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range((14, 20, 26, 34)[seed])]
    assert run(spark, pairs, names) == visit(pairs, set(names))


def test_cycles_behind_cycles(spark):
    # the cycle of x, y and z is entered from the middle of another one, by its least path
    pairs = [("a", "m"), ("m", "n"), ("n", "m"), ("n", "y"), ("m", "z"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "end"), ("b", "x"), ("end", "end"), ("solo", "solo"), ("a", "a")]
    names = sorted({x for p in pairs for x in p} | {"free"})
    assert run(spark, pairs * 2, names) == visit(pairs, names)
    # only some are nodes
    assert run(spark, pairs, ["b", "free", "x"]) == visit(pairs, ["b", "free", "x"])


def test_no_dependencies(spark):
    assert run(spark, [], ["a", "b"]) == {"a": 0, "b": 0} and run(spark, [], []) == {}


def test_many_dependencies(spark):
    r = random.Random(9)
    level = lambda i: f"l{i}-{r.randrange(12_000):05d}"
    pairs = list({(level(i), level(i + 1)) for i in (0, 1, 2) for _ in range(67_000)}) + [("l3-00001", "l3-00002"), ("l3-00002", "l3-00001"), ("l3-00001", "l4-x")]
    names = sorted({x for p in pairs for x in p})
    assert len(pairs) > 190_000 and run(spark, pairs, names) == visit(pairs, names)
