"""Expansions in two halves against those with all their edges."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import factored, graph, impact, scan_passes
from tessera.plans import lens_queries
from tessera.plans.lens import Lens


def tables(spark, seed):
    r = random.Random(seed)
    node = lambda: f"n{r.randrange(12)}"
    edges = [(node(), node(), r.choice(["call", "call", "new", "read"]), f"f{r.randrange(2)}", r.randrange(3), None, i) for i in range(40)]
    members = [(f"n{r.randrange(4)}", node()) for _ in range(10)] + [("n1", "n1")]
    sends = [(node(), r.randrange(3), "m", r.randrange(3)) for _ in range(8)]
    handlers = [(r.randrange(4), node()) for _ in range(6)]
    calls = [(node(), f"n{r.randrange(3)}", "v", r.randrange(2), r.choice("xy")) for _ in range(12)]
    overrides = [(node(), node(), r.choice([["x"], ["y"], ["x", "y"], []])) for _ in range(10)]
    df = spark.createDataFrame
    return (
        df(edges, "`from` string, `to` string, kind string, file string, line int, via string, seq long"), df(members, "iface_member string, impl_member string"), df(sends, "`from` string, request int, file string, line int"),
        df(handlers, "request int, handler string"), df(calls, "`from` string, `to` string, file string, line int, receiver string"), df(overrides, "overridden string, override string, types array<string>"),
    )


@pytest.mark.parametrize("seed", range(2))
def test_two_halves_are_the_whole(spark, seed):
    edges, members, sends, handlers, calls, overrides = tables(spark, seed)
    more = [scan_passes.interface_edges(edges, members), scan_passes.mediator_edges(sends, handlers), scan_passes.override_edges(calls, overrides)]
    parts = [factored.interface_calls(edges, members), factored.mediator_sends(sends, handlers), factored.override_calls(calls, overrides)]
    rows = lambda df: sorted(map(repr, map(tuple, df.select(*scan_passes.EDGE).collect())))
    for whole, f in zip(more, parts):
        assert rows(f.edges()) == rows(whole)
    f = parts[0].union(parts[1]).union(parts[2])
    f = factored.Factored(edges.select(*scan_passes.EDGE).unionByName(f.plain), f.sites, f.members).kept()
    whole = edges.select(*scan_passes.EDGE)
    for m in more:
        whole = whole.unionByName(m.select(*scan_passes.EDGE))
    whole = whole.cache()
    root = spark.createDataFrame([("n0",), ("n0",)], "id string")
    for depth in (0, 2):
        reached = graph.reach_depths(whole, root, depth)
        ours = factored.reach_depths(f, root, depth)
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, reached.collect()))
        used = graph.edges_used(whole, reached, depth).groupBy("via").agg(F.count("*").alias("n"))
        assert sorted(map(repr, map(tuple, factored.edges_used(f, ours, depth).collect()))) == sorted(map(repr, map(tuple, used.collect())))
    fans = impact.fan_in(whole).select("to", "direct_fan_in", "inferred_only")
    got = factored.fan_in(f, impact.is_expansion(F.col("via"))).select("to", "direct_fan_in", "inferred_only")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fans.collect()))
    symbols = spark.createDataFrame([(f"n{i}", f"T{i % 4}", i) for i in range(11)], "id string, containingType string, seq long")
    bound = spark.createDataFrame([("T1",), ("T2",)], "containing string")
    sure = graph.propagate(impact.with_confirmation(whole, symbols, bound), root, F.col("confirmed"))
    mine = factored.confirmed_reach(f, root, bound, symbols.select("id", F.col("containingType").alias("containing")))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, sure.collect()))


def test_rows_are_calls_and_members(spark):
    calls = spark.createDataFrame([(f"c{i}", "I.M", "call", "f", i, None) for i in range(60)], "`from` string, `to` string, kind string, file string, line int, via string")
    members = spark.createDataFrame([("I.M", f"x{i}") for i in range(50)] * 2, "iface_member string, impl_member string")
    f = factored.interface_calls(calls, members)
    assert (f.sites.count(), f.members.count(), f.expanded().count()) == (60, 50, 3000)
    assert factored.sizes(f).first().asDict() == {"via": "interface", "sites": 60, "members": 50, "edges": 3000}


def test_nothing_to_expand(spark):
    edges, members, sends, handlers, calls, overrides = (t.limit(0) for t in tables(spark, 0))
    f = factored.interface_calls(edges, members).union(factored.mediator_sends(sends, handlers)).union(factored.override_calls(calls, overrides))
    assert f.edges().count() == 0 and factored.fan_in(f, F.lit(False)).count() == 0
    assert [tuple(r) for r in factored.reach_depths(f, spark.createDataFrame([("a",)], "id string"), 3).collect()] == [("a", 0)]


def test_callers_are_counted_by_their_sets_of_hubs(spark, monkeypatch):
    sites = [(f"c{i}", f"h{h}", "call", "f", h, "interface") for i in range(200) for h in (0, 1 + i % 2)]
    members = [(f"h{h}", f"x{i}") for i in range(40) for h in range(3) if (i + 1) & 1 << h or h == 0]
    plain = [("c1", "x1", "call", "f", 9, None), ("x2", "x3", "new", "f", 9, None), ("c0", "c1", "call", "f", 9, None)]
    schema = "`from` string, `to` string, kind string, file string, line int, via string"
    f = factored.Factored(spark.createDataFrame(plain, schema), spark.createDataFrame(sites + [("x5", *sites[0][1:])], schema.replace("`to`", "hub")), spark.createDataFrame(members, "hub string, `to` string"))
    written, write = [], factored.cut

    def counted(df, label="step"):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(factored, "cut", counted)
    got = sorted(map(tuple, factored.fan_in(f, impact.is_expansion(F.col("via"))).collect()))
    assert got == sorted(map(tuple, impact.fan_in(f.edges()).collect())) and len(got) == 41
    assert max(written) <= 201


def test_calls_are_dealt_before_they_are_expanded(spark):
    one = spark.createDataFrame([(f"c{i}", "I", "call", "f", i, None) for i in range(400)], "`from` string, `to` string, kind string, file string, line int, via string").coalesce(1)
    made = scan_passes.interface_edges(one, spark.createDataFrame([("I", f"x{i}") for i in range(30)], "iface_member string, impl_member string"))
    parts = made.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 12000 and len(parts) > spark.sparkContext.defaultParallelism
    calls = spark.createDataFrame([("c", "A", "f", 1, "x"), ("c", "A", "f", 1, "y"), ("d", "A", "f", 1, "x"), ("d", "A", "f", 1, "x")], "`from` string, `to` string, file string, line int, receiver string")
    overrides = spark.createDataFrame([("A", "B", ["x", "y"]), ("A", "C", ["x"])], "overridden string, override string, types array<string>")
    assert sorted((r["from"], r["to"]) for r in scan_passes.override_edges(calls, overrides).collect()) == [("c", "B"), ("c", "C"), ("d", "B"), ("d", "C")]


def test_edges_are_not_written_again(spark, sf, monkeypatch):
    written, kept = {}, factored.cut

    def counted(df, label="step"):
        out = kept(df, label)
        written[label] = max(out.count(), written.get(label, 0))
        return out

    monkeypatch.setattr(factored, "cut", counted)
    v = Lens(spark, sf)
    assert lens_queries.QUERIES["expanded_confirmed"](spark, sf).count() > 1
    assert written["sites"] > 0 and written.get("plain", 0) < v.t("lineitem").count()


def test_expansions_in_short_cycles_are_those_of_a_join(spark, monkeypatch):
    edges, members, sends, handlers, calls, overrides = tables(spark, 3)
    plain = edges.where("kind = 'call'").join(members.distinct().toDF("to", "impl"), "to").where("to <> impl").select("from", F.col("impl").alias("to"), "kind", "file", "line")
    sent = sends.join(handlers.distinct(), "request").select("from", F.col("handler").alias("to"), F.lit("call").alias("kind"), "file", "line")
    rows = lambda df: sorted(map(repr, map(tuple, df.select("from", "to", "kind", "file", "line").collect())))
    made = lambda: (rows(scan_passes.interface_edges(edges, members)), rows(scan_passes.mediator_edges(sends, handlers)), rows(scan_passes.override_edges(calls, overrides)))
    want = made()
    assert want[:2] == (rows(plain), rows(sent)) and min(map(len, want)) > 5
    for name, n in {"CALLS_TOGETHER": 2, "MEMBERS_TOGETHER": 5, "CYCLE": 2, "EDGES_OF_TASK": 10}.items():
        monkeypatch.setattr(scan_passes, name, n)
    assert made() == want


def test_expansions_are_small_on_disk(spark, tmp_path, monkeypatch):
    """Runs of a call over short cycles of members; with all members after each call a file keeps a number for each row."""
    monkeypatch.setattr(scan_passes, "WAVES", 1)
    edges = spark.createDataFrame([(f"c{i * 7919}", "I", "call", "f", i, None) for i in range(120)], "`from` string, `to` string, kind string, file string, line int, via string")
    members = spark.createDataFrame([("I", f"x{i * 7919}") for i in range(10_000)], "iface_member string, impl_member string")
    path = tmp_path / "edges"
    scan_passes.interface_edges(edges, members).write.parquet(str(path))
    assert spark.read.parquet(str(path)).distinct().count() == 1_200_000
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 1_200_000 * 0.8
