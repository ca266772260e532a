"""Edges keep the order in which a scan emits them, also after they were written and read."""

import random

from pyspark.sql import functions as F

from tessera.operators import scan_passes
from tessera.plans import build
from tessera.sources import index


def test_edges_keep_the_order_of_passes_calls_and_members(spark, tmp_path):
    r = random.Random(2)
    edges = [(f"c{i}", f"I{r.randrange(3)}", "call", "f", i, None, i) for i in range(20)]
    members = [(f"I{r.randrange(3)}", f"x{r.randrange(9)}", i) for i in range(15)]
    virtual = [(f"v{i}", "B", "g", i % 4, "t", 100 - i) for i in range(8)] * 2
    overrides = [("B", "D1", ["t"]), ("B", "D2", ["t"]), ("D1", "D0", ["t"])]
    df = spark.createDataFrame
    one = df(edges, "`from` string, `to` string, kind string, file string, line int, via string, seq long").repartition(5)
    two = scan_passes.interface_edges(one, df(members, "iface_member string, impl_member string, member_seq long").repartition(3), ordered=True)
    three = scan_passes.override_edges(df(virtual, "`from` string, `to` string, file string, line int, receiver string, seq long").repartition(4), df(overrides, "overridden string, override string, types array<string>"), ordered=True)
    index.write_lines(scan_passes.complete_edges(one, two, three), str(tmp_path / "edges.jsonl"))
    rows = spark.read.json(str(tmp_path / "edges.jsonl")).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    first = {}
    for a, b, n in members:
        first.setdefault((a, b), n)
    want = [(a, b, None) for a, b, *_ in edges]
    for a, b, *_ in edges:
        want += [(a, x, "interface") for x in sorted((x for i, x in first if i == b), key=lambda x: first[b, x])]
    for v in sorted(set(virtual), key=lambda v: v[5]):
        want += [(v[0], d, "override") for d in ("D0", "D1", "D2")]
    assert [(x["from"], x["to"], x["via"]) for x in rows] == want


def test_maps_tell_what_they_cannot_see(spark, tmp_path):
    lists = {
        "duplicateDocIdsAcrossProjects": spark.createDataFrame([("T:A", ["P", "Q"], ["f"])], "id string, projects array<string>, files array<string>"),
        "unresolvedBases": spark.createDataFrame([(2, "B", "g", 5), (1, "B", "f", 7)], "seq long, name string, file string, line int"),
    }
    index.write_diagnostics(lists, str(tmp_path / "diagnostics"))

    class Found:
        meta = spark.createDataFrame([(["Web", "Api"],)], "degradedProjects array<string>")

    got = build.blind_tables(Found, str(tmp_path / "diagnostics"))
    assert [r[0] for r in got["degraded"].collect()] == ["Api", "Web"] and got["duplicates"].first()["projects"] == ["P", "Q"]
    assert got["unresolved"].first()[:] == ("B", 2, "f", 7)
    Found.meta = Found.meta.limit(0)
    assert build.blind_tables(Found, str(tmp_path / "nothing")) == {}
