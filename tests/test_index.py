import json

import pytest

from tessera import schemas
from tessera.operators import impact, project_map, status
from tessera.sources import index


def symbol(i, project="P", name="N", containing="T", file="f.cs"):
    return {"id": i, "kind": "Method", "name": name, "containingType": containing, "project": project, "file": file, "line": 1, "accessibility": "public", "attributes": []}


def write(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n", encoding="utf-8")


@pytest.fixture
def directory(tmp_path):
    d = tmp_path / "index"
    d.mkdir()
    write(d / "symbols.jsonl", [symbol("M:Svc.Cancel", "Orders", "Cancel", "Svc"), "", "not json", {"id": "M:x"}, symbol("M:Ctl.Post", "Web", "Post", "Ctl"), symbol("M:Svc.Cancel", "Copy", "Cancel", "Svc"), symbol("M:T.Test", "Web.Tests", "Test", "T")])
    write(d / "edges.jsonl", [{"from": "M:Ctl.Post", "to": "M:Svc.Cancel", "kind": "call", "file": "c.cs", "line": 3}, {"from": "M:T.Test", "to": "M:Ctl.Post", "kind": "call", "file": "t.cs", "line": 5}])
    (d / "entrypoints.json").write_text(json.dumps([{"id": "M:Ctl.Post", "type": "http", "httpMethod": "POST", "route": "api/orders"}]))
    (d / "di-confirmed.json").write_text(json.dumps({"T:I": ["T:Svc", "T:Other"]}))
    (d / "meta.json").write_text(json.dumps({"indexedAt": "2026-01-01T00:00:00Z", "gitCommit": "ABC", "solutionPath": "a.sln", "projectCount": 2, "degradedProjects": ["Web"], "symbolCount": 4, "edgeCount": 2}))
    return d


def test_load_skips_malformed_rows(spark, directory):
    found = index.load(spark, str(directory))
    assert found.symbols.count() == 4 and found.warnings.count() == 2
    assert found.frontend_calls.count() == 0 and found.di_confirmed.count() == 2
    first = impact.first_rows(found.symbols).where("id = 'M:Svc.Cancel'").first()
    assert first["project"] == "Orders"


def test_missing_symbols_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path))


def test_impact_end_to_end(spark, directory):
    got = impact.impact(index.load(spark, str(directory)), "M:Svc.Cancel", 5)
    s = got.summary.first()
    assert (s["entry_points"], s["confirmed"], s["tests"], s["intermediates"], s["direct_fan_in"], s["risk"], s["hub"]) == (1, 1, 1, 0, 1, 1, False)
    assert [r["display"] for r in got.entry_points.collect()] == ["Ctl.Post"] and [r["project"] for r in got.modules.collect()] == ["Web"]


def test_round_trip_and_diagnostics(spark, directory, tmp_path):
    found = index.load(spark, str(directory))
    index.write_lines(found.edges, str(tmp_path / "edges.jsonl"))
    again, bad = index.read_lines(spark, str(tmp_path / "edges.jsonl"), schemas.EDGES, ["from", "to"])
    assert again.drop("seq").exceptAll(found.edges.drop("seq")).count() == 0 and bad.count() == 0
    path = str(tmp_path / "diagnostics")
    rows = spark.createDataFrame([("a",)], "name string")
    index.write_diagnostics({"x": rows, "y": rows}, path)
    index.write_diagnostics({"x": rows.union(rows)}, path)
    assert {r["list"]: r["count"] for r in spark.read.parquet(path).groupBy("list").count().collect()} == {"x": 2, "y": 1}


def test_publish_and_recover(tmp_path):
    out, staging = tmp_path / "out", tmp_path / "staging"
    for d, n in ((out, "old"), (staging, "new")):
        d.mkdir()
        (d / "v").write_text(n)
    with pytest.raises(ValueError):
        index.publish(str(staging), str(out))
    index.write_marker(str(staging), "p", [{"name": "scan", "status": "ok"}])
    index.publish(str(staging), str(out))
    assert (out / "v").read_text() == "new" and index.fingerprint(str(out)) == index.read_marker(str(out))["syncId"]
    (out / "sync-complete.json").write_text("{")
    assert isinstance(index.read_marker(str(out)), str)


def test_status(spark, directory):
    meta = index.load(spark, str(directory)).meta
    assert status.freshness(meta, "abc", 0).first()["state"] == "AtScannedCommit"
    assert status.freshness(meta, "def", 2).first()["state"] == "Behind"
    assert status.freshness(meta, None, 0).first()["state"] == "GitUnavailable"
    assert status.freshness(meta.limit(0), "x", 0).first()["state"] == "NoMeta"
    assert [r[0] for r in status.degraded_projects(None, meta).collect()] == ["Web"]


def test_entry_points_are_capped_by_project(spark):
    symbols = spark.createDataFrame([(f"m{i}", "P", i) for i in range(32)], "id string, project string, seq long")
    entries = spark.createDataFrame([(f"m{i}", i) for i in range(32)], "id string, seq long")
    got = project_map.entry_points_by_project(entries, symbols).collect()
    assert len(got) == 30 and {r["not_shown"] for r in got} == {2}
