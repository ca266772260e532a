import json
import subprocess
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera import lineage
from tessera.operators import impact, project_map
from tessera.plans import build, reports
from tessera.sources import frontend, git_log, index
from tessera.streaming import snapshots
from tests.test_index import directory  # noqa: F401

EDGE = "`from` string, `to` string, kind string, file string, line int, via string, seq long"


def test_complete_scan(spark):
    symbols = spark.createDataFrame([("M:I.M", "P", "f", 0), ("M:A.M", "P", "f", 1), ("M:A.M", "Q", "g", 2)], "id string, project string, file string, seq long")
    edges = spark.createDataFrame([("M:X", "M:I.M", "call", "f", 1, None, 0)], EDGE)
    di = lambda *r: spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "seq long, service string, impl string")
    facts = build.Facts(symbols, edges, symbols, interface_members=spark.createDataFrame([("M:I.M", "M:A.M")], "iface_member string, impl_member string"), structural=di(("T:I", "T:A")), fluent=di(("T:I", "T:B")), attributes=di(("T:J", "T:B")), ambiguous=di(("T:I", "T:A")))
    got = build.complete_scan(facts, build.Config(di_overrides={"T:I": ["T:A"]}))
    assert [(r["to"], r["via"], r["pass"]) for r in got.edges.orderBy("pass").collect()] == [("M:I.M", None, 0), ("M:A.M", "interface", 1)]
    assert {r["service"]: r["impls"] for r in got.di_confirmed.collect()} == {"T:I": ["T:A", "T:B"], "T:J": ["T:B"]}
    assert [r["projects"] for r in got.diagnostics["duplicateDocIdsAcrossProjects"].collect()] == [["P", "Q"]]
    assert [r["impl"] for r in got.diagnostics["diRegistrationConflicts"].collect()] == ["T:B"]
    assert got.diagnostics["ambiguousDiTypes"].count() == 0


def test_history_without_tickets(spark):
    commits = spark.createDataFrame([(i, f"h{i}", "2026-01-01", "x", ["src/a.cs", "src/b.cs"], "") for i in range(3)], "seq long, hash string, date string, message string, files array<string>, body string")
    got = build.mine_history(commits, build.Config(), "src")
    assert got.tickets is None and [(r["fileA"], r["fileB"]) for r in got.co_change.collect()] == [("a.cs", "b.cs")]
    assert build.solution_prefix({"solutionPath": "src/a.sln"}) == "src" and build.solution_prefix({"solutionPath": "a.sln"}) is None


def test_config_discovery(tmp_path):
    (tmp_path / "tessera.config.json").write_text(json.dumps({"ticketPattern": "AB-\\d+"}))
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert build.Config.discover(str(tmp_path / "x" / "y")).ticket_pattern == "AB-\\d+"


def test_sync_publishes_and_drops_failed_tables(spark, directory, tmp_path):  # noqa: F811
    out = tmp_path / "published"

    def scan(staging):
        for p in directory.iterdir():
            (type(p)(staging) / p.name).write_bytes(p.read_bytes())

    def broken(staging):
        (type(tmp_path)(staging) / "co-change.jsonl").write_text("{}")
        raise RuntimeError("no git")

    steps = [("scan", True, scan, []), ("link", False, lambda s: build.link_step(index.load(spark, s), s), ["api-links.jsonl"]), ("scan-git", False, broken, ["co-change.jsonl"])]
    done = build.sync(str(out), "p", steps)
    assert [x["status"] for x in done] == ["ok", "ok", "failed"] and not (out / "co-change.jsonl").exists() and (out / "api-links.jsonl").exists()
    found = index.load(spark, str(out))
    assert "Map" in reports.map_report(build.map_tables(found))
    text = reports.impact_report("M:Svc.Cancel", impact.impact(found, "M:Svc.Cancel"))
    assert "Ctl.Post" in text and "Risk: 1 of 10" in text
    assert reports.human_notes("a<b>kept<e>z", "<b>", "<e>") == "kept"

    seen = []
    query = snapshots.on_publish(snapshots.markers(spark, str(tmp_path)), lambda df, epoch: seen.extend(r["project"] for r in df.collect()), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert seen == ["p"]


def test_docs_keep_what_people_wrote(spark, directory, tmp_path):  # noqa: F811
    with (directory / "symbols.jsonl").open("a") as f:
        for name in ("B", "A"):
            f.write(json.dumps({"id": f"T:{name}", "kind": "Class", "name": name, "project": "../Web", "file": "w.cs", "line": 4, "accessibility": "public"}) + "\n")

    def scan(staging):
        for p in directory.iterdir():
            (type(p)(staging) / p.name).write_bytes(p.read_bytes())

    out, docs = tmp_path / "site" / "index", tmp_path / "site"
    steps = [("scan", True, scan, []), ("docs", False, lambda s: build.docs_step(index.load(spark, s), s, str(docs)), [build.DOCS])]
    assert [x["status"] for x in build.sync(str(out), "p", steps, str(docs))] == ["ok", "ok"]
    page = docs / "modules" / "%2e.%2fWeb.md"
    assert page.read_text().splitlines()[:4] == ["# ../Web", "", "- Class A (w.cs:4)", "- Class B (w.cs:4)"]
    page.write_text(page.read_text().replace(reports.BEGIN, f"{reports.BEGIN} mine"))
    assert [x["status"] for x in build.sync(str(out), "p", steps, str(docs))] == ["ok", "ok"]
    assert f"{reports.BEGIN} mine\n{reports.END}" in page.read_text() and "# Map" in (docs / "MAP.md").read_text()
    assert project_map.module_types(index.load(spark, str(directory)).symbols, 1).select("name", "in_project").first()[:] == ("A", 2)


def test_slices(spark, directory, tmp_path):  # noqa: F811
    found = index.load(spark, str(directory))
    assert "No code: file missing (f.cs)" in build.slice_of(found, "M:Svc.Cancel", str(tmp_path))
    (tmp_path / "f.cs").write_text("one\ntwo ```\nthree")
    text = build.slice_of(found, "M:Svc.Cancel", str(tmp_path), lines=2)
    assert "f.cs:1\n\n````\none\ntwo ```\n````\n1 more lines" in text
    assert "[POST api/orders] -> Ctl.Post -> " in text
    assert "No caller outside tests" in build.slice_of(found, "M:Ctl.Post", str(tmp_path))
    assert "No code: not in index" in build.slice_of(found, "M:None", str(tmp_path))
    found.symbols = found.symbols.withColumn("file", F.lit("x/../../f.cs"))
    assert "No code: outside repository" in build.slice_of(found, "M:Svc.Cancel", str(tmp_path / "deep"))


def test_all_blind_spots(spark, directory):  # noqa: F811
    one = lambda **x: spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} long" for k in x))
    summary = one(inferred_routes=1, mediator_edges=2, interface_edges=3, override_edges=4, delegate_edges=5, unconfirmed_edges=6, inferred_only=7)
    quality = one(low_confidence=8, ambiguous=9, suffix=0)
    projects = spark.createDataFrame([("Web",), ("Web",), ("Api",)], "project string")
    none = projects.limit(0)
    got = {r["reason"]: r["n"] for r in impact.blind_spots(summary, projects.where("project = 'Web'"), quality, projects, known=none, meta=none).collect()}
    want = dict(zip(["inferred_routes", "mediator_edges", "interface_edges", "override_edges", "delegate_edges", "unconfirmed_interface_edges", "inferred_only_callers", "low_confidence_screens", "ambiguous_screens"], range(1, 10)))
    assert got == want | {"degraded_projects": 1, "unknown_symbol": 1, "no_meta": 1}
    assert {r["reason"] for r in impact.blind_spots(summary, none, quality, projects, known=projects, meta=projects).collect()} == set(want)


def test_blind_spots_of_a_map(spark, directory):  # noqa: F811
    tables = build.map_tables(index.load(spark, str(directory)))
    spots = {"unresolved": spark.createDataFrame([(f"B{i:02}", 2, "f.cs", 1) for i in range(27)], "name string, n long, file string, line int"), "duplicates": spark.createDataFrame([("T:A", ["P", "Q"])], "id string, projects array<string>")}
    text = reports.map_report(tables | spots)
    assert "- B24: 2, first in f.cs:1\n- ..." in text and "B25" not in text and "- T:A: P, Q" in text and "failed to load" not in text


def test_repository_through_the_shared_folder(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for i, name in enumerate(("a b.cs", "é.cs")):
        (tmp_path / name).write_text(f"{i}\n" * 9)
        git("add", "-A")
        git("commit", "-q", "-m", f"#{100 + i} change")
    found = {r["message"]: r["files"] for r in build.read_repository(spark, str(tmp_path)).collect()}
    assert found == {"#100 change": ["a b.cs"], "#101 change": ["é.cs"]}
    assert git_log.commit_count(str(tmp_path)) == 2 and git_log.root(str(tmp_path)) == str(tmp_path.resolve())
    assert git_log.changed_since(str(tmp_path), "HEAD~1") == ["é.cs"]
    (tmp_path / "a b.cs").write_text("new")
    git("mv", "é.cs", "e.cs")
    (tmp_path / "x.cs").write_text("")
    assert sorted(git_log.uncommitted(str(tmp_path))) == ["a b.cs", "e.cs", "x.cs", "é.cs"]
    assert git_log.commit_count(str(tmp_path / "none")) is None and git_log.uncommitted(str(tmp_path / "none")) is None


def test_skipped_sources_are_not_read(spark, tmp_path):
    root = tmp_path / "bin +é"
    for name in ("a.js", "sub dir/b+c.cshtml", "node_modules/x/d.js", "e.min.js", "wwwroot/lib/f.js", "g.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    got = frontend.read_sources(spark, str(root))
    assert {r["path"]: r["text"] for r in got.collect()} == {n: n for n in ("a.js", "sub dir/b+c.cshtml")}


def test_no_shared_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://m:1", getConf=dict, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        lineage.shared_dir(SimpleNamespace(sparkContext=context))
