import json
from types import SimpleNamespace

import pytest

from tessera.operators import status
from tessera.sources import index, solution


def test_solutions(spark, tmp_path):
    (tmp_path / "a.sln").write_text('x\nProject("{1}") = "Web", "src\\\\Web\\\\Web.csproj", "{2}"\nEndProject\nProject("{1}") = "docs", "docs", "{3}"\n')
    assert [tuple(r) for r in solution.read_sln(spark, str(tmp_path / "a.sln")).collect()] == [("Web", "src\\\\Web\\\\Web.csproj")]
    (tmp_path / "b.slnx").write_text('<Solution><Folder Name="/x/"><Project Path="src/A/A.B.csproj" /></Folder><Project Path="C.csproj" /><Project Path="d.esproj" /></Solution>')
    assert sorted(tuple(r) for r in solution.read_slnx(spark, str(tmp_path / "b.slnx")).collect()) == [("A.B", "src/A/A.B.csproj"), ("C", "C.csproj")]


def test_registry(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert solution.read_registry(str(deep), home=str(tmp_path / "none")) == []
    (tmp_path / "a" / solution.REGISTRY).write_text(json.dumps({"projects": [{"name": "One"}]}))
    assert solution.read_registry(str(deep)) == [{"name": "One"}]
    (deep / "own.json").write_text(json.dumps({"projects": [{"name": "x"}, {"name": "X"}]}))
    with pytest.raises(ValueError):
        solution.read_registry(str(deep), given=str(deep / "own.json"))


@pytest.mark.parametrize("workspace, want", [("/r/app/src/x", {("a", 1)}), ("/r/app", {("a", 2), ("b", 2)}), ("/r", {("a", 4), ("b", 4)}), ("/fe/B", {("b", 3)}), ("/other", set()), ("/r/application", set())])
def test_workspaces(spark, workspace, want):
    rows = [("a", "/r/app/src", "/r/app", None), ("b", "/r/app/lib/", "/R/app", "/fe/b"), ("c", None, None, "")]
    found = solution.projects_of(spark.createDataFrame(rows, "name string, solution_dir string, repo string, frontend string"), workspace)
    assert {(r["name"], r["rule"]) for r in found.collect()} == want


def test_index_is_written_and_read(spark, tmp_path):
    symbols = spark.createDataFrame([("M:A.x", "Method", "x", "A", "p", "f.cs", 3, "public", 0)], "id string, kind string, name string, containingType string, project string, file string, line int, accessibility string, seq long")
    rows = [("M:b", "M:c", "call", "f", 1, "interface", 1, 5), ("M:a", "M:b", "call", "f", 1, None, 0, 9), ("M:z", "M:b", "call", "f", 2, None, 0, 4)]
    edges = spark.createDataFrame(rows, "`from` string, `to` string, kind string, file string, line int, via string, pass int, seq long")
    points = spark.createDataFrame([("M:A.x", "http", "GET", "a", None, 0), ("M:A.y", "job", None, None, None, 1)], "id string, type string, httpMethod string, route string, routeInferred boolean, seq long")
    di = spark.createDataFrame([("T:I", ["T:A", "T:B"]), ("T:J", ["T:C"])], "service string, impls array<string>")
    index.write_index(SimpleNamespace(symbols=symbols, edges=edges, entry_points=points, di=di, di_confirmed=di, diagnostics={"d": di}), str(tmp_path))
    found = index.load(spark, str(tmp_path))
    assert [r["from"] for r in found.edges.orderBy("seq").collect()] == ["M:z", "M:a", "M:b"]
    assert found.entry_points.count() == 2 and found.symbols.count() == 1
    assert index.origin(str(tmp_path)) == "files" and index.fingerprint(str(tmp_path))
    assert {tuple(r) for r in found.di_confirmed.collect()} == {("T:I", "T:A"), ("T:I", "T:B"), ("T:J", "T:C")}


def test_lines():
    assert status.index_line(None, False) != status.index_line(None, True) != status.index_line("bad", True)
    assert status.index_line({"symbolCount": 2, "edgeCount": 3, "projectCount": 1, "degradedProjects": ["x"]}, True, 4) == "index: 2 symbols, 3 edges, 1 projects, 4 days old, 1 degraded"
    assert status.sync_line({"metaIndexedAt": "a", "steps": [{"name": "git", "status": "failed"}]}, "a") == "sync: complete, but for git"
    assert status.sync_line({"metaIndexedAt": "a"}, "b") == "sync: the index has changed since" and status.sync_line(None, None) == "sync: none is complete"
    assert status.freshness_line("AtScannedCommit", 0) == "" and "2 relevant" in status.freshness_line("Behind", 2)


def test_reasons_for_missing_code(spark):
    symbols = spark.createDataFrame([("a", "x.cs", 2), ("b", "../y.cs", 1), ("c", "z.cs", 1), ("d", "x.cs", 9), ("e", "/r/x.cs", 1)], "id string, file string, line int")
    sources = spark.createDataFrame([("x.cs", "one\ntwo"), ("/r/x.cs", "")], "file string, text string")
    got = {r["id"]: (r["text"], r["missing"]) for r in status.live_code(spark.createDataFrame([(i,) for i in "abcdef"], "id string"), symbols, sources, "/r").collect()}
    assert got == {"a": ("one\ntwo", None), "b": (None, "outside repository"), "c": (None, "file missing"), "d": (None, "not located"), "e": ("", None), "f": (None, "not in index")}


@pytest.mark.parametrize("path, want", [("x/y", True), ("", True), ("x/../y", True), ("../ab", False), ("x/../../b", False), ("/a", False), ("/r/a/b", True), ("/r/ab", False)])
def test_paths_inside(path, want):
    assert index.inside("/r/a/", path) == want


def test_one_sync_at_a_time(tmp_path):
    with index.locked(str(tmp_path / "out")):
        with pytest.raises(RuntimeError):
            with index.locked(str(tmp_path / "out")):
                pass
    with index.locked(str(tmp_path / "out")):
        pass


def test_docs_are_replaced_and_others_stay(tmp_path):
    for name, text in {"new/MAP.md": "a", "new/modules/P.md": "b", "new/x.txt": "", "old/MAP.md": "c", "old/modules/Q.md": "d"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert index.publish_docs(str(tmp_path / "new"), str(tmp_path / "old")) == ["MAP.md", "modules/P.md"]
    assert [(tmp_path / "old" / n).read_text() for n in ("MAP.md", "modules/P.md", "modules/Q.md")] == ["a", "b", "d"]
    assert index.publish_docs(str(tmp_path / "none"), str(tmp_path / "old")) == []
