import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.operators import frontend, history, link, scan_passes
from tessera.sources import frontend as sources
from tessera.sources import git_log


def commits_of(spark, baskets):
    return spark.createDataFrame([(i, f"h{i}", "2026-01-01", "fix #123", b, "") for i, b in enumerate(baskets)], "seq long, hash string, date string, message string, files array<string>, body string")


def test_co_change_counts(spark):
    rows = [["a.cs", "b.cs"]] * 3 + [["a.cs"]] + [["c.cs", "d.cs"]] * 2 + [[f"x{i}.cs" for i in range(101)]] * 3 + [["a.cs", "b.md"]]
    got = [tuple(r) for r in history.co_change(commits_of(spark, rows)).collect()]
    assert got == [("a.cs", "b.cs", 3, 5, 3, 1.0)]


def test_strength_rounds_half_even(spark):
    rows = [["a.cs", "b.cs"]] * 23 + [["a.cs"]] * 17 + [["b.cs"]] * 30
    assert history.co_change(commits_of(spark, rows)).first()["strength"] == 0.57


def test_tickets_take_the_newest_commit(spark):
    df = spark.createDataFrame([(0, "h0", "2026-02-02", "new #300", ["b.cs"], ""), (1, "h1", "2026-01-01", "old", ["a.cs", "a.md"], "closes #300"), (2, "h2", "2025-01-01", "only docs #301", ["a.md"], "")], "seq long, hash string, date string, message string, files array<string>, body string")
    got = [tuple(r) for r in history.tickets(df, r"#\d{3,6}").collect()]
    assert got == [("#300", ["h0", "h1"], "2026-02-02", "new #300", ["a.cs", "b.cs"])]
    assert history.pattern_matches(df, r"#\d+") and not history.pattern_matches(df, r"XX-\d+")


def test_renames_chain_and_reuse(spark):
    renames = spark.createDataFrame([(1, "b", "c"), (5, "a", "b"), (9, "c", "d")], "seq long, old string, new string")
    paths = spark.createDataFrame([(0, "c"), (2, "b"), (6, "a"), (1, "b"), (10, "c"), (7, "z")], "seq long, path string")
    got = {(r["seq"], r["path"]): r["now"] for r in history.resolve_renames(paths, renames).collect()}
    assert got == {(0, "c"): "c", (2, "b"): "c", (6, "a"): "c", (1, "b"): "b", (10, "c"): "d", (7, "z"): "z"}


def test_git_log_end_to_end(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.cs").write_text("one\ntwo\nthree\nfour\n")
    (repo / "đơn.cs").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "first #123\n\nbody | line")
    git("mv", "a.cs", "b.cs")
    git("commit", "-qm", "rename")
    (repo / "b.cs").write_text("one\ntwo\nthree\nfour\nfive\n")
    git("commit", "-qam", "edit #124")
    git_log.write_log(str(repo), str(tmp_path / "log"))
    got = git_log.commits(git_log.parse_log(spark, str(tmp_path / "log"))).orderBy("seq").collect()
    assert [(r["message"], r["files"]) for r in got] == [("edit #124", ["b.cs"]), ("rename", ["b.cs"]), ("first #123", ["b.cs", "đơn.cs"])]
    assert got[2]["body"] == "body | line" and git_log.head(str(repo)) == got[0]["hash"]
    assert git_log.head(str(tmp_path / "none")) is None


ENTRY = "id string, type string, httpMethod string, route string, routeInferred boolean, seq long"
CALL = "id string, httpMethod string, route string, baseUrlDropped boolean, seq long"


@pytest.mark.parametrize(
    "endpoints, call, want",
    [
        ([("b", "GET", "api/orders/{id}", False)], ("GET", "api/orders/{*}", False), [("b", "exact")]),
        ([("b", "GET", "api/o/{id}", False), ("c", "GET", "api/o/{key}", False)], ("GET", "api/o/{*}", False), [("b", "ambiguous"), ("c", "ambiguous")]),
        ([("b", "GET", "api/orders", False)], ("GET", "orders", True), [("b", "suffix")]),
        ([("b", "GET", "api/orders", False)], ("GET", "orders", False), []),
        ([("b", "GET", "api/reorders", False)], ("GET", "orders", True), []),
        ([("b", "POST", "api/orders", False)], ("GET", "orders", True), []),
        ([("b", "GET", "api/{id}", False)], ("GET", "{*}", True), []),
        ([("b", "ANY", "api/o", False), ("c", "POST", "api/o", False)], ("POST", "api/o", False), [("c", "exact")]),
        ([("b", "ANY", "api/o", False)], ("PUT", "api/o", False), [("b", "exact")]),
        ([("b", "GET", "api/o/{id?}", False)], ("GET", "api/o", False), [("b", "exact")]),
        ([("b", "GET", "home/index", True)], ("GET", "home", False), [("b", "exact")]),
    ],
)
def test_links(spark, endpoints, call, want):
    e = spark.createDataFrame([(i, "http", m, r, inf, n) for n, (i, m, r, inf) in enumerate(endpoints)], ENTRY)
    c = spark.createDataFrame([("fe:1", *call, 0)], CALL)
    got = link.link(e, c)
    assert sorted((r["backendId"], r["matchKind"]) for r in got.links.collect()) == want
    assert got.unmatched.count() == (not want)
    assert {r["id"] for r in got.unreferenced.collect()} == {i for i, *_ in endpoints} - {b for b, _ in want}


def test_frontend_scan(spark):
    files = spark.createDataFrame([("js/a.js", "$.get('/api/x');\n$.ajax(options);"), ("node_modules/b.js", "$.get('/y')"), ("a.min.js", "$.get('/z')"), ("V/i.cshtml", "<p>$.get('/n')</p>\n<script>jQuery.post(\"/v/@Model.Id\")</script>"), ("wwwroot/lib/q.js", "$.get('/w')"), ("e.js", None)], "path string, text string")
    got = sorted((r["file"], r["line"], r["httpMethod"], r["rawUrl"], r["reason"]) for r in sources.scan(files).collect())
    assert got == [("V/i.cshtml", 2, "POST", '"/v/@Model.Id"', "a Razor expression"), ("js/a.js", 1, "GET", "'/api/x'", None), ("js/a.js", 2, "GET", None, "no URL")]
    high = spark.createDataFrame([("src/app/o/s.ts", 3, "delete", "`/api/o/${id}`", [], False)], "file string, line int, httpMethod string, rawUrl string, injectedBy array<string>, is_component boolean")
    done = frontend.complete(high, sources.scan(files))
    assert sorted(r["route"] for r in done.calls.collect()) == ["api/o/{*}", "api/x"]
    assert done.unparsed.count() == 2 and [r["id"] for r in done.uninjected.collect()] == ["fe:src/app/o/s.ts:3"]


def test_override_expansion_bounds_by_receiver(spark):
    calls = spark.createDataFrame([("m", "A.M", "f", 1, "C")], "`from` string, `to` string, file string, line int, receiver string")
    overrides = spark.createDataFrame([("A.M", "B.M", ["B", "A"]), ("B.M", "C.M", ["C", "B", "A"]), ("A.M", "D.M", ["D", "A"])], "overridden string, override string, types array<string>")
    assert [r["to"] for r in scan_passes.override_edges(calls, overrides).collect()] == ["C.M"]


def test_interface_expansion_keeps_to_calls(spark):
    edges = spark.createDataFrame([("x", "I.M", "call", "f", 1, None), ("x", "I.M", "read", "f", 2, None)], "`from` string, `to` string, kind string, file string, line int, via string")
    members = spark.createDataFrame([("I.M", "A.M"), ("I.M", "A.M"), ("I.M", "I.M")], "iface_member string, impl_member string")
    assert [(r["to"], r["via"], r["line"]) for r in scan_passes.interface_edges(edges, members).collect()] == [("A.M", "interface", 1)]


def test_rebase(spark):
    df = spark.createDataFrame([("SRC/app/x.cs",), ("other/y.cs",)], "p string")
    assert [r[0] for r in df.select(history.rebased(F.col("p"), "src/app")).collect()] == ["x.cs", "../../other/y.cs"]
