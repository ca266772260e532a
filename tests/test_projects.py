import fnmatch
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import projects

FILES = ["a.cs", "b.txt", "sub/c.cs", "sub/deep/d.cs", "sub/bin/e.cs", "bin/f.cs", "OBJ/g.cs", "obj/x/h.cs", "bin.cs", "sub/100%_.cs", "../lib/l.cs", "../lib/x/m.cs", "../lib/bin/n.cs", "../P.Tests/o.cs"]


def project(body, sdk=True):
    head = '<Project Sdk="Microsoft.NET.Sdk">' if sdk else '<?xml version="1.0" encoding="utf-8"?>\n<Project ToolsVersion="15.0" xmlns="http://schemas.microsoft.com/developer/msbuild/2003">'
    return f"{head}{body}</Project>"


def items(*pairs):
    return "<ItemGroup>" + "".join(f'<Compile {kind}="{value}" />' for kind, value in pairs) + "</ItemGroup>"


def compiled(spark, text, files=FILES, root="/r/P", name="P.csproj"):
    texts = spark.createDataFrame([(f"{root}/{name}" if root else name, text)], "path string, text string")
    listed = spark.createDataFrame([(f"{root}/{f}" if root else f,) for f in files], "file string")
    found = [r["file"] for r in projects.compile_files(projects.parsed(texts), listed).collect()]
    assert len(found) == len(set(found))
    return {posixpath.relpath(f, root or ".") for f in found}


DEFAULT = {"a.cs", "sub/c.cs", "sub/deep/d.cs", "sub/bin/e.cs", "bin.cs", "sub/100%_.cs"}


@pytest.mark.parametrize(
    "text, want",
    [
        (project(""), DEFAULT),
        ("\ufeff" + project(""), DEFAULT),
        (project("", sdk=False), set()),
        (project("<PropertyGroup><EnableDefaultCompileItems> False </EnableDefaultCompileItems></PropertyGroup>"), set()),
        (project("<PropertyGroup><EnableDefaultCompileItems>false</EnableDefaultCompileItems></PropertyGroup><PropertyGroup><EnableDefaultCompileItems>true</EnableDefaultCompileItems></PropertyGroup>"), DEFAULT),
        (project("<PropertyGroup><EnableDefaultCompileItems>$(X)</EnableDefaultCompileItems></PropertyGroup>"), DEFAULT),
        (project(items(("Remove", r"sub\**\*.cs"))), {"a.cs", "bin.cs"}),
        (project(items(("Remove", r"sub\*.cs"), ("Remove", "none.cs"))), {"a.cs", "bin.cs", "sub/deep/d.cs", "sub/bin/e.cs"}),
        (project(items(("Include", r"..\lib\**\*.cs"))), DEFAULT | {"../lib/l.cs", "../lib/x/m.cs", "../lib/bin/n.cs"}),
        (project(items(("Include", "b.txt"), ("Include", "./sub/../bin/f.cs"), ("Include", "missing.cs")), sdk=False), {"b.txt", "bin/f.cs"}),
        (project(items(("Include", r"sub\*")), sdk=False), {"sub/c.cs", "sub/100%_.cs"}),
        (project(items(("Include", "*.*")), sdk=False), {"a.cs", "b.txt", "bin.cs"}),
        (project(items(("Include", "sub/1??%_.*s"), ("Include", "sub/1*%_.cs")), sdk=False), {"sub/100%_.cs"}),
        (project(items(("Include", "bin/*.cs")), sdk=False), set()),
        (project(items(("Include", "*/c.cs"), ("Include", "")), sdk=False), set()),
        (project(items(("Include", "**/sub/*.cs")), sdk=False), set()),
        (project(items(("Include", "sub/**")), sdk=False), {"sub/c.cs", "sub/deep/d.cs", "sub/bin/e.cs", "sub/100%_.cs"}),
        (project(items(("Include", "a.cs"), ("Remove", "a.cs"), ("Include", "sub/c.cs")), sdk=False), {"sub/c.cs"}),
        (project(items(("Include", "/r/lib/l.cs")), sdk=False), {"../lib/l.cs"}),
        (project("<Target>" + items(("Include", "a.cs")) + "</Target>", sdk=False), set()),
        ("<Project", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_compile_files(spark, text, want):
    assert compiled(spark, text) == want


@pytest.mark.parametrize("root", ["", "/"])
def test_at_the_root(spark, root):
    texts = spark.createDataFrame([(root + "P.csproj", project(items(("Include", "sub/*.txt"))))], "path string, text string")
    listed = spark.createDataFrame([(root + f,) for f in ("a.cs", "sub/b.cs", "sub/c.txt", "obj/d.cs", "e.txt")], "file string")
    assert {r["file"] for r in projects.compile_files(projects.parsed(texts), listed).collect()} == {root + f for f in ("a.cs", "sub/b.cs", "sub/c.txt")}


def test_case_and_repeats(spark):
    listed = ["A.cs", "a.cs", "B.cs", "B.cs"]
    assert compiled(spark, project(""), listed) == {"A.cs", "B.cs"}
    assert compiled(spark, project(items(("Remove", "a.cs"))), listed) == {"B.cs"}
    assert compiled(spark, project(items(("Include", "a.cs")), sdk=False), listed) == {"a.cs"}
    assert compiled(spark, project(""), []) == set()


def test_bad_projects_and_references(spark):
    refs = '<ItemGroup><ProjectReference Include="..\\A\\A.csproj"><Project>{1}</Project></ProjectReference><ProjectReference Include="../a/a.csproj" /></ItemGroup><ItemGroup><ProjectReference Include="C.csproj" /></ItemGroup>'
    texts = spark.createDataFrame([("/r/P/P.csproj", project(refs)), ("/r/Q.csproj", "no xml"), ("/r/R.csproj", project(refs, sdk=False))], "path string, text string")
    found = projects.parsed(texts)
    assert {r["project"]: (r["sdk"], r["bad"]) for r in found.collect()} == {"/r/P/P.csproj": (True, False), "/r/Q.csproj": (False, True), "/r/R.csproj": (False, False)}
    assert {tuple(r) for r in projects.references(found).collect()} == {("/r/P/P.csproj", "/r/A/A.csproj"), ("/r/P/P.csproj", "/r/P/C.csproj"), ("/r/R.csproj", "/A/A.csproj"), ("/r/R.csproj", "/r/C.csproj")}


@pytest.mark.parametrize("path, want", [("a/./b//c", "a/b/c"), ("a\\..\\b", "b"), ("../a", "../a"), ("a/../../b", "../b"), ("/../a", "/a"), ("/", "/"), ("", ""), ("/a/b/..", "/a")])
def test_resolved(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(projects.resolved(F.col("p"))).first()[0] == want


def test_read(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "P.csproj").write_text(project(""))
    row = projects.read(spark, f"{tmp_path}/*/*.csproj").first()
    assert row["path"].endswith("/x/P.csproj") and row["text"] == project("")


def test_many_against_a_walk(spark):
    """Recursive and flat patterns of many projects against a plain walk of all files."""
    rng = random.Random(3)
    names = ["a.cs", "b.cs", "ab.txt", "c.g.cs"]
    tree = sorted({"/".join(["/r", *rng.choices(["x", "y", "bin", "obj"], k=rng.randint(0, 4)), rng.choice(names)]) for _ in range(300)})
    bases = ["/r", "/r/x", "/r/x/y", "/r/y/obj"]
    texts, want = [], set()
    for n, base in enumerate(bases):
        wanted = [("Include", rng.choice(["", "x/", "../", "bin/"]) + rng.choice(["", "**/"]) + rng.choice(["*.cs", "a*", "*.g.cs", "?b.*"])) for _ in range(3)] + [("Remove", rng.choice(["x/**/*.cs", "**/a.cs", "*.g.cs"]))]
        texts.append((f"{base}/p{n}.csproj", project(items(*wanted), sdk=n % 2 == 0)))
        hits = {"Include": set(), "Remove": set()}
        for kind, pattern in ([("Include", "**/*.cs")] if n % 2 == 0 else []) + wanted:
            folder, _, name = pattern.rpartition("/")
            start = posixpath.normpath(posixpath.join(base, folder.replace("**", "")))
            for f in tree:
                inside = posixpath.dirname(f) == start or ("**" in pattern and posixpath.dirname(f).startswith(start + "/"))
                rel = posixpath.relpath(f, base).split("/")
                if inside and fnmatch.fnmatchcase(posixpath.basename(f), name) and not (len(rel) > 1 and rel[0] in ("bin", "obj")):
                    if "*" in pattern:
                        hits[kind].add(f)
        want |= {(f"{base}/p{n}.csproj", f) for f in hits["Include"] - hits["Remove"]}
    found = projects.compile_files(projects.parsed(spark.createDataFrame(texts, "path string, text string")), spark.createDataFrame([(f,) for f in tree], "file string"))
    assert {tuple(r) for r in found.collect()} == want and want
