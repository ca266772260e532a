"""Project files: the sources that a project compiles and the projects that it refers to, without a build tool.

A project's XML and a list of files are all that is read. Conditions and imports aren't evaluated. Paths are resolved
with either slash, and share one space: all below one root, or all absolute.

Items are compared with files by folders: a file is known by each folder above it, a pattern by the one folder that its
search begins in, so that an equality joins them and the name alone is left to be matched. A file takes as many rows as
it has folders above it, whatever the number of patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = """_Sdk string, PropertyGroup array<struct<EnableDefaultCompileItems:array<string>>>,
  ItemGroup array<struct<Compile:array<struct<_Include:string,_Remove:string>>,ProjectReference:array<struct<_Include:string>>>>, _bad string"""
#: What a project with default items compiles; output folders right below the project are never searched.
DEFAULT_ITEM, OUTPUT = "**/*.cs", ["bin", "obj"]


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def resolved(path: Column) -> Column:
    """A path without empty, '.' and '..' segments; what climbs above a relative start keeps its '..', above the root it stays there."""
    plain = slashed(path)
    absolute = plain.startswith("/")
    none = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        open_ = (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != "..")
        return F.when((s == "") | (s == "."), done).when(s != "..", F.concat(done, F.array(s))).when(open_, F.slice(done, 1, F.size(done) - 1)).when(absolute, done).otherwise(F.concat(done, F.array(s)))

    return F.concat(F.when(absolute, "/").otherwise(""), F.concat_ws("/", F.aggregate(F.split(plain, "/"), none, step)))


def folder_of(path: Column) -> Column:
    """The folder of a resolved path, ending in a slash; empty for the relative start."""
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))


def joined(folder: Column, path: Column) -> Column:
    """path seen from a folder, resolved; an absolute one stands for itself."""
    plain = slashed(path)
    return resolved(F.when(plain.startswith("/") | plain.rlike("^[A-Za-z]:"), plain).otherwise(F.concat(folder, plain)))


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of project files in a store that Spark reads."""
    return spark.read.text(paths, wholetext=True).select(F.expr("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(texts: DataFrame) -> DataFrame:
    """texts (path, text) as (project, sdk, items, refs, bad).

    items: (remove, pattern) in the order of the file, after the default one of a project with an Sdk, unless it turns
    default items off; the last property that is true or false counts. Text that is no XML has neither items nor
    references, and is `bad`; a null text too.
    """
    xml = F.from_xml(F.regexp_replace(F.col("text"), "^\ufeff", ""), ITEMS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = texts.select(resolved(F.col("path")).alias("project"), xml.alias("x"))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull()
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    groups = F.coalesce("x.ItemGroup", F.array())
    told = F.filter(F.transform(F.coalesce("x.PropertyGroup", F.array()), lambda g: F.lower(F.trim(F.get(g.EnableDefaultCompileItems, 0)))), lambda v: v.isin("true", "false"))
    default = F.col("x._Sdk").isNotNull() & F.coalesce(F.get(told, F.size(told) - 1) == "true", F.lit(True))
    item = "struct<remove:boolean,pattern:string>"
    own = F.flatten(F.transform(groups, lambda g: F.coalesce(g.Compile, empty("struct<_Include:string,_Remove:string>"))))
    both = F.flatten(F.transform(own, lambda c: F.array(F.struct(F.lit(False).alias("remove"), c._Include.alias("pattern")), F.struct(F.lit(True).alias("remove"), c._Remove.alias("pattern")))))
    items = F.concat(F.when(default, F.array(F.struct(F.lit(False).alias("remove"), F.lit(DEFAULT_ITEM).alias("pattern")))).otherwise(empty(item)), F.filter(both, lambda i: i.pattern != ""))
    refs = F.flatten(F.transform(groups, lambda g: F.coalesce(F.transform(g.ProjectReference, lambda r: r._Include), empty("string"))))
    return rows.select(
        "project",
        (F.col("x._Sdk").isNotNull() & ~bad).alias("sdk"),
        F.when(bad, empty(item)).otherwise(items).alias("items"),
        F.when(bad, empty("string")).otherwise(F.filter(refs, lambda r: r != "")).alias("refs"),
        bad.alias("bad"),
    )


def searches(projects: DataFrame) -> DataFrame:
    """(project, base, place, remove, at, deep, wild, glob): each item as a search in one folder.

    A pattern without a star names one file. Else its last segment is matched with names in the folder before it, or
    in all below that where it has a double star, which itself stands for no folder; single stars in folders aren't expanded.
    """
    base = folder_of(F.col("project"))
    rows = projects.select("project", base.alias("base"), F.posexplode("items").alias("place", "i")).select("project", "base", "place", "i.remove", slashed(F.col("i.pattern")).alias("p"))
    wild = F.contains("p", F.lit("*"))
    name = F.substring_index("p", "/", -1)
    before = F.rtrim(F.left("p", F.length("p") - F.length(name)), F.lit("/"))
    start = F.when(before.isin("", "**"), F.rtrim("base", F.lit("/"))).otherwise(joined(F.col("base"), F.replace(before, F.lit("**"), F.lit(""))))
    one = joined(F.col("base"), F.col("p"))
    folder = F.when(start == "", F.when(F.startswith("base", F.lit("/")), "/").otherwise("")).when(start == "/", "/").otherwise(F.concat(start, F.lit("/")))
    asked = F.when(~wild, F.substring_index(one, "/", -1)).when(name == "*.*", "*").otherwise(name)
    literal = F.regexp_replace(asked, r"([\\%_])", r"\\$1")
    glob = F.when(wild, F.translate(literal, "*?", "%_")).otherwise(literal)
    return rows.select("project", "base", "place", "remove", F.when(wild, folder).otherwise(folder_of(one)).alias("at"), F.contains("p", F.lit("**")).alias("deep"), wild.alias("wild"), glob.alias("glob"))


def folders_above(files: DataFrame) -> DataFrame:
    """(file, name, own, at): a file by each folder above it; `own` is the one it lies in."""
    rows = files.where("file is not null").select(resolved(F.col("file")).alias("file")).distinct()
    parts = F.split(folder_of(F.col("file")), "(?<=/)")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("", F.slice(parts, 1, n)))
    # an absolute path's first folder is the root, and the empty start isn't above it
    at = F.explode(F.filter(F.array_distinct(above), lambda a: (a != "") | ~F.startswith("file", F.lit("/"))))
    return rows.select("file", F.substring_index("file", "/", -1).alias("name"), folder_of(F.col("file")).alias("own"), at.alias("at"))


def compile_files(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file): the files of a list that parsed projects compile.

    What an item removes goes, wherever the item stands and in any case of letters; of files that differ by case alone
    the first item's counts, then the least. Patterns without a file have none; a project that repeats is one.
    """
    asked = searches(projects)
    hit = folders_above(files).join(asked, "at").where((F.col("deep") & F.col("wild")) | (F.col("own") == F.col("at"))).where("name LIKE glob")
    inner = F.when(F.startswith("file", "base"), F.substring("file", F.length("base") + 1, F.length("file")))
    output = F.contains(inner, F.lit("/")) & F.lower(F.substring_index(inner, "/", 1)).isin(OUTPUT)
    found = hit.where(~(F.col("wild") & F.coalesce(output, F.lit(False))))
    taken = found.groupBy("project", F.lower("file").alias("key")).agg(F.min(F.when(~F.col("remove"), F.struct("place", "file"))).alias("first"), F.max("remove").alias("removed"))
    return taken.where("first is not null and not removed").select("project", "first.file")


def references(projects: DataFrame) -> DataFrame:
    """(project, reference): the projects that parsed projects refer to, each once in any case of letters, by the first spelling."""
    rows = projects.select("project", F.posexplode("refs").alias("place", "ref")).withColumn("reference", joined(folder_of(F.col("project")), F.col("ref")))
    return rows.groupBy("project", F.lower("reference").alias("key")).agg(F.min(F.struct("place", "reference")).alias("first")).select("project", "first.reference")
