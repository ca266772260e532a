"""The map of a solution: projects and their dependencies, hubs, entry points, blind spots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import layers
from tessera.operators.impact import first_rows
from tessera.operators.link import Factored

HUBS, ENTRIES_A_PROJECT, PROJECTS, GROUPS, TYPES_A_PROJECT = 20, 30, 100, 25, 200


def project_dependencies(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_project, to_project): distinct dependencies between different projects."""
    of = first_rows(symbols).select("id", "project")
    a = of.withColumnsRenamed({"id": "from", "project": "from_project"})
    b = of.withColumnsRenamed({"id": "to", "project": "to_project"})
    return edges.select("from", "to").join(a, "from").join(b, "to").where("from_project <> to_project").select("from_project", "to_project").distinct()


def project_layers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, layer, symbols): the layer of each project and its number of symbols."""
    counts = symbols.groupBy("project").agg(F.count("*").alias("symbols"))
    return counts.join(layers(project_dependencies(edges, symbols), symbols), "project")


def hubs(edges: DataFrame, limit: int = HUBS) -> DataFrame:
    """(to, edges): the most common targets of edges of any kind."""
    return edges.groupBy("to").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "to").limit(limit)


def unresolved_bases(unresolved: DataFrame) -> DataFrame:
    """(name, n, file, line): bases that couldn't be resolved, with their first place; unresolved: seq, name, file, line."""
    first = unresolved.groupBy("name").agg(F.count("*").alias("n"), F.min_by(F.struct("file", "line"), "seq").alias("x"))
    return first.select("name", "n", "x.file", "x.line").orderBy(F.desc("n"), "name")


def entry_points_by_project(entries: DataFrame, symbols: DataFrame, cap: int = ENTRIES_A_PROJECT) -> DataFrame:
    """The first entry points of each project, with how many the project has and how many aren't shown."""
    of = first_rows(symbols).select("id", "project")
    found = first_rows(entries).join(of, "id", "left").withColumn("project", F.coalesce("project", F.lit("?")))
    total = found.groupBy("project").agg(F.count("*").alias("in_project"))
    order = Window.partitionBy("project").orderBy("seq")
    ranked = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return ranked.join(total, "project").withColumn("not_shown", F.greatest(F.col("in_project") - cap, F.lit(0)))


def features_by_endpoint(links: DataFrame | Factored, calls: DataFrame) -> DataFrame:
    """(backendId, features): the features that call each endpoint, as first linked; links: seq, frontendId, backendId."""
    feature = first_rows(calls).select(F.col("id").alias("frontendId"), "feature")
    if isinstance(links, Factored):
        # the first call of a feature with each shape, then with each class of endpoints
        first = links.calls.join(feature, "frontendId").groupBy("shape", "feature").agg(F.min("seq").alias("seq"))
        first = links.matches.join(first, "shape").groupBy("class", "feature").agg(F.min("seq").alias("seq"))
        first = links.endpoints.join(first, "class").groupBy(F.col("id").alias("backendId"), "feature").agg(F.min("seq").alias("seq"))
    else:
        first = links.join(feature, "frontendId").groupBy("backendId", "feature").agg(F.min("seq").alias("seq"))
    return first.groupBy("backendId").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "feature"))), lambda x: x.feature).alias("features"))


#: Kinds of symbols that are types of a project's page.
TYPE_KINDS = ["Class", "Interface", "Struct", "Enum", "Record"]


def module_types(symbols: DataFrame, cap: int = TYPES_A_PROJECT) -> DataFrame:
    """The first types of every project by name, with how many it has; types that several projects hold count in each."""
    types = symbols.where(F.col("kind").isin(TYPE_KINDS)).select("project", "id", "kind", "name", "file", "line").dropDuplicates(["project", "id"])
    total = types.groupBy("project").agg(F.count("*").alias("in_project"))
    ranked = types.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("name", "id"))).where(F.col("n") <= cap)
    return ranked.join(total, "project").orderBy("project", "n")


def module_page(symbols: DataFrame, project: str) -> DataFrame:
    """The types of one project."""
    return symbols.where((F.col("project") == project) & F.col("kind").isin(TYPE_KINDS)).select("id", "kind", "name", "file", "line").orderBy("name", "id")
