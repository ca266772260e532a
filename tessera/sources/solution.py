"""Projects of solution files, and the registry that says which project a folder belongs to."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.routes import is_inside

#: The ending of projects that count.
PROJECT = ".csproj"
#: The registry's file name, in a folder or one above it.
REGISTRY = "tessera.projects.json"


def stem(path: Column) -> Column:
    """A path's file name without its last ending."""
    return F.regexp_replace(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1), r"\.[^.]*$", "")


def read_sln(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of the projects that the lines of text solutions declare: `Project("{type}") = "name", "path", "{id}"`."""
    quoted = F.split(F.col("value"), '"')
    lines = spark.read.text(path).where(F.ltrim("value").startswith("Project(")).select(F.get(quoted, 3).alias("name"), F.get(quoted, 5).alias("path"))
    return lines.where(F.lower("path").endswith(PROJECT))


def read_slnx(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of the Project elements of XML solutions, at any depth; bad XML has none."""
    rows = spark.read.schema("_Path string").option("rowTag", "Project").option("mode", "DROPMALFORMED").xml(path)
    return rows.where(F.lower("_Path").endswith(PROJECT)).select(stem(F.col("_Path")).alias("name"), F.col("_Path").alias("path"))


def read_registry(start: str, given: str | None = None, home: str | None = None) -> list[dict]:
    """The projects of the registry given, or else of the nearest one from a folder upwards, or else of the home folder's.

    Names that differ by case alone are refused; without any registry there are no projects.
    """
    folders = [Path(start).resolve(), *Path(start).resolve().parents, Path(home or Path.home())]
    found = [Path(given)] if given else [f / REGISTRY for f in folders if (f / REGISTRY).is_file()]
    if not found:
        return []
    projects = json.loads(found[0].read_text(encoding="utf-8"))["projects"]
    names = [p["name"].lower() for p in projects]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"{found[0]} names projects more than once: {', '.join(twice)}")
    return projects


def projects_of(projects: DataFrame, workspace: str) -> DataFrame:
    """The projects (name, solution_dir, repo, frontend) that a workspace belongs to, with the rule that says so.

    The first rule that any project meets decides: the workspace lies inside the solution's folder, the repository or
    the frontend, or holds the repository.
    """
    here = F.lit(workspace)
    below = lambda folder: F.coalesce(F.startswith(_folder(here), _folder(F.col(folder))), F.lit(False))
    rule = F.when(below("solution_dir"), 1).when(below("repo"), 2).when(below("frontend"), 3).when(F.coalesce(is_inside(F.col("repo"), workspace), F.lit(False)), 4)
    met = projects.withColumn("rule", rule).where("rule is not null")
    best = met.agg(F.min("rule").alias("rule"))  # one row
    return met.join(F.broadcast(best), "rule").select(*projects.columns, "rule")


def _folder(path: Column) -> Column:
    """A folder in a form that those below it begin with; null without one."""
    return F.when(path != "", F.concat(F.rtrim(F.lower(F.translate(path, "\\", "/")), F.lit("/")), F.lit("/")))
