"""The index on disk: JSON lines for interchange, Parquet beside or instead of them; reading, writing, publishing."""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas

#: File of each table: (file, schema, key in schemas.REQUIRED or None).
TABLES = {
    "symbols": ("symbols.jsonl", schemas.SYMBOLS), "edges": ("edges.jsonl", schemas.EDGES), "entry_points": ("entrypoints.json", schemas.ENTRY_POINTS),
    "frontend_calls": ("frontend-calls.jsonl", schemas.FRONTEND_CALLS), "api_links": ("api-links.jsonl", schemas.API_LINKS),
    "tickets": ("ticket-files.jsonl", schemas.TICKETS), "co_change": ("co-change.jsonl", schemas.CO_CHANGE),
}
RETRY_SECONDS = (0.1, 0.2, 0.4, 0.8)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def copy_in(spark: SparkSession, local: str, path: str) -> None:
    """Copies a file of the driver's disk to a path of whatever store it names."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = named(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(named(f"file://{local}"), target)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder that a Spark job has written in whole."""
    return exists(spark, f"{path}/_SUCCESS")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("seq", T.LongType())]))


def read_lines(spark: SparkSession, path: str, schema: T.StructType, required: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with seq, malformed lines). Blank lines vanish; a row without a required member is malformed; a missing file has no rows.

    seq grows with a line's place: it is the file's split and the line's number there.
    """
    if not exists(spark, path):
        return empty(spark, schema), spark.createDataFrame([], "line string")
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("seq", F.monotonically_increasing_id())
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    for name in required:
        good = good & F.col(f"r.{name}").isNotNull()
    return parsed.where(good).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields), "seq"), parsed.where(~good).select(F.col("value").alias("line"))


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of one JSON document (an array or one object) or of a written folder, with seq; malformed documents fail, a missing one has no rows."""
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("multiLine", not is_written(spark, path)).option("mode", "FAILFAST").json(path).withColumn("seq", F.monotonically_increasing_id())


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(service, impl) of a document that maps each service to a list, or of a folder with such a map in each line."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.DI)
    text = spark.read.option("wholetext", not is_written(spark, path)).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("service", "impls")).select("service", F.explode("impls").alias("impl"))


@dataclass
class CodeIndex:
    """The tables of one index, read when used."""

    symbols: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    di_confirmed: DataFrame
    frontend_calls: DataFrame
    api_links: DataFrame
    tickets: DataFrame
    co_change: DataFrame
    meta: DataFrame
    warnings: DataFrame


def load(spark: SparkSession, directory: str) -> CodeIndex:
    """An index; only symbols are required."""
    if not exists(spark, f"{directory}/symbols.jsonl"):
        raise FileNotFoundError(f"{directory} has no symbols: build the index first")
    found, bad = {}, []
    for name, (file, schema) in TABLES.items():
        if file.endswith(".jsonl"):
            found[name], malformed = read_lines(spark, f"{directory}/{file}", schema, schemas.REQUIRED.get(name, []))
            bad.append(malformed.select(F.lit(file).alias("file"), "line"))
        else:
            found[name] = read_document(spark, f"{directory}/{file}", schema)
    found["frontend_calls"] = found["frontend_calls"].withColumn("baseUrlDropped", F.coalesce("baseUrlDropped", F.lit(False)))
    warnings = bad[0]
    for b in bad[1:]:
        warnings = warnings.union(b)
    return CodeIndex(**found, di_confirmed=read_map(spark, f"{directory}/di-confirmed.json"), meta=read_document(spark, f"{directory}/meta.json", schemas.META).drop("seq"), warnings=warnings)


def write_lines(df: DataFrame, path: str) -> None:
    """One compact object a line, nulls left out; a folder of part files in the order of pass and seq, if any."""
    order = [c for c in ("pass", "seq") if c in df.columns]
    ordered = df.orderBy(*order).drop(*order) if order else df
    ordered.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_map(di: DataFrame, path: str) -> None:
    """A map of each service to its implementations, one service a line, sorted."""
    di.orderBy("service").select(F.to_json(F.create_map("service", "impls")).alias("value")).write.mode("overwrite").text(path)


def write_index(scan, directory: str) -> None:
    """All tables that a scan owns: symbols, edges, entry points, both binding maps and diagnostics."""
    write_lines(scan.symbols, f"{directory}/symbols.jsonl")
    write_lines(scan.edges, f"{directory}/edges.jsonl")
    write_lines(scan.entry_points, f"{directory}/entrypoints.json")
    write_map(scan.di, f"{directory}/di.json")
    write_map(scan.di_confirmed, f"{directory}/di-confirmed.json")
    write_diagnostics(scan.diagnostics, f"{directory}/diagnostics")


def write_document(value: object, path: str) -> None:
    """A small indented document on the driver's disk, replaced at once."""
    part = f"{path}.{uuid.uuid4().hex}"
    Path(part).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(part, path)


def write_diagnostics(lists: dict[str, DataFrame], path: str) -> None:
    """Replaces the given lists and leaves the others: one partition a list."""
    out = None
    for name, df in lists.items():
        rows = df.select(F.lit(name).alias("list"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.union(rows)
    if out is not None:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(path)


def read_diagnostics(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame | None:
    """The rows of a written list; None where it wasn't written."""
    if not exists(spark, f"{path}/list={name}"):
        return None
    return spark.read.schema("row string").parquet(f"{path}/list={name}").select(F.from_json("row", schema).alias("r")).select("r.*")


def meta_of(index: CodeIndex, head: str | None, branch: str | None, solution: str, degraded: list[str]) -> dict:
    counts = index.symbols.agg(F.countDistinct("project").alias("p"), F.count("*").alias("s")).first()
    return {
        "indexedAt": datetime.now(timezone.utc).isoformat(timespec="seconds"), "gitCommit": head, "gitBranch": branch, "solutionPath": solution,
        "projectCount": counts["p"], "degradedProjects": degraded, "symbolCount": counts["s"], "edgeCount": index.edges.count(),
    }


def write_marker(directory: str, project: str, steps: list[dict], commit: str | None = None, indexed_at: str | None = None) -> None:
    """The completion marker, written last into a staging folder."""
    write_document({"schemaVersion": 1, "syncId": uuid.uuid4().hex, "completedAt": datetime.now(timezone.utc).isoformat(timespec="seconds"), "project": project, "gitCommit": commit, "metaIndexedAt": indexed_at, "steps": steps}, f"{directory}/sync-complete.json")


def read_marker(directory: str) -> dict | str | None:
    """The marker, a problem's text, or None where there is none."""
    path = Path(directory) / "sync-complete.json"
    if not path.exists():
        return None
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
        return found if isinstance(found, dict) and "syncId" in found else "the marker lacks its id"
    except (OSError, ValueError) as e:
        return f"the marker can't be read: {e}"


def _renamed(a: Path, b: Path) -> None:
    for wait in (*RETRY_SECONDS, None):
        try:
            a.rename(b)
            return
        except OSError:
            if wait is None:
                raise
            time.sleep(wait)


@contextmanager
def locked(out: str) -> Iterator[None]:
    """Holds the lock of an index's place, a file beside it; an error where another process has it. It ends with its process."""
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    with open(f"{out}.lock", "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"another sync writes to {out}") from e
        yield


def publish_docs(docs: str, out: str) -> list[str]:
    """Moves the Markdown files of a folder, those in folders below it included, over those of another, each at once; gives their names."""
    found = sorted(p.relative_to(docs) for p in Path(docs).rglob("*.md"))
    for name in found:
        target = Path(out) / name
        target.parent.mkdir(parents=True, exist_ok=True)
        _renamed(Path(docs) / name, target)
    return [str(p) for p in found]


def inside(root: str, path: str) -> bool:
    """Whether a path, taken from root, is root or below it once its dots are resolved; '/ab' isn't below '/a'."""
    full = os.path.abspath(root)
    return os.path.commonpath([full, os.path.abspath(os.path.join(full, path))]) == full


def recover(out: Path) -> None:
    """Puts a parked index back where a swap was interrupted."""
    parked = out.with_name(out.name + ".old")
    if parked.exists() and not out.exists():
        _renamed(parked, out)


def publish(staging: str, out: str) -> None:
    """Swaps a complete staging folder in; the old index is parked and comes back if that fails."""
    new, target = Path(staging), Path(out)
    if not isinstance(read_marker(staging), dict):
        raise ValueError(f"{staging} isn't complete")
    recover(target)
    parked = target.with_name(target.name + ".old")
    if parked.exists():
        _renamed(parked, parked.with_name(f"{parked.name}.{uuid.uuid4().hex}"))
    if target.exists():
        _renamed(target, parked)
    try:
        _renamed(new, target)
    except OSError:
        recover(target)
        raise


def origin(directory: str) -> str:
    """What an index's fingerprint is made of: 'sync', the marker's id, or 'files'."""
    return "sync" if isinstance(read_marker(directory), dict) else "files"


def fingerprint(directory: str) -> str:
    """The marker's id, else the names, sizes and times of all files."""
    if origin(directory) == "sync":
        return read_marker(directory)["syncId"]
    files = sorted(p for p in Path(directory).rglob("*") if p.is_file())
    return "|".join(f"{p.name}:{p.stat().st_size}:{p.stat().st_mtime_ns}" for p in files)
