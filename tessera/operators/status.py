"""State of an index: what it holds, how old it is, what has changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contents(**tables: DataFrame) -> DataFrame:
    """(table, rows) of each table."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def changed_files(committed: DataFrame, uncommitted: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """(file): distinct changes since the scan, of the relevant files if given."""
    out = committed.select("file").union(uncommitted.select("file")).distinct()
    return out if relevant is None else out.join(relevant.select("file"), "file", "left_semi")


def freshness(meta: DataFrame, head: str | None, changed: int) -> DataFrame:
    """(state, changed): NoMeta, NoScanCommit, GitUnavailable, AtScannedCommit or Behind."""
    same = F.lower("gitCommit") == F.lit((head or "").lower())
    state = F.when(F.col("gitCommit").isNull() | (F.col("gitCommit") == ""), "NoScanCommit").when(F.lit(head is None), "GitUnavailable").when(same, "AtScannedCommit").otherwise("Behind")
    found = meta.limit(1).select(state.alias("state"), F.lit(changed).alias("changed"))
    spark = meta.sparkSession
    return spark.createDataFrame([("NoMeta", changed)], "state string, changed int") if meta.isEmpty() else found


def age_days(indexed_at: Column, now: Column) -> Column:
    """Whole days since the index was made."""
    return F.floor((now.cast("timestamp").cast("double") - F.try_to_timestamp(indexed_at).cast("double")) / 86400).cast("int")


def degraded_projects(diagnostics: DataFrame | None, meta: DataFrame) -> DataFrame:
    """(project): the diagnostics' list, or else that of the meta table."""
    listed = meta.select(F.explode("degradedProjects").alias("project"))
    return listed if diagnostics is None or diagnostics.isEmpty() else diagnostics.select("project")


def short_commit(commit: Column) -> Column:
    return F.left(commit, F.lit(7))


def advice(state: str, steps: list[tuple[str, str]], degraded: int) -> list[str]:
    """What to do next, in order of weight."""
    out = {"NoMeta": ["build the index"], "NoScanCommit": ["scan inside a repository"], "Behind": ["sync again"]}.get(state, [])
    return out + [f"repair step {name}" for name, status in steps if status in ("partial", "failed")] + (["restore projects that failed to load"] if degraded else [])


def index_line(meta: dict | str | None, built: bool, age: int | None = None) -> str:
    """One line on an index: what it holds, or why that isn't known; meta is its document, a problem's text or None."""
    if not built:
        return "index: not built"
    if meta is None:
        return "index: built, without meta data"
    if isinstance(meta, str):
        return f"index: meta data can't be read ({meta})"
    degraded = len(meta.get("degradedProjects") or [])
    parts = [f"{meta.get('symbolCount', 0)} symbols", f"{meta.get('edgeCount', 0)} edges", f"{meta.get('projectCount', 0)} projects"]
    parts += [f"{age} days old"] if age is not None else []
    return "index: " + ", ".join(parts + ([f"{degraded} degraded"] if degraded else []))


def sync_line(marker: dict | str | None, indexed_at: str | None) -> str:
    """One line on the last sync: none, unreadable, changed since, or complete with the steps that weren't."""
    if marker is None:
        return "sync: none is complete"
    if isinstance(marker, str):
        return f"sync: {marker}"
    if marker.get("metaIndexedAt") and indexed_at and marker["metaIndexedAt"] != indexed_at:
        return "sync: the index has changed since"
    partial = [s["name"] for s in marker.get("steps", []) if s.get("status") != "ok"]
    return "sync: complete" + (f", but for {', '.join(partial)}" if partial else "")


def freshness_line(state: str, changed: int) -> str:
    """One line on how far an index lags behind its sources; none where it is at the scanned commit without changes."""
    known = {"NoMeta": "the index has no meta data", "NoScanCommit": "the index knows no commit", "GitUnavailable": "the repository's state isn't known"}
    if state in known:
        return f"freshness: {known[state]}"
    if state == "AtScannedCommit":
        return f"freshness: {changed} files changed since the scan" if changed else ""
    return f"freshness: behind the repository, {changed} relevant files changed"


def live_code(wanted: DataFrame, symbols: DataFrame, sources: DataFrame, repo: str) -> DataFrame:
    """wanted (id) with file, text and `missing`, which says why there is no text, in this order: the id isn't in the
    index, its file lies outside the repository, isn't there, or has no line of that number.

    symbols: id, file, line, one row an id; sources: file, text.
    """
    known = wanted.join(symbols.select("id", "file", "line").withColumn("known", F.lit(True)), "id", "left")
    found = known.join(sources.select("file", F.col("text")), "file", "left")
    absolute = F.col("file").rlike(r"^([A-Za-z]:|[\\/])")
    outside = F.startswith("file", F.lit("../")) | (absolute & ~F.startswith(F.translate("file", "\\", "/"), F.lit(repo.rstrip("/") + "/")))
    located = F.col("line").between(1, F.size(F.split("text", "\n")))
    missing = F.when(F.col("known").isNull(), "not in index").when(outside, "outside repository").when(F.col("text").isNull(), "file missing").when(~F.coalesce(located, F.lit(False)), "not located")
    return found.select("id", "file", "line", F.when(missing.isNull(), F.col("text")).alias("text"), missing.alias("missing"))
