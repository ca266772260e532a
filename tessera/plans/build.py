"""Building an index: passes over raw facts, history and frontend calls, in dependency order, published as a whole."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip_prefix
from tessera.lineage import shared_dir
from tessera.operators import frontend, history, impact, link, project_map, scan_passes, status
from tessera.operators.impact import first_rows
from tessera.plans import reports
from tessera.sources import git_log, index


@dataclass
class Config:
    """What a project may set; defaults as where it sets nothing."""

    ticket_pattern: str = r"#\d{3,6}"
    di_overrides: dict[str, list[str]] = field(default_factory=dict)
    frontend_app_dir: str = frontend.APP_DIR

    @staticmethod
    def discover(start: str, name: str = "tessera.config.json") -> "Config":
        """The nearest configuration file from a folder upwards; a malformed one is an error."""
        for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
            if (folder / name).exists():
                d = json.loads((folder / name).read_text(encoding="utf-8"))
                return Config(d.get("ticketPattern", Config.ticket_pattern), d.get("diManualOverrides", {}), d.get("frontendAppDir", frontend.APP_DIR))
        return Config()


@dataclass
class Facts:
    """A walker's raw tables; those it didn't emit are None."""

    symbols: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    interface_members: DataFrame | None = None
    virtual_calls: DataFrame | None = None
    overrides: DataFrame | None = None
    sends: DataFrame | None = None
    handlers: DataFrame | None = None
    structural: DataFrame | None = None
    fluent: DataFrame | None = None
    attributes: DataFrame | None = None
    ambiguous: DataFrame | None = None
    implicit: DataFrame | None = None


@dataclass
class Scan:
    symbols: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    di: DataFrame
    di_confirmed: DataFrame
    diagnostics: dict[str, DataFrame]


def complete_scan(f: Facts, config: Config) -> Scan:
    """The passes over raw facts, in their order: mediator edges are never expanded, overrides see the walker's edges alone."""
    spark = f.symbols.sparkSession
    none = spark.createDataFrame([], "service string, impl string")
    passes = []
    if f.interface_members is not None:
        passes.append(scan_passes.interface_edges(f.edges, f.interface_members, ordered=True))
    if f.virtual_calls is not None and f.overrides is not None:
        passes.append(scan_passes.override_edges(f.virtual_calls, f.overrides, ordered=True))
    if f.sends is not None and f.handlers is not None:
        passes.append(scan_passes.mediator_edges(f.sends, f.handlers, ordered=True))
    edges = scan_passes.complete_edges(f.edges, *passes)
    manual = [(s, i) for s, impls in config.di_overrides.items() for i in impls]
    overrides = spark.createDataFrame(manual, "service string, impl string") if manual else none
    real = [x.select("service", "impl") for x in (f.fluent, f.attributes) if x is not None] + [overrides]
    confirmed = scan_passes.di_map(*real)
    everything = scan_passes.di_map(*real, f.structural if f.structural is not None else none)
    symbols = f.symbols
    if f.implicit is not None:
        symbols = symbols.unionByName(scan_passes.implicit_constructors(f.implicit, edges))
    diagnostics = {"duplicateDocIdsAcrossProjects": scan_passes.duplicate_ids(symbols)}
    if f.attributes is not None and f.fluent is not None:
        diagnostics["diRegistrationConflicts"] = scan_passes.di_conflicts(f.attributes, f.fluent)
    if f.ambiguous is not None:
        diagnostics["ambiguousDiTypes"] = scan_passes.ambiguous_types(f.ambiguous, overrides)
    return Scan(symbols, edges, f.entry_points, everything, confirmed, diagnostics)


@dataclass
class History:
    tickets: DataFrame | None
    co_change: DataFrame


def mine_history(commits: DataFrame, config: Config, prefix: str | None = None) -> History:
    """Tickets and pairs of files; no tickets where the newest commits don't match the pattern at all."""
    known = history.pattern_matches(commits, config.ticket_pattern)
    moved = commits.withColumn("files", F.transform("files", lambda p: history.rebased(p, prefix))) if prefix else commits
    return History(history.tickets(moved, config.ticket_pattern) if known else None, history.co_change(moved))


def solution_prefix(meta: dict) -> str | None:
    """The folder of the solution within its repository, or None at the root."""
    folder = os.path.dirname(str(meta.get("solutionPath") or "").replace("\\", "/"))
    return folder or None


def read_repository(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """A repository's commits with today's names. The log goes through the folder that driver and executors share."""
    shared = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    local = os.path.join(tempfile.mkdtemp(prefix="spark-"), "log")
    git_log.write_log(repo, local, since)
    index.copy_in(spark, local, shared)
    return git_log.commits(git_log.parse_log(spark, shared))


#: A step: its name, whether the index is useless without it, what it does, and the tables it owns.
Step = tuple[str, bool, Callable[[str], None], list[str]]


#: Folder of a staging folder whose reports are published after the index.
DOCS = "docs"


def sync(out: str, project: str, steps: list[Step], docs_out: str | None = None) -> list[dict]:
    """Runs the steps into a staging folder beside `out` and swaps it in; a failed optional step loses its tables, a required one ends it.

    One sync of a place runs at a time. Reports that steps leave in DOCS go to docs_out once the index is in place.
    """
    with index.locked(out):
        staging = f"{out}.staging"
        index.recover(Path(out))
        if Path(staging).exists():
            Path(staging).rename(tempfile.mkdtemp(prefix="stale-", dir=Path(staging).parent) + "/stale")
        Path(staging).mkdir(parents=True)
        done = []
        for name, required, run, owned in steps:
            try:
                run(staging)
                done.append({"name": name, "status": "ok"})
            except Exception as e:
                if required:
                    raise
                for file in owned:
                    target = Path(staging) / file
                    shutil.rmtree(target, ignore_errors=True) if target.is_dir() else target.unlink(missing_ok=True)
                done.append({"name": name, "status": "failed", "detail": str(e)[:500]})
        index.write_marker(staging, project, done)
        index.publish(staging, out)
        if docs_out:
            index.publish_docs(f"{out}/{DOCS}", docs_out)
        return done


def docs_step(found: index.CodeIndex, staging: str, earlier: str | None = None) -> None:
    """The map and a page of each project into the staging folder; what people wrote between the markers of earlier reports stays."""
    pages = {"MAP.md": reports.map_report(map_tables(found) | blind_tables(found, f"{staging}/diagnostics"))}
    for project, text in reports.module_reports(project_map.module_types(found.symbols)):
        pages[f"modules/{reports.file_name(project)}.md"] = text
    for name, text in pages.items():
        old = Path(earlier or "", name)
        notes = reports.human_notes(old.read_text(encoding="utf-8"), reports.BEGIN, reports.END) if earlier and old.exists() else "\n"
        target = Path(staging, DOCS, name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"{text}\n{reports.BEGIN}{notes}{reports.END}\n", encoding="utf-8")


def slice_of(found: index.CodeIndex, symbol: str, repo: str, depth: int = 3, lines: int = 40) -> str:
    """The slice report of a symbol, with its file as it is in the repository now; nothing outside the repository is read."""
    spark = found.symbols.sparkSession
    known = first_rows(found.symbols.where(F.col("id") == symbol)).select("id", "file", "line")
    row, meta = known.first(), found.meta.first()
    folder = os.path.join(repo, solution_prefix(meta.asDict()) or "" if meta else "")
    path = os.path.join(folder, row["file"].replace("\\", "/")) if row else ""
    outside = bool(row) and not index.inside(repo, os.path.abspath(path))
    text = Path(path).read_text(encoding="utf-8", errors="replace") if row and not outside and os.path.isfile(path) else None
    sources = spark.createDataFrame([(row["file"], text)] if text is not None else [], "file string, text string")
    code = status.live_code(spark.createDataFrame([(symbol,)], "id string"), known, sources, repo)
    code = code.withColumn("missing", F.lit("outside repository")) if outside else code
    return reports.slice_report(symbol, impact.impact(found, symbol, depth), code.first(), lines)


def link_step(found: index.CodeIndex, staging: str) -> None:
    """Links into the staging folder, and the diagnostics that they own."""
    made = link.link(found.entry_points, found.frontend_calls)
    index.write_lines(made.links, f"{staging}/api-links.jsonl")
    index.write_diagnostics({"unmatchedFrontendCalls": made.unmatched, "unreferencedEndpoints": made.unreferenced}, f"{staging}/diagnostics")


def map_tables(found: index.CodeIndex) -> dict[str, DataFrame]:
    """The tables of the project map."""
    return {
        "projects": project_map.project_layers(found.edges, found.symbols).orderBy("layer", "project").limit(project_map.PROJECTS),
        "dependencies": project_map.project_dependencies(found.edges, found.symbols),
        "entry_points": project_map.entry_points_by_project(found.entry_points, found.symbols),
        "hubs": project_map.hubs(found.edges),
    }


def blind_tables(found: index.CodeIndex, diagnostics: str) -> dict[str, DataFrame]:
    """What a map can't see, of an index's document and of those diagnostics that were written: failed projects, unresolved bases, ids of several projects."""
    spark = found.meta.sparkSession
    degraded = found.meta.select(F.explode("degradedProjects").alias("project")).distinct().orderBy("project")
    out = {} if degraded.isEmpty() else {"degraded": degraded}
    listed = lambda name, schema: index.read_diagnostics(spark, diagnostics, name, schema)
    if (bases := listed("unresolvedBases", "seq long, name string, file string, line int")) is not None:
        out["unresolved"] = project_map.unresolved_bases(bases).orderBy(F.desc("n"), "name")
    if (ids := listed("duplicateDocIdsAcrossProjects", "id string, projects array<string>, files array<string>")) is not None:
        out["duplicates"] = ids.orderBy("id")
    return out


def confirmed_implementations(di: DataFrame) -> DataFrame:
    """(containing) of a (service, impls) map."""
    return di.select(strip_prefix(F.explode("impls")).alias("containing")).distinct()
