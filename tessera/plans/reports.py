"""Reports over small collected results: Markdown text, and nothing computed."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.operators.graph import paths
from tessera.operators.impact import Impact, nearest_path
from tessera.operators.project_map import GROUPS

#: Lines of a map; rows of a section.
MAP_LINES, SECTION_ROWS = 500, 30


def section(title: str, df: DataFrame, line, rows: int = SECTION_ROWS) -> list[str]:
    """A heading and a line for each of the first rows, with a note if there are more."""
    found = df.limit(rows + 1).collect()
    return [f"## {title}", ""] + [f"- {line(r)}" for r in found[:rows]] + (["- ..."] if len(found) > rows else []) + ([] if found else ["- none"]) + [""]


def impact_report(symbol: str, result: Impact) -> str:
    s = result.summary.first()
    risk = "not scored" if s["risk"] is None else f"{s['risk']} of 10"
    out = [f"# Impact of {symbol}", "", f"Risk: {risk}" + (" (hub)" if s["hub"] else ""), f"Direct callers: {s['direct_fan_in']}, of which inferred alone {s['inferred_only']}", ""]
    out += section("Entry points", result.entry_points, lambda r: f"{r['project']}: {r['display']} (depth {r['depth']}){'' if r['is_confirmed'] else ', unconfirmed'}")
    out += section("Modules", result.modules, lambda r: f"{r['project']}: {r['entry_points']}")
    out += section("Screens", result.screens, lambda r: f"{r['feature']}: {r['file']}:{r['line']} ({r['matchKind']})")
    out += section("Tests", result.tests, lambda r: r["display"])
    out += section("Tickets", result.tickets, lambda r: f"{r['date']} {r['ticket']}")
    out += section("Changes with", result.co_change, lambda r: f"{r['fileA']} and {r['fileB']}: {r['strength']}")
    return "\n".join(out)


def map_report(tables: dict[str, DataFrame]) -> str:
    """The map of map_tables(); blind spots follow where tables of them are given."""
    out = ["# Map", ""]
    out += section("Projects", tables["projects"], lambda r: f"{r['layer']}: {r['project']} ({r['symbols']} symbols)", 100)
    out += section("Dependencies", tables["dependencies"].orderBy("from_project", "to_project"), lambda r: f"{r['from_project']} -> {r['to_project']}", 100)
    out += section("Entry points", tables["entry_points"].orderBy("project", "n"), lambda r: f"{r['project']}: {r['id']}", 200)
    out += section("Hubs", tables["hubs"], lambda r: f"{r['to']}: {r['edges']}")
    spots = {
        "degraded": ("Projects that failed to load", lambda r: r["project"], 30),
        "unresolved": ("Unresolved bases", lambda r: f"{r['name']}: {r['n']}, first in {r['file']}:{r['line']}", GROUPS),
        "duplicates": ("Ids in several projects", lambda r: f"{r['id']}: {', '.join(r['projects'])}", 5),
    }
    for name, (title, line, rows) in spots.items():
        if name in tables:
            out += section(title, tables[name], line, rows)
    return "\n".join(out[:MAP_LINES])


#: Between these two, a report holds what people wrote.
BEGIN, END = "<!-- notes -->", "<!-- end of notes -->"


def file_name(project: str) -> str:
    """A project's name as that of a file: letters, digits, dots, dashes and underscores stay, others become percent codes."""
    return "".join(c if c.isalnum() or c in "-_" or (c == "." and at) else "".join(f"%{b:02x}" for b in c.encode("utf-8")) for at, c in enumerate(project))


def module_reports(types: DataFrame) -> Iterator[tuple[str, str]]:
    """(project, page) of each project of module_types(), which come in order and one partition at a time."""
    for project, rows in itertools.groupby(types.toLocalIterator(), lambda r: r["project"]):
        rows = list(rows)
        more = rows[0]["in_project"] - len(rows)
        yield project, "\n".join([f"# {project}", "", *(f"- {r['kind']} {r['name']} ({r['file']}:{r['line']})" for r in rows), *([f"- {more} more"] if more else []), ""])


def way_in(symbol: str, result: Impact, line: int | None) -> str:
    """One line: how the nearest entry point leads to a symbol, or the nearest caller where there is none."""
    found = nearest_path(result.entry_points.unionByName(result.intermediates)).first()
    if found is None:
        return "No caller outside tests is known within this depth."
    path = paths(result.ways, result.ways.where(F.col("id") == found["id"])).first()["path"]
    reached = result.entry_points.unionByName(result.intermediates).unionByName(result.tests)
    named = {r["id"]: r for r in reached.where(F.col("id").isin(path)).collect()}
    end = named[found["id"]]
    if found["bucket"] != "entry":
        label = "unclassified caller"
    elif end["httpMethod"] is None:
        label = end["type"]
    else:
        label = f"{end['httpMethod']} {end['route'] or 'unknown route'}" + (", inferred" if end["routeInferred"] else "")
    steps = [named[i]["display"] if i in named else symbol + (f":{line}" if line else "") for i in reversed(path)]
    return " -> ".join([f"[{label}]", *steps])


def slice_report(symbol: str, result: Impact, code: Row, lines: int = 40) -> str:
    """A symbol's code as it is now, or why it can't be shown, and the way that leads to it; code: a row of live_code()."""
    out = [f"# Slice of {symbol}", "", "## Code", ""]
    if code["missing"]:
        out += [f"No code: {code['missing']}" + (f" ({code['file']})" if code["file"] else ""), ""]
    else:
        text = code["text"].split("\n")[code["line"] - 1 :]
        fence = "`" * 3
        while any(fence in x for x in text[:lines]):
            fence += "`"
        out += [f"{code['file']}:{code['line']}", "", fence, *text[:lines], fence, *([f"{len(text) - lines} more lines"] if len(text) > lines else []), ""]
    return "\n".join([*out, "## Way in", "", way_in(symbol, result, code["line"]), ""])


def human_notes(text: str, begin: str, end: str) -> str:
    """What stands between two markers of an earlier report, to be kept in the next."""
    at = text.find(begin)
    to = text.find(end, at + len(begin)) if at >= 0 else -1
    return text[at + len(begin) : to] if to >= 0 else ""
