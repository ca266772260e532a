"""Frontend sources: which files count, and the jQuery calls in their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no code of the application, below the root.
SKIPPED = ["node_modules", "dist", "bin", "obj"]

# The request methods of jQuery and the verbs that they imply.
VERBS = {"ajax": "GET", "get": "GET", "getJSON": "GET", "post": "POST"}
#: What a script is made of: gaps, texts, names, and single marks.
_LEXEMES = re.compile(r"""(?P<gap>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[\w$]+)|(?P<mark>.)""", re.S)
_PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Lexeme:
    kind: str
    text: str
    start: int
    end: int


def counts(path: Column) -> Column:
    """Whether a path below the root is scanned: scripts and views outside skipped folders."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    folders = F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1)
    vendored = F.concat(F.lit("/"), low).contains("/wwwroot/lib/")
    script = name.endswith(".js") & ~name.rlike(r"\.(min|spec|test)\.js$")
    return (script | name.endswith(".cshtml")) & ~F.arrays_overlap(folders, F.array(*(F.lit(s) for s in SKIPPED))) & ~vendored


def script_only(text: str) -> str:
    """A view's text with all but its scripts blanked; lines stay where they are."""
    low, out, at = text.translate(_PLAIN), [], 0
    blank = lambda s: "".join(c if c in "\r\n" else " " for c in s)
    while (tag := low.find("<script", at)) >= 0:
        begin = low.find(">", tag) + 1
        end = low.find("</script", begin)
        if not begin or end < 0:
            break
        is_tag = not low[tag + 7].isalnum()
        out += [blank(text[at:begin]), text[begin:end] if is_tag else blank(text[begin:end])]
        at = end
    return "".join([*out, blank(text[at:])])


def lexemes(source: str) -> list[Lexeme]:
    return [Lexeme(m.lastgroup, m[0], m.start(), m.end()) for m in _LEXEMES.finditer(source) if m.lastgroup != "gap"]


def parts(tokens: list[Lexeme], at: int) -> tuple[list[list[Lexeme]], bool]:
    """What a bracket that opened before `at` holds, cut at its own commas, and whether it closes."""
    out: list[list[Lexeme]] = [[]]
    depth = 0
    for t in tokens[at:]:
        if t.kind == "mark":
            if t.text in ")]}":
                if not depth:
                    return out, True
                depth -= 1
            elif t.text in "([{":
                depth += 1
            elif t.text == "," and not depth:
                out.append([])
                continue
        out[-1].append(t)
    return out, False


def fields(value: list[Lexeme]) -> dict[str, list[Lexeme]]:
    """The fields of an object literal by name, the first of each; none of anything else."""
    out: dict[str, list[Lexeme]] = {}
    if value and value[0].text == "{":
        for part in parts(value, 1)[0]:
            if len(part) > 2 and part[1].text == ":":
                out.setdefault(part[0].text.strip("'\""), part[2:])
    return out


def request(method: str, given: list[list[Lexeme]]) -> tuple[str, list[Lexeme] | None]:
    """(verb, URL expression) of a call: jQuery.ajax takes (url, settings) or (settings), the others (url, ...)."""
    first = given[0]
    if method != "ajax":
        return VERBS[method], first
    settings = fields(first) or (fields(given[1]) if len(given) > 1 else {})
    named = settings.get("type") or settings.get("method") or []
    verb = named[0].text.strip("'\"").upper() if len(named) == 1 and named[0].kind == "text" else VERBS[method]
    if first and first[0].text == "{":
        return verb, settings.get("url")
    # a lone name is settings made elsewhere
    return verb, first if len(given) > 1 or any(t.kind == "text" for t in first) else None


def calls_in(text: str, view: bool) -> Iterator[tuple[int, str, str | None, str | None]]:
    """(line, verb, URL expression, reason why it can't be resolved) of each jQuery call, those of ajax first."""
    source = script_only(text) if view else text
    tokens = lexemes(source)
    found = []
    for i in range(len(tokens) - 3):
        a, dot, name, bracket = tokens[i : i + 4]
        if a.text in ("$", "jQuery") and dot.text == "." and name.text in VERBS and bracket.text == "(":
            found.append((name.text != "ajax", i, a, name.text))
    for _, i, a, method in sorted(found, key=lambda x: x[:2]):
        given, closed = parts(tokens, i + 4)
        verb, value = request(method, given) if closed else (VERBS[method], None)
        url = source[value[0].start : value[-1].end] if value else None
        reason = None if url else "no URL"
        if url and view and "@" in url:
            helper = url.replace("@(", "@").partition("@Url.")[2]
            reason = "a routing helper's URL" if helper.startswith(("Action", "RouteUrl")) else "a Razor expression"
        yield source.count("\n", 0, a.start) + 1, verb, url, reason


def scan(files: DataFrame) -> DataFrame:
    """files: path, text. (file, line, httpMethod, rawUrl, reason): calls with a reason are unparsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *c) for p, t in zip(b["path"], b["text"]) for c in calls_in(t or "", p.lower().endswith(".cshtml"))]
            yield pd.DataFrame(rows, columns=["file", "line", "httpMethod", "rawUrl", "reason"])

    return files.where(counts(F.col("path"))).select("path", "text").mapInPandas(run, "file string, line int, httpMethod string, rawUrl string, reason string")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path below the root, text) of the files that count; the scan leaves the others out by name, unread."""
    base = "/" + root.strip("/") + "/"
    below = lambda path: F.substring_index(path, base, -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{js,cshtml,JS,CSHTML}").load(root)
    # a condition on the file's name alone is judged where files are listed; names there are URIs
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.where(counts(below(name))).select(below(F.col("path")).alias("path"), F.col("content").cast("string").alias("text"))
