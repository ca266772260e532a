"""Routes and URLs: normal forms, keys, suffixes and features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A parameter of a route, and the character that stands for one while a URL is put together.
_HOLE, _MARK = "{*}", "\ue000"
#: ${...} and {{...}} with whatever braces they hold; an open ${ takes the rest of its template.
_HOLES = regex.compile(r"\$(?<braced>\{(?:[^{}]++|(?&braced))*\})|\{(?&braced)\}|\$\{[^`]*")
#: The operands of a concatenation: quoted texts, and code.
_OPERANDS = re.compile(r"""(['"`])(.*?)(?:\1|$)|([^'"`+]+)""", re.S)


def _clean(route: Column) -> Column:
    return F.lower(F.btrim(F.split(route, r"\?")[0], F.lit("/")))


def backend_route(route: Column) -> Column:
    """Lower case, without query and outer slashes, every parameter as {*}."""
    return _clean(F.regexp_replace(route, r"\{[^}]*\}", _HOLE))


def is_optional(segment: Column) -> Column:
    return segment.rlike(r"^\{[^}]*\?\}$")


def route_keys(route: Column, inferred: Column) -> Column:
    """The normal route; it without each trailing optional parameter; of an inferred route its form without a last 'index'."""
    segments = F.split(F.btrim(route, F.lit("/")), "/")
    # trailing optional parameters, of which the first segment is never one
    optional = F.aggregate(F.reverse(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, s: F.struct(F.when(a.on & is_optional(s), a.n + 1).otherwise(a.n).alias("n"), (a.on & is_optional(s)).alias("on"))).n
    kept = F.size(segments) - optional
    lengths = F.concat(
        F.transform(F.sequence(F.lit(0), optional), lambda k: F.size(segments) - k),
        F.when(F.coalesce(inferred, F.lit(False)) & (kept > 1) & (F.lower(F.get(segments, kept - 1)) == "index"), F.array(kept - 1)).otherwise(F.array().cast("array<int>")),
    )
    return F.array_distinct(F.transform(lengths, lambda n: backend_route(F.array_join(F.slice(segments, 1, n), "/"))))


def url_route(expression: str | None) -> tuple[str | None, bool]:
    """(route, whether a leading base URL was dropped); no route for what has no path.

    Holes are folded to one character each, from the outside, so that quotes inside them don't matter; what is left
    are quoted texts, taken as they are, and code, each run of which is a hole.
    """
    url = "".join((_MARK if code.strip() else "") if code else quoted for _, quoted, code in _OPERANDS.findall(_HOLES.sub(_MARK, expression or "")))
    dropped = url.startswith(_MARK)
    path = url.removeprefix(_MARK)
    if "/" not in path:
        return None, dropped
    return path.partition("?")[0].strip("/").lower().replace(_MARK, _HOLE) or None, dropped


@F.pandas_udf(T.StructType([T.StructField("route", T.StringType()), T.StructField("dropped", T.BooleanType())]))
def frontend_url(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in urls:
        yield pd.DataFrame([url_route(x) for x in s], columns=["route", "dropped"])


def feature(path: Column, app_dir: str) -> Column:
    """The folder after the app folder in a path, else its first folder, else 'unknown'."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    app = [p.lower() for p in app_dir.replace("\\", "/").split("/") if p]
    first = F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise("unknown")
    if not app:
        return first
    wanted = F.array(*(F.lit(p) for p in app))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - len(app) + 1, F.lit(1))), lambda i: F.transform(F.slice(parts, i, len(app)), F.lower) == wanted)
    after = F.get(starts, 0) - 1 + len(app)
    return F.when((F.size(starts) > 0) & (after < F.size(parts) - 1), F.get(parts, after)).otherwise(first)


# The plain HTTP verbs that a method's name may begin with.
VERBS = ["DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT"]


def composed_route(prefix: Column, template: Column) -> Column:
    """A type's route and a member's: one slash between them; a member's absolute template (from / or ~/) stands alone."""
    own, outer = F.coalesce(template, F.lit("")), F.btrim(F.coalesce(prefix, F.lit("")), F.lit("/"))
    absolute = own.startswith("/") | own.startswith("~/")
    both = F.concat_ws("/", F.when(outer != "", outer), F.when(F.btrim(own, F.lit("/")) != "", F.btrim(own, F.lit("/"))))
    return F.when(absolute, F.btrim(F.ltrim(own, F.lit("~")), F.lit("/"))).otherwise(both)


def filled_route(route: Column, controller: Column, action: Column, area: Column, drop_async: bool = True) -> Column:
    """The route with its tokens in square brackets, in any case, replaced: a controller without that ending, an action without Async."""
    name = F.when((F.length(controller) > 10) & controller.endswith("Controller"), F.left(controller, F.length(controller) - 10)).otherwise(controller)
    method = F.when((F.length(action) > 5) & action.endswith("Async"), F.left(action, F.length(action) - 5)).otherwise(action) if drop_async else action
    out = route
    for token, value in (("controller", name), ("action", method), ("area", area)):
        plain = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        out = F.regexp_replace(out, F.lit(rf"(?i)\[{token}\]"), plain)
    return out


def verb_by_name(method: Column) -> Column:
    """The verb that a method's name begins with, in any case; POST if with none."""
    out = F.lit("POST")
    for v in VERBS:
        out = F.when(F.startswith(F.upper(method), F.lit(v)), v).otherwise(out)
    return F.coalesce(out, F.lit("POST"))


def is_inside(path: Column, folder: str) -> Column:
    """Whether a path is the folder or below it, in any case and with either slash."""
    plain = F.concat(F.rtrim(F.lower(F.translate(path, "\\", "/")), F.lit("/")), F.lit("/"))
    return F.startswith(plain, F.lit(folder.replace("\\", "/").lower().rstrip("/") + "/"))
