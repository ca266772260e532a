"""Impact of a symbol: who reaches it, over what, how surely, and how much that matters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import display_name, is_test_project, strip_prefix
from tessera.lineage import cut
from tessera.operators import graph
from tessera.operators.link import Factored

#: Confirmed entry points above which a symbol is a hub; depths that may be asked for.
HUB, LEAST_DEPTH, MOST_DEPTH = 30, 1, 10
EXPANSIONS = ["interface", "mediatr", "override"]


def clamped(depth: int) -> int:
    """A depth within what may be asked for."""
    return max(LEAST_DEPTH, min(MOST_DEPTH, depth))


def first_rows(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The first row of each key in source order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where("__n = 1").drop("__n")


def is_expansion(via: Column) -> Column:
    """Whether an edge was inferred by an expansion; delegates weren't."""
    return F.coalesce(via.isin(EXPANSIONS), F.lit(False))


def fan_in(edges: DataFrame) -> DataFrame:
    """(to, direct_fan_in, inferred_only): distinct callers of each symbol, and those that only expansions bring."""
    calls = edges.where(F.col("kind").isin("call", "new") & (F.col("from") != F.col("to")))
    by_caller = calls.groupBy("to", "from").agg(F.bool_and(is_expansion(F.col("via"))).alias("inferred"))
    return by_caller.groupBy("to").agg(F.count("*").alias("direct_fan_in"), F.count_if("inferred").alias("inferred_only"))


def via_counts(used: DataFrame) -> DataFrame:
    """One row: edges used by how they came about."""
    return used.agg(*(F.count_if(F.coalesce(F.col("via") == v, F.lit(False))).alias(f"via_{v}") for v in ("interface", "override", "mediatr", "delegate")), F.count("*").alias("edges_used"))


def sure_targets(edges: DataFrame, symbols: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(to): targets of interface edges whose containing type is confirmed; of the symbols, only those targets' rows are compared."""
    targets = cut(edges.where("via = 'interface'").select("to").distinct(), "targets")
    types = first_rows(symbols.select("id", "containingType", "seq").join(targets, F.col("id") == F.col("to"), "left_semi"))
    known = types.join(confirmed, F.col("containingType") == F.col("containing"), "left_semi")
    return cut(known.select(F.col("id").alias("to")), "sure")


def confirmed_types(di: DataFrame) -> DataFrame:
    """(containing): the implementations that a binding confirms, without prefix."""
    return di.select(strip_prefix(F.col("impl")).alias("containing")).distinct()


def with_confirmation(edges: DataFrame, symbols: DataFrame, confirmed: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """edges with `confirmed`: sure unless an interface edge leads elsewhere than its site's confirmed candidates.

    A site without candidates, or none of whose candidates is confirmed, confirms all its edges; a target without
    containing type isn't confirmed where candidates are.
    """
    places = ["from", "file", "line"]
    asked = edges if sites is None else sites
    sure = sure_targets(asked.select("to", "via") if sites is None else asked.select("to", "via").union(edges.select("to", "via")), symbols, confirmed)
    asks = F.coalesce(F.col("via") == "interface", F.lit(False))
    # only edges to what isn't sure by itself are looked up by their place; all others stay where they are
    met = edges.where(asks)
    bound = asked.where("kind = 'call' and via = 'interface'").join(sure, "to", "left_semi").select(*places).distinct()
    unsure = met.join(sure, "to", "left_anti").join(bound.withColumn("__bound", F.lit(True)), places, "left").withColumn("confirmed", F.col("__bound").isNull())
    told = edges.where(~asks).union(met.join(sure, "to", "left_semi").select(*edges.columns)).withColumn("confirmed", F.lit(True))
    return told.union(unsure.select(*edges.columns, "confirmed"))


def risk_score(confirmed: Column, tests: Column, hops: Column, any_entry: Column, intermediates: Column) -> Column:
    """0 to 10; null if callers are known but neither entry points nor tests."""
    ep, t = confirmed.cast("double"), tests
    raw = F.ceil(F.lit(0.6) * ep + F.lit(0.15) * hops.cast("double") - F.when(t > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    score = F.least(F.greatest(raw, F.when(ep > 0, 1).otherwise(0).cast("long")), F.lit(10).cast("long")).cast("int")
    return F.when((any_entry == 0) & (t == 0) & (intermediates > 0), F.lit(None).cast("int")).when((ep == 0) & (t == 0), F.lit(0)).otherwise(score)


def buckets(reached: DataFrame, symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """Reached nodes but the roots with bucket ('entry', 'test', 'intermediate'), project, display name and entry point.

    An entry point in a test project is an entry point.
    """
    known = first_rows(symbols).select("id", F.col("name").alias("__name"), "containingType", "kind", "project", "file", "line")
    points = first_rows(entries).select("id", "type", "httpMethod", "route", "routeInferred")
    out = reached.where("depth > 0").join(known, "id", "left").join(points, "id", "left")
    project = F.coalesce("project", F.lit("?"))
    bucket = F.when(F.col("type").isNotNull(), "entry").when(is_test_project(project), "test").otherwise("intermediate")
    return out.withColumn("display", display_name(F.col("__name"), F.col("containingType"), F.col("id"))).withColumn("bucket", bucket).withColumn("project", project).drop("__name")


def screens(entries: DataFrame, links: DataFrame | Factored, calls: DataFrame) -> DataFrame:
    """Frontend calls that reach http entry points: by feature, file and line."""
    http = entries.where("type = 'http'").select(F.col("id").alias("backendId"))
    first = first_rows(calls).withColumnRenamed("id", "frontendId")
    shown = ["backendId", "frontendId", "matchKind", "feature", "file", "line", "confidence", "route"]
    if isinstance(links, Factored):
        return links.pairs(*screen_halves(http, links, first.drop("seq"))).select(*shown)
    return http.join(links, "backendId").join(first, "frontendId").select(*shown)


def screen_halves(http: DataFrame, links: Factored, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shape, frontendId, ...) and (class, backendId): the links' calls with their first row, their endpoints that are asked for."""
    calls = links.calls.select("shape", "frontendId").join(first, "frontendId")
    return calls, links.endpoints.join(http, F.col("id") == F.col("backendId")).select("class", "backendId")


def screen_quality(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("screens"), F.countDistinct("feature").alias("features"), F.count_if(F.expr("confidence = 'low'")).alias("low_confidence"), F.count_if(F.expr("matchKind = 'ambiguous'")).alias("ambiguous"), F.count_if(F.expr("matchKind = 'suffix'")).alias("suffix"))


def factored_quality(entries: DataFrame, links: Factored, calls: DataFrame) -> DataFrame:
    """What screen_quality() tells of all screens, from the numbers of calls and endpoints that meet."""
    http = entries.where("type = 'http'").select(F.col("id").alias("backendId"))
    callers, endpoints = screen_halves(http, links, first_rows(calls).select(F.col("id").alias("frontendId"), "feature", "confidence"))
    some = callers.groupBy("shape", "feature", "confidence").agg(F.count("*").alias("calls"))
    ends = endpoints.groupBy("class").agg(F.count("*").alias("ends"))
    met = links.matches.join(some, "shape").join(ends, "class").withColumn("n", F.col("calls") * F.col("ends"))
    of = lambda which: F.coalesce(F.sum(F.when(F.expr(which), F.col("n"))), F.lit(0))
    return met.agg(of("true").alias("screens"), F.countDistinct("feature").alias("features"), of("confidence = 'low'").alias("low_confidence"), of("matchKind = 'ambiguous'").alias("ambiguous"), of("matchKind = 'suffix'").alias("suffix"))


def tickets_of(tickets: DataFrame, file: str) -> DataFrame:
    return tickets.where(F.array_contains("files", file)).orderBy(F.desc("date"), "ticket")


def co_changed(co_change: DataFrame, file: str) -> DataFrame:
    return co_change.where((F.col("fileA") == file) | (F.col("fileB") == file)).orderBy(F.desc("strength"), "fileA", "fileB")


@dataclass
class Impact:
    """Everything a report needs; renderers ask nothing more. What goes beyond the graph is looked up when it is asked for."""

    index: object
    file: str
    entry_points: DataFrame
    tests: DataFrame
    intermediates: DataFrame
    modules: DataFrame
    summary: DataFrame
    ways: DataFrame

    @property
    def screens(self) -> DataFrame:
        return screens(self.entry_points, self.index.api_links, self.index.frontend_calls).orderBy("feature", "file", "line")

    @property
    def tickets(self) -> DataFrame:
        return tickets_of(self.index.tickets, self.file)

    @property
    def co_change(self) -> DataFrame:
        return co_changed(self.index.co_change, self.file)


def inferred_route() -> Column:
    """Whether a node is an http entry point whose route was inferred."""
    return F.expr("bucket = 'entry' and type = 'http' and coalesce(routeInferred, false)")


def edge_counts() -> list[Column]:
    """Aggregates of the edges used: how many came about in each way that a report must own up to."""
    ways = {"interface_edges": "via = 'interface'", "unconfirmed_edges": "via = 'interface' and not confirmed", "override_edges": "via = 'override'", "mediator_edges": "via = 'mediatr'", "delegate_edges": "via = 'delegate'"}
    return [F.count_if(F.expr(which)).alias(name) for name, which in ways.items()]


def impact(index, symbol: str, depth: int = 5) -> Impact:
    """The impact of one symbol of a CodeIndex."""
    spark = index.symbols.sparkSession
    root = spark.createDataFrame([(symbol,)], "id string")
    reached = graph.reach_ways(index.edges, root, depth)
    used = cut(with_confirmation(graph.edges_used(index.edges, reached, depth), index.symbols, confirmed_types(index.di_confirmed), sites=index.edges).select("from", "to", "via", "confirmed"), "used")
    sure = graph.propagate(used, root, F.col("confirmed")).withColumn("is_confirmed", F.lit(True))
    nodes = cut(buckets(reached.select("id", "depth"), index.symbols, index.entry_points).join(sure, "id", "left").withColumn("is_confirmed", F.coalesce("is_confirmed", F.lit(False))), "nodes")
    entry = nodes.where("bucket = 'entry'")
    modules = entry.where("is_confirmed").groupBy("project").agg(F.count("*").alias("entry_points"))
    own = first_rows(index.symbols.where(F.col("id") == symbol)).select("file").first()
    file = own["file"] if own else ""
    counts = nodes.agg(
        F.count_if(F.expr("bucket = 'entry'")).alias("entry_points"), F.count_if(F.expr("bucket = 'entry' and is_confirmed")).alias("confirmed"),
        F.count_if(F.expr("bucket = 'test'")).alias("tests"), F.count_if(F.expr("bucket = 'intermediate'")).alias("intermediates"),
        F.count_if(inferred_route()).alias("inferred_routes"),
    )
    vias = used.agg(*edge_counts())
    fan = fan_in(index.edges.where(F.col("to") == symbol)).agg(F.coalesce(F.max("direct_fan_in"), F.lit(0)).alias("direct_fan_in"), F.coalesce(F.max("inferred_only"), F.lit(0)).alias("inferred_only"))
    one = counts.crossJoin(F.broadcast(vias)).crossJoin(F.broadcast(fan))  # one row each
    hops = F.col("interface_edges") - F.col("unconfirmed_edges") + F.col("override_edges")
    summary = one.withColumn("hub", F.col("confirmed") > HUB).withColumn("risk", risk_score(F.col("confirmed"), F.col("tests"), hops, F.col("entry_points"), F.col("intermediates")))
    return Impact(
        index, file, entry.orderBy("project", "display"), nodes.where("bucket = 'test'").orderBy("display"), nodes.where("bucket = 'intermediate'").orderBy("depth", "display"),
        modules.orderBy(F.desc("entry_points"), "project"), summary, reached,
    )


def by_group_size(rows: DataFrame, group: str = "project", order: tuple[str, ...] = ("depth", "display")) -> DataFrame:
    """rows with the size of their group, the largest groups first, then by group and within it in order."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("in_group"))
    return rows.join(sizes, group).orderBy(F.desc("in_group"), group, *order)


def sampled(rows: DataFrame, n: int, seed: int = 1, key: str = "id") -> DataFrame:
    """n rows, the same for the same seed: those of least hash of their key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def nearest_path(nodes: DataFrame) -> DataFrame:
    """The closest entry point; where there is none, the nearest caller that isn't classified."""
    order = F.struct(F.when(F.col("bucket") == "entry", 0).otherwise(1).alias("r"), "depth", "project", "display")
    return nodes.where("bucket <> 'test'").agg(F.min_by(F.struct("id", "display", "depth", "bucket"), order).alias("x")).select("x.*").where("id is not null")


def nearest_declaration(declarations: DataFrame, scanned_line: int) -> DataFrame:
    """Of each id's declarations (id, line) the one nearest to the scanned line, the earlier of two as near."""
    return declarations.groupBy("id").agg(F.min_by("line", F.struct(F.abs(F.col("line") - scanned_line).alias("d"), "line")).alias("line"))


def snippet(text: Column, lines: int = 40) -> Column:
    """(text, more): the first lines of a text and how many aren't shown."""
    parts = F.split(text, "\n")
    return F.struct(F.array_join(F.slice(parts, 1, lines), "\n").alias("text"), F.greatest(F.size(parts) - lines, F.lit(0)).alias("more"))


#: Reasons that a report may miss something: those the summary counts, and those of its screens, each with its column.
SUMMARY_SPOTS = {
    "inferred_routes": "inferred_routes", "mediator_edges": "mediator_edges", "interface_edges": "interface_edges", "override_edges": "override_edges",
    "delegate_edges": "delegate_edges", "unconfirmed_interface_edges": "unconfirmed_edges", "inferred_only_callers": "inferred_only",
}
SCREEN_SPOTS = {"low_confidence_screens": "low_confidence", "ambiguous_screens": "ambiguous", "suffix_screens": "suffix"}


def stacked(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(reason, n): a row for each of the columns of a one-row table."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(reason).alias("reason"), F.col(c).cast("long").alias("n")) for reason, c in columns.items()))))


def blind_spots(summary: DataFrame, degraded: DataFrame, quality: DataFrame, nodes: DataFrame, known: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """One row for each reason why a report may miss something, with its count; reasons without cases are left out.

    known: the rows of the asked symbol; meta: the index's document. Where they are given and empty, that is a reason too.
    """
    projects = nodes.select("project").distinct().join(degraded.select("project").distinct(), "project", "left_semi")
    out = stacked(summary, SUMMARY_SPOTS).union(stacked(quality, SCREEN_SPOTS))
    out = out.union(projects.agg(F.lit("degraded_projects").alias("reason"), F.count("*").alias("n")))
    for reason, rows in (("unknown_symbol", known), ("no_meta", meta)):
        if rows is not None:
            out = out.union(rows.limit(1).agg(F.lit(reason).alias("reason"), (1 - F.count("*")).alias("n")))
    return out.where("n > 0")
