"""Registered queries of the engine's own operators over the star-schema lens, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import routes, text
from tessera.lineage import shared_dir
from tessera.operators import factored, graph, history, impact, link, project_map, scan_passes, search, status
from tessera.plans import lens as sql
from tessera.plans.lens import Lens
from tessera.sources import postings, projects
from tessera.streaming import co_change as stream_co_change

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROOT, DEPTH = "R:1", 3


def query(oracle: str | None = None, *views: str):
    """Registers a function of a Lens under its name, with the oracle's SQL after the views it uses."""

    def register(f: Callable[[Lens], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + oracle
        return f

    return register


def root(v: Lens) -> DataFrame:
    return v.spark.createDataFrame([(ROOT,)], "id string")


REACH = f"""walk AS (
  SELECT '{ROOT}' AS id, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.depth < {DEPTH}
), reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query("SELECT id, depth FROM reached", sql.EDGES_SQL, REACH)
def reverse_reach_depth(v: Lens) -> DataFrame:
    return graph.reach_depths(v.kept_edges(), root(v), DEPTH)


@query("SELECT kind, depth, count(*) AS n FROM reached JOIN symbols USING (id) GROUP BY kind, depth", sql.SYMBOLS_SQL, sql.EDGES_SQL, REACH)
def reach_by_kind(v: Lens) -> DataFrame:
    reached = graph.reach_depths(v.kept_edges(), root(v), DEPTH)
    return reached.join(v.symbols().select("id", "kind"), "id").groupBy("kind", "depth").agg(F.count("*").alias("n"))


BUCKETS = """bucketed AS (
  SELECT r.id, r.depth, coalesce(s.project, '?') AS project, CASE WHEN s.id IS NULL THEN substr(r.id, 3) WHEN s.containing IS NULL THEN s.name ELSE s.containing || '.' || s.name END AS display, e.type,
    CASE WHEN e.id IS NOT NULL THEN 'entry' WHEN s.project = 'BUILDING.Tests' THEN 'test' ELSE 'intermediate' END AS bucket
  FROM reached r LEFT JOIN symbols s ON r.id = s.id LEFT JOIN entries e ON r.id = e.id WHERE r.depth > 0
)"""


@query("SELECT id, depth, project, display, bucket FROM bucketed", sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.ENTRIES_SQL, REACH, BUCKETS)
def reach_bucketed(v: Lens) -> DataFrame:
    reached = graph.reach_depths(v.kept_edges(), root(v), DEPTH)
    return impact.buckets(reached, v.symbols(), v.entry_points()).select("id", "depth", "project", "display", "bucket")


@query(
    f"""SELECT count(*) FILTER (via = 'interface') AS via_interface, count(*) FILTER (via = 'override') AS via_override, count(*) FILTER (via = 'mediatr') AS via_mediatr,
    count(*) FILTER (via = 'delegate') AS via_delegate, count(*) AS edges_used FROM edges JOIN reached ON dst = id WHERE depth < {DEPTH}""",
    sql.EDGES_SQL,
    REACH,
)
def edges_used_via_counts(v: Lens) -> DataFrame:
    edges = v.kept_edges()
    return impact.via_counts(graph.edges_used(edges, graph.reach_depths(edges, root(v), DEPTH), DEPTH))


@query(
    """SELECT dst AS "to", count(*) AS direct_fan_in, count(*) FILTER (inferred) AS inferred_only FROM (
    SELECT dst, src, bool_and(coalesce(via IN ('interface', 'override', 'mediatr'), false)) AS inferred FROM edges WHERE kind IN ('call', 'new') AND src <> dst GROUP BY dst, src) GROUP BY dst""",
    sql.EDGES_SQL,
)
def direct_fan_in(v: Lens) -> DataFrame:
    return impact.fan_in(v.edges())


CONFIRMED = f"""types AS (SELECT DISTINCT substr(impl, 3) AS containing FROM di),
sites AS (SELECT DISTINCT e.src, e.file, e.line FROM edges e JOIN symbols s ON e.dst = s.id JOIN types t ON s.containing = t.containing WHERE e.kind = 'call' AND e.via = 'interface'),
used AS (
  SELECT e.*, e.via IS DISTINCT FROM 'interface' OR x.src IS NULL OR t.containing IS NOT NULL AS confirmed
  FROM edges e JOIN reached r ON e.dst = r.id AND r.depth < {DEPTH} LEFT JOIN symbols s ON e.dst = s.id LEFT JOIN types t ON s.containing = t.containing
  LEFT JOIN sites x ON x.src = e.src AND x.file = e.file AND x.line = e.line
), sure AS (SELECT '{ROOT}' AS id UNION SELECT u.src FROM sure w JOIN used u ON u.dst = w.id WHERE u.confirmed)"""


def confirmed_used(v: Lens) -> tuple[DataFrame, DataFrame]:
    edges, symbols = v.kept_edges(), v.symbols()
    reached = graph.reach_depths(edges, root(v), DEPTH)
    used = impact.with_confirmation(graph.edges_used(edges, reached, DEPTH), symbols, impact.confirmed_types(v.di()), sites=edges)
    return reached, used


@query("SELECT r.id, r.depth, s.id IS NOT NULL AS confirmed FROM reached r LEFT JOIN sure s ON r.id = s.id", sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.DI_SQL, REACH, CONFIRMED)
def confirmed_reach(v: Lens) -> DataFrame:
    reached, used = confirmed_used(v)
    sure = graph.propagate(used, root(v), F.col("confirmed")).withColumn("confirmed", F.lit(True))
    return reached.join(sure, "id", "left").select("id", "depth", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


@query(
    "SELECT project, count(*) AS entry_points FROM bucketed JOIN sure USING (id) WHERE bucket = 'entry' GROUP BY project",
    sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.ENTRIES_SQL, sql.DI_SQL, REACH, BUCKETS, CONFIRMED,
)
def module_fan_in(v: Lens) -> DataFrame:
    reached, used = confirmed_used(v)
    entry = impact.buckets(reached, v.symbols(), v.entry_points()).where("bucket = 'entry'")
    return entry.join(graph.propagate(used, root(v), F.col("confirmed")), "id", "left_semi").groupBy("project").agg(F.count("*").alias("entry_points"))


LINKS = """keys AS (
  SELECT id, verb, regexp_replace(route, '\\{[^}]*\\}', '{*}', 'g') AS key FROM entries WHERE type = 'http'
  UNION SELECT id, verb, regexp_replace(route, '/\\{id\\?\\}$', '') FROM entries WHERE type = 'http'
), exact_all AS (
  SELECT c.id AS fe, k.id AS be, CASE WHEN k.verb = c.verb THEN 0 ELSE 1 END AS p FROM calls c JOIN keys k ON c.route = k.key AND k.verb IN (c.verb, 'ANY')
), exact AS (SELECT DISTINCT fe, be FROM exact_all e WHERE p = (SELECT min(p) FROM exact_all x WHERE x.fe = e.fe)
), suffix_all AS (
  SELECT c.id AS fe, k.id AS be, CASE WHEN k.verb = c.verb THEN 0 ELSE 1 END AS p FROM calls c JOIN keys k ON k.verb IN (c.verb, 'ANY') AND ends_with(k.key, '/' || c.route)
  WHERE c.dropped AND c.id NOT IN (SELECT fe FROM exact)
), suffix AS (SELECT DISTINCT fe, be FROM suffix_all e WHERE p = (SELECT min(p) FROM suffix_all x WHERE x.fe = e.fe)
), links AS (
  SELECT fe, be, CASE WHEN count(*) OVER (PARTITION BY fe) > 1 THEN 'ambiguous' ELSE 'exact' END AS kind FROM exact
  UNION ALL SELECT fe, be, CASE WHEN count(*) OVER (PARTITION BY fe) > 1 THEN 'ambiguous' ELSE 'suffix' END FROM suffix
)"""
LINK_VIEWS = (sql.ENTRIES_SQL, sql.CALLS_SQL, LINKS)

#: The supplier that some queries ask for.
WHOLE_ROOT = "S:1"


#: Http entry points with an inferred route.
INFERRED = "count(*) FILTER (bucket = 'entry' AND type = 'http' AND substr(b.id, 3)::BIGINT % 5 = 0)"


class _LensIndex:
    """What impact() needs, from the lens; the parts beyond the graph are made when they are asked for."""

    def __init__(self, v: Lens):
        self.v, self.symbols, self.edges, self.entry_points, self.di_confirmed = v, v.symbols(), v.kept_edges(), v.entry_points(), v.di()
        self.frontend_calls, self.tickets = v.frontend_calls(), v.tickets()

    @cached_property
    def api_links(self) -> link.Factored:
        return link.link(self.entry_points, self.frontend_calls).factored

    @cached_property
    def co_change(self) -> DataFrame:
        """Pairs of the lens's commits, whose parts' files are taken for those of suppliers."""
        pairs = history.co_change(self.v.commits())
        return pairs.withColumns({c: F.regexp_replace(c, "^p/", "S/") for c in ("fileA", "fileB")})


@query(
    f"""SELECT c.*, i.*, f.*, c.confirmed > 30 AS hub,
    CASE WHEN entry_points = 0 AND tests = 0 AND intermediates > 0 THEN NULL WHEN confirmed = 0 AND tests = 0 THEN 0
      ELSE least(greatest(ceil(0.6::DOUBLE * confirmed + 0.15::DOUBLE * (interface_edges - unconfirmed_edges + override_edges) - CASE WHEN tests > 0 THEN 0.5::DOUBLE ELSE 0 END), CASE WHEN confirmed > 0 THEN 1 ELSE 0 END), 10)::INT END AS risk
    FROM (SELECT count(*) FILTER (bucket = 'entry') AS entry_points, count(*) FILTER (bucket = 'entry' AND s.id IS NOT NULL) AS confirmed, count(*) FILTER (bucket = 'test') AS tests, count(*) FILTER (bucket = 'intermediate') AS intermediates, {INFERRED} AS inferred_routes
      FROM bucketed b LEFT JOIN sure s ON b.id = s.id) c,
    (SELECT count(*) FILTER (via = 'interface') AS interface_edges, count(*) FILTER (via = 'interface' AND NOT confirmed) AS unconfirmed_edges, count(*) FILTER (via = 'override') AS override_edges,
      count(*) FILTER (via = 'mediatr') AS mediator_edges, count(*) FILTER (via = 'delegate') AS delegate_edges FROM used) i,
    (SELECT count(DISTINCT src) AS direct_fan_in, 0::BIGINT AS inferred_only FROM edges WHERE dst = '{ROOT}' AND kind IN ('call', 'new')) f""",
    sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.ENTRIES_SQL, sql.DI_SQL, REACH, BUCKETS, CONFIRMED,
)
def impact_summary(v: Lens) -> DataFrame:
    return impact.impact(_LensIndex(v), ROOT, DEPTH).summary


@query(
    f"""SELECT 'ticket' AS kind, ticket AS what, NULL::DOUBLE AS strength FROM tickets WHERE list_contains(files, 'S/f1.cs')
    UNION ALL SELECT 'co_change', replace("fileA", 'p/', 'S/') || '|' || replace("fileB", 'p/', 'S/'), round_even(together::DOUBLE / least(a.total, b.total) * 100, 0) / 100
      FROM (SELECT x.file AS "fileA", y.file AS "fileB", count(*) AS together FROM kept x JOIN kept y ON x.seq = y.seq AND x.file < y.file WHERE x.file = 'p/f1.cs' OR y.file = 'p/f1.cs' GROUP BY ALL HAVING count(*) >= 3) p
      JOIN totals a ON a.file = "fileA" JOIN totals b ON b.file = "fileB"
    UNION ALL SELECT 'screen', fe, NULL FROM links JOIN (SELECT DISTINCT e.id FROM edges JOIN entries e ON src = e.id WHERE dst = 'S:1' AND type = 'http') ON be = id""",
    sql.EDGES_SQL, sql.TICKETS_SQL, sql.COMMITS_SQL, "totals AS (SELECT file, count(*) AS total FROM kept GROUP BY file)", *LINK_VIEWS,
)
def impact_context(v: Lens) -> DataFrame:
    """Tickets and co-changes of a supplier's file, and the screens whose calls come to it in one step."""
    found = impact.impact(_LensIndex(v), WHOLE_ROOT, 1)
    none = F.lit(None).cast("double").alias("strength")
    pairs = found.co_change.select(F.lit("co_change").alias("kind"), F.concat("fileA", F.lit("|"), "fileB").alias("what"), "strength")
    return found.tickets.select(F.lit("ticket").alias("kind"), F.col("ticket").alias("what"), none).union(pairs).union(found.screens.select(F.lit("screen").alias("kind"), F.col("frontendId").alias("what"), none))


@query(
    """SELECT id, depth, array_to_string(path, '>') AS path FROM (
    SELECT id, depth, path, row_number() OVER (PARTITION BY id ORDER BY depth) AS n FROM ways) WHERE n = 1""",
    sql.EDGES_SQL,
    # of the ways of one length to a node, only the first can begin a first way further on
    f"""ways AS (SELECT '{ROOT}' AS id, 0 AS depth, ['{ROOT}'] AS path, []::BIGINT[] AS place
    UNION ALL SELECT id, depth, path, place FROM (
      SELECT e.src AS id, w.depth + 1 AS depth, list_append(w.path, e.src) AS path, list_append(w.place, e.seq) AS place, row_number() OVER (PARTITION BY e.src ORDER BY list_append(w.place, e.seq), w.id, w.path) AS n
      FROM ways w JOIN edges e ON e.dst = w.id WHERE w.depth < {DEPTH}) WHERE n = 1)""",
)
def shortest_path(v: Lens) -> DataFrame:
    return graph.reverse_reach(v.kept_edges(), root(v), DEPTH).select("id", "depth", F.array_join("path", ">").alias("path"))


def nation_members(v: Lens) -> DataFrame:
    return v.t("supplier").select(F.concat(F.lit("N:"), F.col("s_nationkey").cast("string")).alias("iface_member"), F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("impl_member"))


@query(
    """SELECT src AS "from", 'S:' || s_suppkey AS "to", 'call' AS kind, file, line, 'interface' AS via FROM edges JOIN supplier ON dst = 'N:' || s_nationkey WHERE kind = 'call'""",
    sql.EDGES_SQL,
)
def interface_expand(v: Lens) -> DataFrame:
    return scan_passes.interface_edges(v.edges(), nation_members(v))


def mediations(v: Lens) -> tuple[DataFrame, DataFrame]:
    """Orders send their customer's last digit, which suppliers of that digit handle."""
    sends = v.t("orders").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("from"), (F.col("o_custkey") % 10).alias("request"), F.lit("O.cs").alias("file"), (F.col("o_orderkey") % 100).cast("int").alias("line"))
    handlers = v.t("supplier").select((F.col("s_suppkey") % 10).alias("request"), F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("handler"))
    return sends, handlers


@query("""SELECT 'O:' || o_orderkey AS "from", 'S:' || s_suppkey AS "to", 'call' AS kind, 'O.cs' AS file, (o_orderkey % 100)::INT AS line, 'mediatr' AS via FROM orders JOIN supplier ON o_custkey % 10 = s_suppkey % 10""")
def mediator_expand(v: Lens) -> DataFrame:
    return scan_passes.mediator_edges(*mediations(v))


def overrides(v: Lens, supplier: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Virtual calls of customers on regions, and who overrides whom."""
    nation = v.t("nation")
    name = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    one = nation.select(name("R", "n_regionkey").alias("overridden"), name("N", "n_nationkey").alias("override"), F.array("n_name").alias("types"))
    two = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("N", "s_nationkey").alias("overridden"), name("S", "s_suppkey").alias("override"), F.array("n_name").alias("types"))
    calls = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    calls = calls.select(name("C", "c_custkey").alias("from"), name("R", "n_regionkey").alias("to"), F.lit("C.cs").alias("file"), (F.col("c_custkey") % 100).cast("int").alias("line"), F.col("n_name").alias("receiver"))
    return calls, one.union(two)


@query(
    """SELECT DISTINCT 'C:' || c_custkey AS "from", b.node AS "to", 'call' AS kind, 'C.cs' AS file, (c_custkey % 100)::INT AS line, 'override' AS via
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN below b ON b.start = 'R:' || n_regionkey JOIN pairs p ON p.b = b.node AND p.type = n_name""",
    """pairs AS (SELECT 'R:' || n_regionkey AS a, 'N:' || n_nationkey AS b, n_name AS type FROM nation UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    """below AS (SELECT 'R:' || r_regionkey AS start, 'R:' || r_regionkey AS node FROM region UNION SELECT w.start, p.b FROM below w JOIN pairs p ON p.a = w.node)""",
)
def override_expand(v: Lens) -> DataFrame:
    return scan_passes.override_edges(*overrides(v, v.t("supplier"), v.t("customer")))


#: All edges with those of the expansions; customers, suppliers and orders call.
ALL_EDGES = """pairs AS (SELECT 'R:' || n_regionkey AS a, 'N:' || n_nationkey AS b, n_name AS type FROM nation UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
below AS (SELECT 'R:' || r_regionkey AS start, 'R:' || r_regionkey AS node FROM region UNION SELECT w.start, p.b FROM below w JOIN pairs p ON p.a = w.node),
more AS (
  SELECT src, 'S:' || s_suppkey AS dst, 'call' AS kind, file, line, 'interface' AS via FROM edges JOIN supplier ON dst = 'N:' || s_nationkey WHERE kind = 'call'
  UNION ALL SELECT 'O:' || o_orderkey, 'S:' || s_suppkey, 'call', 'O.cs', (o_orderkey % 100)::INT, 'mediatr' FROM orders JOIN supplier ON o_custkey % 10 = s_suppkey % 10
  UNION ALL SELECT DISTINCT 'C:' || c_custkey, b.node, 'call', 'C.cs', (c_custkey % 100)::INT, 'override'
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN below b ON b.start = 'R:' || n_regionkey JOIN pairs p ON p.b = b.node AND p.type = n_name
), whole AS (SELECT src, dst, kind, file, line, via FROM edges UNION ALL SELECT * FROM more)"""
#: Nodes that reach that supplier over all edges.
WHOLE_DEPTH = 2
WHOLE_REACH = f"""walk AS (SELECT '{WHOLE_ROOT}' AS id, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM walk w JOIN whole e ON e.dst = w.id WHERE w.depth < {WHOLE_DEPTH}),
reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def whole_graph(v: Lens) -> factored.Factored:
    """The edges, written once, with all three expansions in two halves."""
    edges = v.kept_edges()
    more = factored.interface_calls(edges, nation_members(v)).union(factored.mediator_sends(*mediations(v))).union(factored.override_calls(*overrides(v, v.t("supplier"), v.t("customer"))))
    more = more.kept()
    return factored.Factored(edges.select(*scan_passes.EDGE).unionByName(more.plain), more.sites, more.members)


def whole_root(v: Lens) -> DataFrame:
    return v.spark.createDataFrame([(WHOLE_ROOT,)], "id string")


@query("SELECT id, depth FROM reached", sql.EDGES_SQL, ALL_EDGES, WHOLE_REACH)
def expanded_reach(v: Lens) -> DataFrame:
    return factored.reach_depths(whole_graph(v), whole_root(v), WHOLE_DEPTH)


@query(f"SELECT via, count(*) AS n FROM whole JOIN reached ON dst = id WHERE depth < {WHOLE_DEPTH} GROUP BY via", sql.EDGES_SQL, ALL_EDGES, WHOLE_REACH)
def expanded_edges_used(v: Lens) -> DataFrame:
    f = whole_graph(v)
    return factored.edges_used(f, factored.reach_depths(f, whole_root(v), WHOLE_DEPTH), WHOLE_DEPTH)


@query(
    """SELECT dst AS "to", count(*) AS direct_fan_in, count(*) FILTER (inferred) AS inferred_only FROM (
    SELECT dst, src, bool_and(coalesce(via IN ('interface', 'override', 'mediatr'), false)) AS inferred FROM whole WHERE kind IN ('call', 'new') AND src <> dst GROUP BY dst, src) GROUP BY dst""",
    sql.EDGES_SQL, ALL_EDGES,
)
def expanded_fan_in(v: Lens) -> DataFrame:
    return factored.fan_in(whole_graph(v), impact.is_expansion(F.col("via")))


@query(
    """SELECT DISTINCT id FROM sure""", sql.EDGES_SQL, ALL_EDGES, sql.SYMBOLS_SQL, sql.DI_SQL,
    """types AS (SELECT DISTINCT substr(impl, 3) AS containing FROM di),
    sites AS (SELECT DISTINCT e.src, e.file, e.line FROM more e JOIN symbols s ON e.dst = s.id JOIN types t ON s.containing = t.containing WHERE e.via = 'interface'),
    judged AS (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM more WHERE via <> 'interface' UNION ALL
      SELECT e.src, e.dst FROM more e LEFT JOIN sites x ON x.src = e.src AND x.file = e.file AND x.line = e.line LEFT JOIN symbols s ON e.dst = s.id LEFT JOIN types t ON s.containing = t.containing
      WHERE e.via = 'interface' AND (x.src IS NULL OR t.containing IS NOT NULL))""",
    f"""sure AS (SELECT '{WHOLE_ROOT}' AS id UNION SELECT u.src FROM sure w JOIN judged u ON u.dst = w.id)""",
)
def expanded_confirmed(v: Lens) -> DataFrame:
    types = impact.first_rows(v.symbols()).select("id", F.col("containingType").alias("containing"))
    return factored.confirmed_reach(whole_graph(v), whole_root(v), impact.confirmed_types(v.di()), types)


@query(
    """SELECT via, count(DISTINCT src || '|' || coalesce(file, '') || '|' || coalesce(line, 0) || '|' || hub) AS sites, count(DISTINCT hub || '>' || dst) AS members, count(*) AS edges FROM (
    SELECT src, file, line, dst, via, CASE via WHEN 'interface' THEN substr(dst, 1, 0) || s_nationkey::VARCHAR ELSE (s_suppkey % 10)::VARCHAR END AS hub FROM more JOIN supplier ON dst = 'S:' || s_suppkey WHERE via <> 'override'
    UNION ALL SELECT src, file, line, dst, via, n_name FROM more JOIN customer ON src = 'C:' || c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE via = 'override') GROUP BY via""",
    sql.EDGES_SQL, ALL_EDGES,
)
def expanded_sizes(v: Lens) -> DataFrame:
    return factored.sizes(whole_graph(v))


@query("SELECT id, name FROM symbols WHERE kind = 'Method' AND id IN (SELECT dst FROM edges)", sql.SYMBOLS_SQL, sql.EDGES_SQL)
def implicit_constructors(v: Lens) -> DataFrame:
    return scan_passes.implicit_constructors(v.symbols().where("kind = 'Method'"), v.edges()).select("id", "name")


@query(
    """SELECT service, array_to_string(list(DISTINCT impl ORDER BY impl), ',') AS impls FROM (
    SELECT 'N:' || s_nationkey AS service, 'S:' || (s_suppkey % 40) AS impl FROM supplier UNION ALL SELECT 'N:' || c_nationkey, 'S:' || (c_custkey % 40) FROM customer) GROUP BY service"""
)
def di_map(v: Lens) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(f"{letter}:"), c.cast("string"))
    one = v.t("supplier").select(name("N", F.col("s_nationkey")).alias("service"), name("S", F.col("s_suppkey") % 40).alias("impl"))
    two = v.t("customer").select(name("N", F.col("c_nationkey")).alias("service"), name("S", F.col("c_custkey") % 40).alias("impl"))
    return scan_passes.di_map(one, two).select("service", F.array_join("impls", ",").alias("impls"))


@query(
    """SELECT a.impl, a.service AS attribute_service, array_to_string(f.services, ',') AS fluent_services
    FROM (SELECT 'S:' || l_suppkey AS impl, arg_min('P:' || (l_partkey % 7), l_orderkey * 8 + l_linenumber) AS service FROM lineitem GROUP BY l_suppkey) a
    JOIN (SELECT 'S:' || s_suppkey AS impl, list(DISTINCT 'P:' || (s_nationkey % 7) ORDER BY 'P:' || (s_nationkey % 7)) AS services FROM supplier GROUP BY s_suppkey) f ON a.impl = f.impl
    WHERE NOT list_contains(f.services, a.service)"""
)
def di_conflict(v: Lens) -> DataFrame:
    item = v.t("lineitem")
    name = lambda letter, c: F.concat(F.lit(f"{letter}:"), c.cast("string"))
    rows = [F.expr("l_orderkey * 8 + l_linenumber").alias("seq"), name("P", F.col("l_partkey") % 7).alias("service"), name("S", F.col("l_suppkey")).alias("impl")]
    found = scan_passes.di_conflicts(item.select(*rows), v.t("supplier").select(name("P", F.col("s_nationkey") % 7).alias("service"), name("S", F.col("s_suppkey")).alias("impl")))
    return found.select("impl", "attribute_service", F.array_join("fluent_services", ",").alias("fluent_services"))


@query(
    """SELECT id, n AS projects, first_project FROM (SELECT 'P:' || (l_partkey % 500) AS id, count(DISTINCT l_suppkey % 3) AS n, first('prj' || (l_suppkey % 3) ORDER BY l_orderkey * 8 + l_linenumber, 'prj' || (l_suppkey % 3)) AS first_project
    FROM lineitem GROUP BY l_partkey % 500) WHERE n > 1"""
)
def duplicate_ids(v: Lens) -> DataFrame:
    item = v.t("lineitem")
    symbols = item.select(F.concat(F.lit("P:"), (F.col("l_partkey") % 500).cast("string")).alias("id"), F.concat(F.lit("prj"), (F.col("l_suppkey") % 3).cast("string")).alias("project"), F.lit("f").alias("file"), F.expr("l_orderkey * 8 + l_linenumber").alias("seq"))
    return scan_passes.duplicate_ids(symbols).select("id", F.size("projects").cast("long").alias("projects"), F.get("projects", 0).alias("first_project"))


CO_CHANGE = """SELECT "fileA", "fileB", together::INT AS together, a.total::INT AS "totalA", b.total::INT AS "totalB", round_even(together::DOUBLE / least(a.total, b.total) * 100, 0) / 100 AS strength
    FROM (SELECT x.file AS "fileA", y.file AS "fileB", count(*) AS together FROM kept x JOIN kept y ON x.seq = y.seq AND x.file < y.file GROUP BY ALL HAVING count(*) >= 3) p
    JOIN totals a ON a.file = "fileA" JOIN totals b ON b.file = "fileB" """
TOTALS = "totals AS (SELECT file, count(*) AS total FROM kept GROUP BY file)"


@query(CO_CHANGE, sql.COMMITS_SQL, TOTALS)
def co_change(v: Lens) -> DataFrame:
    return history.co_change(v.commits())


@query(CO_CHANGE, sql.COMMITS_SQL, TOTALS)
def co_change_incremental(v: Lens) -> DataFrame:
    """The same pairs kept up to date over commits that are published in parts, a third of them twice."""
    place = f"{shared_dir(v.spark)}/co-change-{uuid.uuid4().hex}"
    commits = v.commits()
    schema = commits.schema
    commits.write.parquet(f"{place}/in/part=0")
    published = v.spark.read.schema(schema).parquet(f"{place}/in/part=0")
    published.where("seq % 3 = 0").write.parquet(f"{place}/in/part=1")
    files = len(published.inputFiles())
    stream = v.spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max(1, files // 2)).parquet(f"{place}/in")
    stream_co_change.start(stream, f"{place}/out", f"{place}/state").awaitTermination()
    return stream_co_change.co_change(v.spark, f"{place}/out")


@query(
    """SELECT project, file FROM sources s JOIN brands b ON s.brand = b.brand AND file NOT LIKE '%.md' AND k % 10 > 1 AND (digit = '1' OR (digit = '2' AND k % 10 <> 3) OR (digit = '3' AND k % 7 = 1))
    UNION SELECT project, file FROM sources s JOIN brands b ON digit = '3' AND s.brand = 'Brand#1' AND k % 10 > 3 AND file NOT LIKE '%.md'
    UNION SELECT project, file FROM sources s JOIN brands b ON digit = '4' AND s.brand = b.brand AND k % 10 = 3
    UNION SELECT project, file FROM sources s JOIN brands b ON digit = '0' AND s.brand = b.brand AND k = least""",
    sql.SOURCES_SQL,
)
def project_files(v: Lens) -> DataFrame:
    """The files that brands' projects compile: default items, removals, shared folders, old projects, single files."""
    return projects.compile_files(projects.parsed(v.project_files()), v.source_files())


@query("SELECT project, 'src/Brand#1/p.csproj' AS reference FROM brands", sql.SOURCES_SQL)
def project_references(v: Lens) -> DataFrame:
    return projects.references(projects.parsed(v.project_files()))


@query(
    """SELECT ticket, count(DISTINCT c.seq) AS commits, arg_min(c.hash, c.seq) AS newest, arg_min(c.date, c.seq) AS date, arg_min(c.message, c.seq) AS message, count(DISTINCT k.file) AS files, min(k.file) AS first_file
    FROM (SELECT DISTINCT seq, hash, date, message, unnest(regexp_extract_all(message, '#\\d{3,6}')) AS ticket FROM commits) c JOIN kept k ON c.seq = k.seq GROUP BY ticket""",
    sql.COMMITS_SQL,
)
def ticket_rollup(v: Lens) -> DataFrame:
    found = history.tickets(v.commits(), r"#\d{3,6}")
    return found.select("ticket", F.size("commits").cast("long").alias("commits"), F.get("commits", 0).alias("newest"), "date", "message", F.size("files").cast("long").alias("files"), F.get("files", 0).alias("first_file"))


RENAMED = "CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 400 END"


@query(
    """SELECT a.seq, a.path, coalesce(g.new, f.new, a.path) AS now
    FROM asked a ASOF LEFT JOIN (SELECT * FROM renames WHERE old LIKE 'f%') f ON a.path = f.old AND a.seq > f.seq
    ASOF LEFT JOIN (SELECT * FROM renames WHERE old LIKE 'g%') g ON f.new = g.old AND f.seq > g.seq""",
    f"""renames AS (
      SELECT l_orderkey AS seq, 'f' || {RENAMED} AS old, max('g' || (l_suppkey % 50)) AS new FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL
      UNION ALL SELECT l_orderkey, 'g' || (l_suppkey % 50), max('h' || l_linenumber) FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)""",
    f"asked AS (SELECT DISTINCT l_orderkey AS seq, 'f' || {RENAMED} AS path FROM lineitem)",
)
def rename_resolve(v: Lens) -> DataFrame:
    """Every part's file at each order, by renames of all items: a third of them is of one file; a rename may follow another."""
    item = v.t("lineitem")
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    file, group = name("f", F.expr(RENAMED)), name("g", F.col("l_suppkey") % 50)
    early = F.col("l_linenumber") <= 3
    renames = item.select(F.col("l_orderkey").alias("seq"), F.when(early, file).otherwise(group).alias("old"), F.when(early, group).otherwise(name("h", F.col("l_linenumber"))).alias("new"))
    return history.resolve_renames(item.select(F.col("l_orderkey").alias("seq"), file.alias("path")).distinct(), renames)


@query(
    """SELECT path, CASE WHEN lower(left(path, 6)) = 'src/a/' THEN substr(path, 7) ELSE '../../' || path END AS rebased, regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ('.cs', '.json') AS allowed
    FROM (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'Src/a/' WHEN 1 THEN 'src/A/x/' ELSE 'lib/' END || p_brand || CASE p_size % 4 WHEN 0 THEN '.CS' WHEN 1 THEN '.json' WHEN 2 THEN '.md' ELSE '' END AS path FROM part)"""
)
def path_rebase(v: Lens) -> DataFrame:
    size = F.col("p_size")
    folder = F.when(size % 3 == 0, "Src/a/").when(size % 3 == 1, "src/A/x/").otherwise("lib/")
    ending = F.when(size % 4 == 0, ".CS").when(size % 4 == 1, ".json").when(size % 4 == 2, ".md").otherwise("")
    paths = v.t("part").select(F.concat(folder, "p_brand", ending).alias("path")).distinct()
    return paths.select("path", history.rebased(F.col("path"), "src/a").alias("rebased"), history.allowed(F.col("path")).alias("allowed"))


FIND = "(SELECT *, upper(CASE WHEN containing IS NULL THEN name ELSE containing || '.' || name END) AS d, upper(name) AS n, 'NATION_1' AS q FROM symbols)"


@query(
    f"""SELECT id, score FROM (SELECT id, CASE WHEN d = q THEN 100 WHEN n = q THEN 90 WHEN ends_with(d, '.' || q) THEN 80 WHEN contains(d, q) THEN 70 WHEN contains(n, q) THEN 60 END::INT AS score FROM {FIND})
    WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 20""",
    sql.SYMBOLS_SQL,
)
def find_rank(v: Lens) -> DataFrame:
    return search.find(v.symbols(), " Nation_1 ").select("id", "score")


ASKED = "the of order theblah that was"


@query(
    """SELECT doc_id, round_even((1.0::DOUBLE * n / 5.0::DOUBLE + log2(1.0::DOUBLE)) * 100, 0) / 100 AS score FROM (
    SELECT doc_id, len(list_intersect(['the', 'of', 'order', 'that', 'was'], list_distinct([w FOR w IN regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') IF len(w) > 1]))) AS n FROM documents) WHERE n > 0"""
)
def where_rank(v: Lens) -> DataFrame:
    """Free-text hits over documents, scored as names are."""
    tokens = [t for t in text.tokens_of(ASKED) if t != "theblah"]
    docs = v.t("documents").select("doc_id", text.tokens_among(F.col("text"), tokens).alias("met"))
    score = F.lit(search.NAME_WEIGHT) * F.size("met") / F.lit(float(len(tokens)))
    hits = docs.select(F.col("doc_id").alias("id"), score.alias("score"), F.lit("text").alias("reason"), F.lit("").alias("place"))
    return search.combined(hits).select(F.col("id").alias("doc_id"), "score")


@query(
    """SELECT id, array_to_string([w FOR w IN string_split(regexp_replace(regexp_replace(name, '([\\p{Ll}\\p{Nd}])(\\p{Lu})', '\\1|\\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1|\\2', 'g'), '|') IF w <> ''], '|') AS words FROM symbols WHERE kind IN ('Method', 'Constructor')""",
    sql.SYMBOLS_SQL,
)
def identifier_words(v: Lens) -> DataFrame:
    return v.symbols().where("kind in ('Method', 'Constructor')").select("id", F.array_join(text.split_identifier(F.col("name")), "|").alias("words"))


@query(
    """SELECT id, round_even((max(score) + log2(count(*)::DOUBLE)) * 100, 0) / 100 AS score, array_to_string(list(reason ORDER BY n) FILTER (n <= 5), ',') AS reasons, greatest(count(*) - 5, 0)::INT AS more
    FROM (SELECT 'P:' || (l_partkey % 100) AS id, l_discount + 1 AS score, 'o' || l_orderkey || '-' || l_linenumber AS reason,
      row_number() OVER (PARTITION BY l_partkey % 100 ORDER BY l_discount + 1 DESC, lpad(l_orderkey::VARCHAR, 9, '0') || l_linenumber) AS n FROM lineitem) GROUP BY id"""
)
def top_reasons(v: Lens) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    hits = v.t("lineitem").select(
        F.concat(F.lit("P:"), (F.col("l_partkey") % 100).cast("string")).alias("id"), (F.col("l_discount") + 1).alias("score"),
        F.concat(F.lit("o"), key, F.lit("-"), F.col("l_linenumber").cast("string")).alias("reason"), F.concat(F.lpad(key, 9, "0"), F.col("l_linenumber").cast("string")).alias("place"),
    )
    return search.combined(hits).select("id", "score", F.array_join("reasons", ",").alias("reasons"), "more")


def lens_links(v: Lens) -> link.Links:
    return link.link(v.entry_points(), v.frontend_calls())


@query('SELECT fe AS "frontendId", be AS "backendId", kind AS "matchKind" FROM links', *LINK_VIEWS)
def link_kinds(v: Lens) -> DataFrame:
    return lens_links(v).links


@query("SELECT count(*) AS links, count(*) FILTER (kind = 'suffix') AS suffix, count(*) FILTER (kind = 'ambiguous') AS ambiguous FROM links", *LINK_VIEWS)
def link_summary(v: Lens) -> DataFrame:
    return lens_links(v).factored.summary()


@query('SELECT id AS "frontendId", verb AS method, route FROM calls WHERE id NOT IN (SELECT fe FROM links)', *LINK_VIEWS)
def unmatched_calls(v: Lens) -> DataFrame:
    return lens_links(v).unmatched


@query("""SELECT id, verb AS "httpMethod", route FROM entries WHERE type = 'http' AND id NOT IN (SELECT be FROM links)""", *LINK_VIEWS)
def unreferenced_endpoints(v: Lens) -> DataFrame:
    return lens_links(v).unreferenced


class _WhereIndex:
    """What where() needs, from the lens."""

    def __init__(self, v: Lens):
        self.symbols, self.entry_points, self.frontend_calls, self.tickets = v.symbols(), v.entry_points(), v.frontend_calls(), v.tickets()
        self.api_links = lens_links(v).factored


WHERE = "#107 order api orders 000000012 click"
WORDS = "list_distinct([w FOR w IN regexp_extract_all(lower({}), '[\\p{{L}}\\p{{Nd}}]+') IF len(w) > 1])"
SHARE = "len(list_intersect(['107', 'order', 'api', 'orders', '000000012', 'click'], {})) / 6.0::DOUBLE"


WHERE_SQL = (
    """SELECT id, score, reasons, more, e.id IS NOT NULL AS is_entry FROM (
      SELECT id, round_even((max(score) + log2(count(*)::DOUBLE)) * 100, 0) / 100 AS score, array_to_string(list(reason ORDER BY n) FILTER (n <= 5), ',') AS reasons, greatest(count(*) - 5, 0)::INT AS more
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS n FROM hits WHERE score > 0) GROUP BY id) LEFT JOIN entries e USING (id)""",
    sql.SYMBOLS_SQL, sql.ENTRIES_SQL, sql.CALLS_SQL, sql.TICKETS_SQL, LINKS,
    f"""based AS (SELECT *, 3.0::DOUBLE * CASE WHEN ticket = '#107' THEN 1.0::DOUBLE ELSE {SHARE.format("words")} END AS base FROM (SELECT ticket, {WORDS.format("message")} AS words, unnest(files) AS file FROM tickets)),
    shown AS (SELECT id, CASE WHEN containing IS NULL THEN name ELSE containing || '.' || name END AS display FROM symbols),
    hits AS (
      SELECT s.id, base * CASE WHEN len({WORDS.format("s.name")}) > 0 AND list_has_all(words, {WORDS.format("s.name")}) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score, 'ticket ' || ticket AS reason, '1:' || ticket AS place FROM based b JOIN symbols s ON b.file = s.file WHERE base > 0
      UNION ALL SELECT id, 2.0::DOUBLE * {SHARE.format(WORDS.format("route"))}, 'route ' || route, '2:' || route FROM entries WHERE route IS NOT NULL
      UNION ALL SELECT be, 2.0::DOUBLE * {SHARE.format(WORDS.format("feature"))}, 'feature ' || feature, '3:' || fe FROM links JOIN calls ON fe = id
      UNION ALL SELECT id, 1.0::DOUBLE * {SHARE.format(WORDS.format("display"))}, 'name ' || display, '4:' FROM shown)""",
)


@query(*WHERE_SQL)
def where_symbols(v: Lens) -> DataFrame:
    """Every symbol that a free text speaks of, by tickets, routes, features and names."""
    return search.where(_WhereIndex(v), WHERE, limit=None).select("id", "score", F.array_join("reasons", ",").alias("reasons"), "more", "is_entry")


@query(*WHERE_SQL)
def where_indexed(v: Lens) -> DataFrame:
    """The same by a search index, which is written first."""
    index, path = _WhereIndex(v), f"{shared_dir(v.spark)}/postings-{uuid.uuid4().hex}"
    postings.write_postings(index, path)
    return search.where(index, WHERE, None, path).select("id", "score", F.array_join("reasons", ",").alias("reasons"), "more", "is_entry")


@query('SELECT be AS "backendId", fe AS "frontendId", kind AS "matchKind", feature, file, line, confidence FROM links JOIN calls ON fe = id', *LINK_VIEWS)
def screens(v: Lens) -> DataFrame:
    return impact.screens(v.entry_points(), lens_links(v).factored, v.frontend_calls()).drop("route")


@query(
    """SELECT count(*) AS screens, count(DISTINCT feature) AS features, count(*) FILTER (confidence = 'low') AS low_confidence, count(*) FILTER (kind = 'ambiguous') AS ambiguous, count(*) FILTER (kind = 'suffix') AS suffix FROM links JOIN calls ON fe = id""",
    *LINK_VIEWS,
)
def screen_quality(v: Lens) -> DataFrame:
    return impact.factored_quality(v.entry_points(), lens_links(v).factored, v.frontend_calls())


@query(
    """SELECT be AS "backendId", array_to_string(list(feature ORDER BY s), ',') AS features FROM (SELECT be, feature, min(seq) AS s FROM links JOIN calls ON fe = id GROUP BY be, feature) GROUP BY be""",
    *LINK_VIEWS,
)
def features_by_endpoint(v: Lens) -> DataFrame:
    return project_map.features_by_endpoint(lens_links(v).factored, v.frontend_calls()).select("backendId", F.array_join("features", ",").alias("features"))


@query(
    """SELECT o_orderkey AS seq, coalesce(CASE WHEN o_orderstatus = 'P' THEN '' ELSE array_to_string(i.injectors, ',') END, '') AS injectors
    FROM orders LEFT JOIN (SELECT service, list(injector ORDER BY s, injector::VARCHAR) AS injectors FROM (SELECT l_partkey % 50 AS service, l_suppkey % 20 AS injector, min(l_orderkey * 8 + l_linenumber) AS s FROM lineitem GROUP BY ALL) GROUP BY service) i
    ON o_custkey % 60 = i.service"""
)
def injected_by(v: Lens) -> DataFrame:
    calls = v.t("orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 60).alias("service"), (F.col("o_orderstatus") == "P").alias("is_component"))
    injections = v.t("lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("seq"), (F.col("l_suppkey") % 20).cast("string").alias("injector"), F.array(F.col("l_partkey") % 50).alias("types"))
    return scan_passes.injected_by(calls, injections).select("seq", F.array_join("injectedBy", ",").alias("injectors"))


@query(
    """SELECT DISTINCT u.start AS "className", 'm' || (p_partkey % 13) AS member FROM up u JOIN part ON 'P' || p_partkey = u.node WHERE p_size > 40""",
    """up AS (SELECT 'P' || p_partkey AS start, p_partkey AS k, 'P' || p_partkey AS node FROM part UNION SELECT start, k // 2, 'P' || (k // 2) FROM up WHERE k > 1)""",
)
def client_members(v: Lens) -> DataFrame:
    key = F.col("p_partkey")
    classes = v.t("part").select(
        key.alias("seq"), F.concat(F.lit("P"), key.cast("string")).alias("className"), F.when(key > 1, F.concat(F.lit("P"), F.floor(key / 2).cast("string"))).alias("baseName"),
        F.when(F.col("p_size") > 40, F.array(F.concat(F.lit("m"), (key % 13).cast("string")))).otherwise(F.array().cast("array<string>")).alias("clientMembers"),
    )
    return scan_passes.client_members(classes)


DEPENDENCIES = "deps AS (SELECT DISTINCT a.project AS from_project, b.project AS to_project FROM edges JOIN symbols a ON src = a.id JOIN symbols b ON dst = b.id WHERE a.project <> b.project)"


@query("SELECT * FROM deps", sql.SYMBOLS_SQL, sql.EDGES_SQL, DEPENDENCIES)
def project_dependencies(v: Lens) -> DataFrame:
    return project_map.project_dependencies(v.edges(), v.symbols())


@query(
    "SELECT s.project, coalesce(l.layer, 0)::INT AS layer, s.symbols FROM (SELECT project, count(*) AS symbols FROM symbols GROUP BY project) s LEFT JOIN (SELECT project, max(n) AS layer FROM chain GROUP BY project) l USING (project)",
    sql.SYMBOLS_SQL, sql.EDGES_SQL, DEPENDENCIES,
    "chain AS (SELECT project, 0 AS n FROM symbols UNION SELECT d.from_project, c.n + 1 FROM chain c JOIN deps d ON d.to_project = c.project)",
)
def project_layers(v: Lens) -> DataFrame:
    return project_map.project_layers(v.edges(), v.symbols())


@query('SELECT dst AS "to", count(*) AS edges FROM edges GROUP BY dst ORDER BY edges DESC, dst LIMIT 20', sql.EDGES_SQL)
def hub_top20(v: Lens) -> DataFrame:
    return project_map.hubs(v.edges())


@query("SELECT p_type AS name, count(*) AS n, arg_min(p_brand, p_partkey) AS file, arg_min(p_size, p_partkey) AS line FROM part GROUP BY p_type")
def unresolved_groups(v: Lens) -> DataFrame:
    return project_map.unresolved_bases(v.t("part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line")))


@query(
    """SELECT id, project, n, in_project, greatest(in_project - 30, 0) AS not_shown FROM (SELECT e.id, c.c_mktsegment AS project, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY e.seq)::INT AS n, count(*) OVER (PARTITION BY c.c_mktsegment) AS in_project
    FROM entries e JOIN orders o ON e.id = 'O:' || o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey) WHERE n <= 30""",
    sql.ENTRIES_SQL,
)
def capped_entry_points(v: Lens) -> DataFrame:
    orders = v.t("orders").join(v.t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    symbols = orders.select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("project"), F.col("o_orderkey").alias("seq"))
    return project_map.entry_points_by_project(v.entry_points(), symbols).select("id", "project", "n", "in_project", "not_shown")


@query(
    """SELECT file FROM (SELECT 'f' || (l_partkey % 900) AS file FROM lineitem UNION SELECT 'f' || (l_suppkey % 900) FROM lineitem) WHERE file IN (SELECT 'f' || (p_size % 900) FROM part)"""
)
def changed_files(v: Lens) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 900).cast("string")).alias("file")
    item = v.t("lineitem")
    return status.changed_files(item.select(name("l_partkey")), item.select(name("l_suppkey")), v.t("part").select(name("p_size")))


AUDIT = """sites AS (SELECT e.src, e.file, e.line, e.dst, s.containing, s.containing IN (SELECT substr(impl, 3) FROM di) AS bound FROM edges e JOIN symbols s ON e.dst = s.id WHERE e.kind = 'call' AND e.via = 'interface'),
verdicts AS (SELECT src, dst, file, line, CASE WHEN bound THEN 'match' WHEN bool_or(bound) OVER (PARTITION BY src, file) THEN 'excess' ELSE 'unknown' END AS verdict FROM sites)"""


def audited(v: Lens) -> DataFrame:
    """Interface edges of one order are siblings, so that a site has several candidates."""
    types = v.symbols().select(F.col("id").alias("to"), F.col("containingType").alias("containing"))
    sites = v.edges().where("kind = 'call' and via = 'interface'").join(types, "to").withColumnRenamed("line", "place").withColumn("line", F.lit(0))
    return scan_passes.audit(sites, v.di())


@query('SELECT src AS "from", dst AS "to", file, line, verdict FROM verdicts', sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.DI_SQL, AUDIT)
def interface_audit(v: Lens) -> DataFrame:
    return audited(v).select("from", "to", "file", F.col("place").alias("line"), "verdict")


@query(
    """SELECT m AS "match", x AS excess, u AS unknown, round_even(x::DOUBLE / (m + x) * 1000, 0) / 10 AS false_positive_percent FROM (
    SELECT count(*) FILTER (verdict = 'match') AS m, count(*) FILTER (verdict = 'excess') AS x, count(*) FILTER (verdict = 'unknown') AS u FROM verdicts)""",
    sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.DI_SQL, AUDIT,
)
def interface_audit_rate(v: Lens) -> DataFrame:
    return scan_passes.audit_rate(audited(v))


@query(
    """SELECT count(*) AS tickets, count(*) FILTER (p) AS pr_like, count(*) >= 5 AND count(*) FILTER (p) * 2 > count(*) AS warn
    FROM (SELECT o_orderkey % 3 <> 0 AS p FROM orders)"""
)
def pr_like_ratio(v: Lens) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    found = v.t("orders").select(key.alias("ticket"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("x (#"), key, F.lit(")"))).otherwise(F.concat(F.lit("Merge Pull request #"), key)).alias("message"))
    return history.looks_like_pull_requests(found)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'api/' || lower(p_brand) || '/{*}/{*}' ELSE lower(p_brand) || '/{*}' END AS route, p_size % 2 = 1 AND p_size % 3 <> 0 AS dropped FROM part""")
def frontend_routes(v: Lens) -> DataFrame:
    size = F.col("p_size")
    plain = F.concat(F.lit("`/api/"), "p_brand", F.lit("/${a.b({c: 1})}/` + id"))
    based = F.concat(F.lit("base + '/"), "p_brand", F.lit("/{{ id }}?x=1'"))
    found = v.t("part").select("p_partkey", size, routes.frontend_url(F.when(size % 3 == 0, F.lit("'orders'")).when(size % 2 == 0, plain).otherwise(based)).alias("u"))
    return found.select("p_partkey", "u.route", F.col("u.dropped").alias("dropped"))


@query("""SELECT "table", rows FROM (SELECT 'symbols' AS "table", count(*) AS rows FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'entry_points', count(*) FROM entries)""", sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.ENTRIES_SQL)
def index_contents(v: Lens) -> DataFrame:
    return status.contents(symbols=v.symbols(), edges=v.edges(), entry_points=v.entry_points())


@query(
    """SELECT id, regexp_replace(route, '\\{[^}]*\\}', '{*}', 'g') AS key FROM entries WHERE route IS NOT NULL
    UNION SELECT id, regexp_replace(regexp_replace(route, '/\\{id\\?\\}$', ''), '\\{[^}]*\\}', '{*}', 'g') FROM entries WHERE route IS NOT NULL""",
    sql.ENTRIES_SQL,
)
def route_keys(v: Lens) -> DataFrame:
    found = v.entry_points().where("route is not null")
    return found.select("id", F.explode(routes.route_keys(F.concat(F.lit("/"), F.upper("route"), F.lit("/")), F.col("routeInferred"))).alias("key"))


@query("SELECT DISTINCT file, feature FROM calls", sql.CALLS_SQL)
def features_of_paths(v: Lens) -> DataFrame:
    return v.frontend_calls().select("file", routes.feature(F.col("file"), "src/app").alias("feature")).distinct()


@query("""SELECT o_orderkey, o_orderkey % 4 <> 0 AS confirmed_any FROM orders WHERE o_orderkey % 4 <> 0""")
def semi_confirmed(v: Lens) -> DataFrame:
    """Nodes that reach a group over allowed edges: each order leads to its key's class, but for one class."""
    edges = v.t("orders").select(F.col("o_orderkey").cast("string").alias("from"), F.lit("root").alias("to"), (F.col("o_orderkey") % 4 != 0).alias("ok"))
    seen = graph.propagate(edges, v.spark.createDataFrame([("root",)], "id string"), F.col("ok")).where("id <> 'root'")
    return seen.select(F.col("id").cast("long").alias("o_orderkey"), F.lit(True).alias("confirmed_any"))


@query("""SELECT CASE WHEN containing IS NULL THEN name ELSE containing || '.' || name END AS display, substr(id, 3) AS bare, id,
    CASE kind WHEN 'Method' THEN 0 WHEN 'Class' THEN 1 WHEN 'Interface' THEN 1 WHEN 'Constructor' THEN 2 WHEN 'Property' THEN 3 WHEN 'Field' THEN 4 ELSE 5 END AS rank, project = 'BUILDING.Tests' AS is_test FROM symbols""", sql.SYMBOLS_SQL)
def symbol_names(v: Lens) -> DataFrame:
    s = v.symbols()
    return s.select(text.display_name(F.col("name"), F.col("containingType"), F.col("id")).alias("display"), text.strip_prefix(F.col("id")).alias("bare"), "id", text.kind_rank(F.col("kind")).alias("rank"), text.is_test_project(F.col("project")).alias("is_test"))


@query("""SELECT id, kind, name, file, line::INT AS line FROM symbols WHERE project = 'World' AND kind IN ('Class', 'Interface', 'Struct', 'Enum', 'Record')""", sql.SYMBOLS_SQL)
def module_page(v: Lens) -> DataFrame:
    return project_map.module_page(v.symbols(), "World")


@query("""SELECT ticket, date, len(files) AS files FROM (SELECT '#' || (o_custkey + 100) AS ticket, max(strftime(o_orderdate, '%Y-%m-%d')) AS date, list(DISTINCT 'f' || (o_orderkey % 9)) AS files FROM orders GROUP BY o_custkey) WHERE list_contains(files, 'f3')""")
def tickets_by_file(v: Lens) -> DataFrame:
    found = v.t("orders").groupBy("o_custkey").agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.collect_set(F.concat(F.lit("f"), (F.col("o_orderkey") % 9).cast("string"))).alias("files"))
    found = found.select(F.concat(F.lit("#"), (F.col("o_custkey") + 100).cast("string")).alias("ticket"), "date", "files")
    return impact.tickets_of(found, "f3").select("ticket", "date", F.size("files").cast("long").alias("files"))


@query(
    """SELECT "fileA", "fileB", together FROM (SELECT x.file AS "fileA", y.file AS "fileB", count(*)::INT AS together FROM kept x JOIN kept y ON x.seq = y.seq AND x.file < y.file GROUP BY ALL HAVING count(*) >= 3) WHERE "fileA" = 'p/f7.cs' OR "fileB" = 'p/f7.cs'""",
    sql.COMMITS_SQL,
)
def co_changed_with(v: Lens) -> DataFrame:
    return impact.co_changed(history.co_change(v.commits()), "p/f7.cs").select("fileA", "fileB", "together")


@query(
    f"""SELECT reason, n FROM (
      SELECT 'unconfirmed_interface_edges' AS reason, count(*) FILTER (via = 'interface' AND NOT confirmed) AS n FROM used UNION ALL SELECT 'override_edges', count(*) FILTER (via = 'override') FROM used
      UNION ALL SELECT 'interface_edges', count(*) FILTER (via = 'interface') FROM used UNION ALL SELECT 'mediator_edges', count(*) FILTER (via = 'mediatr') FROM used UNION ALL SELECT 'delegate_edges', count(*) FILTER (via = 'delegate') FROM used
      UNION ALL SELECT 'inferred_routes', {INFERRED} FROM bucketed b UNION ALL SELECT 'unknown_symbol', (count(*) = 0)::BIGINT FROM symbols WHERE id = '{ROOT}'
      UNION ALL SELECT 'low_confidence_screens', count(*) FILTER (confidence = 'low') FROM links JOIN calls ON fe = id UNION ALL SELECT 'ambiguous_screens', count(*) FILTER (kind = 'ambiguous') FROM links UNION ALL SELECT 'suffix_screens', count(*) FILTER (kind = 'suffix') FROM links
      UNION ALL SELECT 'degraded_projects', count(DISTINCT project) FROM bucketed WHERE project IN (SELECT n_name FROM nation WHERE n_nationkey < 9)) WHERE n > 0""",
    sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.ENTRIES_SQL, sql.CALLS_SQL, sql.DI_SQL, REACH, BUCKETS, CONFIRMED, LINKS,
)
def blind_spots(v: Lens) -> DataFrame:
    reached, used = confirmed_used(v)
    nodes = impact.buckets(reached, v.symbols(), v.entry_points())
    routes = nodes.agg(F.count_if(impact.inferred_route()).alias("inferred_routes"))
    counts = used.agg(*impact.edge_counts(), F.lit(0).alias("inferred_only")).crossJoin(F.broadcast(routes))  # one row each
    degraded = v.t("nation").where("n_nationkey < 9").select(F.col("n_name").alias("project"))
    return impact.blind_spots(counts, degraded, screen_quality(v), nodes, known=v.symbols().where(F.col("id") == ROOT))


@query(
    """SELECT id, depth, display FROM bucketed WHERE bucket <> 'test' ORDER BY bucket <> 'entry', depth, project, display LIMIT 1""",
    sql.SYMBOLS_SQL, sql.EDGES_SQL, sql.ENTRIES_SQL, REACH, BUCKETS,
)
def nearest_path(v: Lens) -> DataFrame:
    reached = graph.reach_depths(v.kept_edges(), root(v), DEPTH)
    return impact.nearest_path(impact.buckets(reached, v.symbols(), v.entry_points())).select("id", "depth", "display")


@query("SELECT l_suppkey, min_by(l_linenumber, (abs(l_linenumber - 3), l_linenumber))::INT AS line FROM lineitem GROUP BY l_suppkey")
def nearest_declaration(v: Lens) -> DataFrame:
    found = v.t("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("line"))
    return impact.nearest_declaration(found, 3).select(F.col("id").alias("l_suppkey"), F.col("line").cast("int").alias("line"))


@query(
    """SELECT 'P:' || l_partkey AS id, l_orderkey AS "order", l_suppkey AS supplier FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem) WHERE n = 1"""
)
def first_rows(v: Lens) -> DataFrame:
    """The first item of each part, in source order."""
    item = v.t("lineitem").select(F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("supplier"), F.expr("l_orderkey * 8 + l_linenumber").alias("seq"))
    return impact.first_rows(item).drop("seq")


@query("SELECT s_suppkey AS id, s_nationkey AS nation, count(*) OVER (PARTITION BY s_nationkey) AS in_group FROM supplier")
def group_sizes(v: Lens) -> DataFrame:
    """Suppliers with the number of those of their nation."""
    rows = v.t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return impact.by_group_size(rows, "nation", ("id",)).select("id", "nation", "in_group")


@query(
    """SELECT doc_id, array_to_string(l[1:3], chr(10)) AS head, greatest(len(l) - 3, 0)::INT AS more FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
)
def snippets(v: Lens) -> DataFrame:
    """The first three lines of each text, and how many follow."""
    return v.t("documents").select("doc_id", impact.snippet(F.col("text"), 3).alias("x")).select("doc_id", F.col("x.text").alias("head"), F.col("x.more").alias("more"))


@query(
    """SELECT id, CASE WHEN starts_with(t, '/') OR starts_with(t, '~/') THEN trim(ltrim(t, '~'), '/') ELSE concat_ws('/', nullif(trim(p, '/'), ''), nullif(trim(t, '/'), '')) END AS route
    FROM (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '/api/' || p_brand || '/' WHEN 1 THEN 'api/' || p_brand WHEN 2 THEN '/' ELSE '' END AS p,
      CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/' || p_type WHEN 2 THEN '~/' || p_type || '/' WHEN 3 THEN p_type || '/' ELSE p_type END AS t FROM part)"""
)
def composed_routes(v: Lens) -> DataFrame:
    """Routes put together from a type's and a member's."""
    size, key, brand, kind = F.col("p_size") % 4, F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_type")
    prefix = F.when(size == 0, F.concat(F.lit("/api/"), brand, F.lit("/"))).when(size == 1, F.concat(F.lit("api/"), brand)).when(size == 2, "/").otherwise("")
    own = F.when(key == 0, "").when(key == 1, F.concat(F.lit("/"), kind)).when(key == 2, F.concat(F.lit("~/"), kind, F.lit("/"))).when(key == 3, F.concat(kind, F.lit("/"))).otherwise(kind)
    return v.t("part").select(F.col("p_partkey").alias("id"), routes.composed_route(prefix, own).alias("route"))


@query(
    """SELECT id, replace(replace(replace(replace(r, '[controller]', c), '[Action]', a), '[area]', ''), '[CONTROLLER]', c) AS route FROM (
    SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'api/[controller]/[Action]' WHEN 1 THEN '[area]/[CONTROLLER]' ELSE 'fixed' END AS r,
      replace(p_brand, '#', '$') AS c, CASE WHEN p_partkey % 4 = 0 THEN 'Get' || p_size WHEN p_partkey % 4 = 1 THEN 'Async' ELSE 'Find' END AS a FROM part)"""
)
def filled_routes(v: Lens) -> DataFrame:
    """Routes whose tokens are replaced by the names of a controller and an action."""
    size, key = F.col("p_size") % 3, F.col("p_partkey") % 4
    route = F.when(size == 0, "api/[controller]/[Action]").when(size == 1, "[area]/[CONTROLLER]").otherwise("fixed")
    action = F.when(key == 0, F.concat(F.lit("Get"), F.col("p_size").cast("string"))).when(key == 1, "Async").otherwise("FindAsync")
    controller = F.concat(F.translate("p_brand", "#", "$"), F.lit("Controller"))
    return v.t("part").select(F.col("p_partkey").alias("id"), routes.filled_route(route, controller, action, F.lit(None).cast("string")).alias("route"))


@query(
    """SELECT id, CASE WHEN starts_with(m, 'get') THEN 'GET' WHEN starts_with(m, 'put') THEN 'PUT' WHEN starts_with(m, 'delete') THEN 'DELETE' ELSE 'POST' END AS verb
    FROM (SELECT l_orderkey * 8 + l_linenumber AS id, lower(CASE l_partkey % 5 WHEN 0 THEN 'Get' WHEN 1 THEN 'PUT' WHEN 2 THEN 'delete' WHEN 3 THEN 'Posted' ELSE 'Make' END || l_returnflag) AS m FROM lineitem)"""
)
def verbs_by_name(v: Lens) -> DataFrame:
    """The verbs that methods' names begin with."""
    kind = F.col("l_partkey") % 5
    name = F.concat(F.when(kind == 0, "Get").when(kind == 1, "PUT").when(kind == 2, "delete").when(kind == 3, "Posted").otherwise("Make"), "l_returnflag")
    return v.t("lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("id"), routes.verb_by_name(name).alias("verb"))


@query(
    r"""SELECT id, p = 'src/app' OR starts_with(p, 'src/app/') AS inside FROM (SELECT p_partkey AS id, rtrim(lower(replace(CASE p_partkey % 4 WHEN 0 THEN 'SRC\App\' || p_brand WHEN 1 THEN 'src/application/' || p_brand WHEN 2 THEN 'src/app/' ELSE p_brand END, '\', '/')), '/') AS p FROM part)"""
)
def inside_folder(v: Lens) -> DataFrame:
    """Whether paths are in a folder, in any case and with either slash."""
    kind, brand = F.col("p_partkey") % 4, F.col("p_brand")
    path = F.when(kind == 0, F.concat(F.lit("SRC\\App\\"), brand)).when(kind == 1, F.concat(F.lit("src/application/"), brand)).when(kind == 2, "src/app/").otherwise(brand)
    return v.t("part").select(F.col("p_partkey").alias("id"), routes.is_inside(path, "src/app").alias("inside"))


@query(
    """SELECT DISTINCT file FROM (SELECT 'f' || (l_partkey % 5000) AS file FROM lineitem UNION ALL SELECT 'f' || (o_custkey * 3) FROM orders) WHERE file IN (SELECT 'f' || p_partkey FROM part)"""
)
def changed_files(v: Lens) -> DataFrame:
    """Files that items or orders name, of those that are parts."""
    file = lambda df, k: df.select(F.concat(F.lit("f"), k.cast("string")).alias("file"))
    return status.changed_files(file(v.t("lineitem"), F.col("l_partkey") % 5000), file(v.t("orders"), F.col("o_custkey") * 3), file(v.t("part"), F.col("p_partkey")))


@query(
    """SELECT count(*) AS tickets, count(*) FILTER (hit) AS pr_like, count(*) >= 5 AND count(*) FILTER (hit) * 2 > count(*) AS warn FROM (
    SELECT contains(message, '(#' || k || ')') OR contains(lower(message), 'pull request #' || k) AS hit FROM (
      SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'fix (#' || o_orderkey || ')' WHEN 1 THEN 'Merge Pull Request #' || o_orderkey ELSE 'fix #' || o_orderkey END AS message FROM orders))"""
)
def pull_request_like(v: Lens) -> DataFrame:
    """Whether most tickets are numbers of pull requests by their messages."""
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    message = F.when(kind == 0, F.concat(F.lit("fix (#"), key, F.lit(")"))).when(kind == 1, F.concat(F.lit("Merge Pull Request #"), key)).otherwise(F.concat(F.lit("fix #"), key))
    return history.looks_like_pull_requests(v.t("orders").select(F.concat(F.lit("#"), key).alias("ticket"), message.alias("message")))
