"""Passes that complete a scan's raw facts: expansions of edges, binding maps and their diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_prefix
from tessera.lineage import cut
from tessera.operators.graph import closure, inherited

EDGE = ["from", "to", "kind", "file", "line", "via"]
#: Column of the order in which a pass emits its edges: the place of the call, then that of what it expands to.
PLACE = "at"
#: Tasks for each core that calls are dealt to before they are expanded.
WAVES = 8
#: Calls of a target that are expanded together, and members, roughly; edges of a task, roughly; tasks at most.
CALLS_TOGETHER, MEMBERS_TOGETHER, EDGES_OF_TASK, TASKS = 1 << 10, 1 << 12, 1 << 24, 10_000
#: Members that follow each call: as many numbers as Parquet packs in one run of bits, so that the runs of a cycle are the same bytes.
CYCLE = 63 * 8


def placed(df: DataFrame, ordered: bool, *by: str) -> DataFrame:
    """Edges, with their place if they are to be ordered; a part without a seq of its own comes in the order of names."""
    if not ordered:
        return df.select(*EDGE)
    key = [F.col(c).cast("long") if c in df.columns else F.lit(0).cast("long") for c in by]
    return df.select(*EDGE, F.array(*key).alias(PLACE))


def crossed(calls: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """A row for each call and each of its target's members; both are read several times, so they should be written.

    Calls of a target are dealt to tasks in parts, as each brings many edges and the targets may be few. They meet the members
    by CYCLE at a time, and rows come by cycle, then by call: runs of one call over a short cycle of members, which a columnar
    file keeps small. With all of a target's members after each call, the cycles are longer than what a file's compression
    looks back on, and a member's number is kept for each row, or its name. No edge is shuffled.
    """
    own, of_call = [c for c in members.columns if c != on], [c for c in calls.columns if c != on]
    sizes = cut(calls.groupBy(on).agg(F.count("*").alias("calls")).join(members.groupBy(on).agg(F.count("*").alias("members")), on), "sizes")
    edges = F.col("calls") * F.col("members").cast("double")
    whole = sizes.agg(F.sum(edges)).first()[0] or 0.0
    tasks = min(max(calls.sparkSession.sparkContext.defaultParallelism * WAVES, math.ceil(whole / EDGES_OF_TASK)), TASKS)
    parts = F.least("calls", F.greatest(F.ceil(F.col("calls") / CALLS_TOGETHER), F.ceil(edges / (max(whole, 1.0) / tasks)))).alias("_parts")
    blocks = members.join(sizes.select(on, F.ceil(F.col("members") / MEMBERS_TOGETHER).alias("_blocks")), on).withColumn("_block", F.pmod(F.xxhash64(*own), F.col("_blocks")))
    blocks = blocks.groupBy(on, "_block").agg(F.collect_list(F.struct(*own)).alias("_members"))
    starts = F.sequence(F.lit(1), F.size("_members"), F.lit(CYCLE))
    cycles = blocks.select(on, F.explode(F.transform(starts, lambda i: F.slice("_members", i, F.lit(CYCLE)))).alias("_members"))
    asked = cycles.join(sizes.select(on, parts), on).select(on, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "_members")
    callers = calls.join(sizes.select(on, parts), on).select(on, F.pmod(F.xxhash64(*of_call), F.col("_parts")).alias("_part"), *of_call)
    # merged, as a join by hashes would give the calls' own order
    met = asked.repartition(tasks, on, "_part").hint("merge").join(callers.repartition(tasks, on, "_part"), [on, "_part"])
    return met.select(on, *of_call, F.inline("_members"))


def expand(calls: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """A row for each call and each of its target's pairs."""
    pairs = cut(pairs, "members")
    return crossed(cut(calls.join(pairs.select(on).distinct(), on, "left_semi"), "sites"), pairs, on)


def interface_edges(edges: DataFrame, members: DataFrame, ordered: bool = False) -> DataFrame:
    """A call edge to every implementation of a called interface member; members: iface_member, impl_member, and member_seq where order matters."""
    own = ["member_seq"] if "member_seq" in members.columns else []
    pairs = members.select(F.col("iface_member").alias("to"), "impl_member", *own).where("to <> impl_member")
    pairs = pairs.groupBy("to", "impl_member").agg(F.min("member_seq").alias("member_seq")) if own else pairs.distinct()
    met = expand(edges.where("kind = 'call'").drop("via", *own), pairs, "to").drop("to")
    return placed(met.withColumnRenamed("impl_member", "to").withColumn("via", F.lit("interface")), ordered, "seq", "member_seq")


def mediator_edges(sends: DataFrame, handlers: DataFrame, ordered: bool = False) -> DataFrame:
    """An edge from where a request is sent to each of its handlers; sends: from, request, file, line; handlers: request, handler; both seq where order matters."""
    own = ["handler_seq"] if "seq" in handlers.columns else []
    pairs = handlers.groupBy("request", "handler").agg(F.min("seq").alias("handler_seq")) if own else handlers.select("request", "handler").distinct()
    met = expand(sends, pairs, "request").withColumnRenamed("handler", "to").withColumn("kind", F.lit("call")).withColumn("via", F.lit("mediatr"))
    return placed(met, ordered, "seq", "handler_seq")


def override_edges(calls: DataFrame, overrides: DataFrame, ordered: bool = False) -> DataFrame:
    """An edge from each virtual call to every override below its target that the receiver's type allows.

    calls: from, to, file, line, receiver, and seq where order matters; overrides: overridden, override, types. The
    closure is taken once over the distinct targets, and goes on through overrides that the receiver rejects. An edge
    that several calls bring has the place of the first. Without order, only calls of one place with several targets or
    receivers can bring the same edge twice; all others are expanded without a comparison of their edges.
    """
    if not ordered:
        from tessera.operators.factored import Factored, override_calls

        found = override_calls(calls, overrides)
        return Factored(found.plain, cut(found.sites, "sites"), found.members).edges()
    below = closure(overrides, calls, "overridden", "override", "to").withColumnsRenamed({"start": "to", "node": "override"})
    types = overrides.groupBy("override").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    met = calls.join(below, "to").join(types, "override").where(F.array_contains("types", F.col("receiver")))
    met = met.drop("to").withColumnRenamed("override", "to").withColumn("kind", F.lit("call")).withColumn("via", F.lit("override"))
    return placed(met, True, "seq").groupBy(*EDGE).agg(F.min(PLACE).alias(PLACE))


def complete_edges(edges: DataFrame, *more: DataFrame) -> DataFrame:
    """All edges in the order of the passes, numbered by pass and seq: the raw ones keep their seq, each pass follows in the order of its places, then of names.

    Rows of the passes are sorted over ranges and numbered as they come, so that no task sorts them all; the numbers
    are written, and stay in this order whatever reads the table.
    """
    if not more:
        return edges.select(*EDGE, F.lit(0).alias("pass"), F.col("seq").cast("long").alias("seq"))
    none = F.array().cast("array<bigint>")
    rows = None
    for i, m in enumerate(more, 1):
        one = m.select(*EDGE, F.lit(i).alias("pass"), (F.col(PLACE) if PLACE in m.columns else none).alias(PLACE))
        rows = one if rows is None else rows.unionByName(one)
    by = ["pass", PLACE, *EDGE]
    numbered = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()).drop(PLACE), "edges")
    return edges.select(*EDGE, F.lit(0).alias("pass"), F.col("seq").cast("long").alias("seq")).unionByName(numbered)


def implicit_constructors(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """The implicit constructors that some edge calls."""
    return candidates.join(edges.select(F.col("to").alias("id")), "id", "left_semi")


def di_map(*evidence: DataFrame) -> DataFrame:
    """(service, impls): the distinct implementations of each service, sorted, from all evidence (service, impl)."""
    rows = evidence[0].select("service", "impl")
    for e in evidence[1:]:
        rows = rows.union(e.select("service", "impl"))
    return rows.distinct().groupBy("service").agg(F.array_sort(F.collect_list("impl")).alias("impls"))


def di_conflicts(attributes: DataFrame, fluent: DataFrame) -> DataFrame:
    """(impl, attribute_service, fluent_services): implementations bound otherwise by attribute than by registration.

    attributes: seq, service, impl; the first binding of an implementation counts, and not to itself.
    """
    first = attributes.where("service <> impl").withColumn("n", F.row_number().over(Window.partitionBy("impl").orderBy("seq"))).where("n = 1").select("impl", F.col("service").alias("attribute_service"))
    others = fluent.select("impl", "service").distinct().groupBy("impl").agg(F.array_sort(F.collect_list("service")).alias("fluent_services"))
    return first.join(others, "impl").where(~F.array_contains("fluent_services", F.col("attribute_service")))


def ambiguous_types(ambiguous: DataFrame, manual: DataFrame) -> DataFrame:
    """Ambiguous implementations that no manual binding settles."""
    return ambiguous.join(manual.select("impl"), "impl", "left_anti")


def duplicate_ids(symbols: DataFrame) -> DataFrame:
    """(id, projects, files) of ids that more than one project declares, in order of first appearance."""
    seen = symbols.groupBy("id", "project").agg(F.min("seq").alias("seq"), F.min_by("file", "seq").alias("file"))
    out = seen.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "project", "file"))).alias("x")).where("n > 1")
    return out.select("id", F.transform("x", lambda a: a.project).alias("projects"), F.array_distinct(F.transform("x", lambda a: a.file)).alias("files"))


def injected_by(calls: DataFrame, injections: DataFrame) -> DataFrame:
    """calls (seq, file, line, service, is_component) with the classes that inject their service, in order of first appearance.

    injections: seq, injector, types. A component's own calls have no injectors.
    """
    pairs = injections.select("seq", "injector", F.explode("types").alias("service")).groupBy("service", "injector").agg(F.min("seq").alias("seq"))
    lists = pairs.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "injector"))), lambda x: x.injector).alias("injectors"))
    none = F.array().cast("array<string>")
    return calls.join(lists, "service", "left").withColumn("injectedBy", F.when(F.col("is_component"), none).otherwise(F.coalesce("injectors", none))).drop("injectors")


def client_members(classes: DataFrame) -> DataFrame:
    """(className, member): HTTP client members of each class, its own or those of the classes it extends.

    classes: seq, className, baseName, clientMembers; the first description of a class counts; cycles end by themselves.
    """
    described = [c for c in classes.columns if c not in ("className", "seq")]
    one = cut(classes.groupBy("className").agg(F.min_by(F.struct(*described), "seq").alias("x")).select("className", "x.*"), "classes")
    own = one.select("className", F.explode("clientMembers").alias("member"))
    return inherited(one.select("className", "baseName"), own, "className", "baseName", "member")


def audit(sites: DataFrame, bound: DataFrame) -> DataFrame:
    """Interface edges with a verdict: 'match' if bound, 'excess' if only a sibling at the site is, else 'unknown'."""
    known = bound.select(strip_prefix(F.col("impl")).alias("containing")).distinct().withColumn("is_bound", F.lit(True))
    marked = sites.join(known, "containing", "left").withColumn("is_bound", F.coalesce("is_bound", F.lit(False)))
    any_bound = F.bool_or("is_bound").over(Window.partitionBy("from", "file", "line"))
    return marked.withColumn("verdict", F.when(F.col("is_bound"), "match").when(any_bound, "excess").otherwise("unknown"))


def audit_rate(verdicts: DataFrame) -> DataFrame:
    """One row: verdict counts and the share of excess among what is known, in per cent with one digit."""
    n = verdicts.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("match", "excess", "unknown")))
    share = F.when(F.col("match") + F.col("excess") > 0, F.rint(F.col("excess").cast("double") / (F.col("match") + F.col("excess")) * 1000) / 10)
    return n.withColumn("false_positive_percent", share)
