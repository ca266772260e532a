"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put into blocks. Block j (from 0) of a source whose share of the live weights is p may run
from slot floor(j / p) on and must have run by slot ceil((j + 1) / p); of the blocks released, the one with the
earliest deadline runs. Releases and deadlines are exact, by integers, whatever the weights: at every slot each
source deviates from its share by less than one block.

The schedule is made by tasks, in windows of slots. At a window's edge t every source has run the whole part of t * p
blocks, or one more, by largest remainders, so a window needs nothing of the one before: a schedule through such
edges exists (in any interval the blocks that must run there are at most its slots), and earliest-deadline-first finds
it. Windows are long enough for every source to move on in each.

A source that is used up leaves; from then on the others keep their weights among themselves (a new phase, counted
from its own start), so no document is dropped or repeated. Ranks within a source come from counts of hash ranges, so
neither a source with a third of all rows nor the whole table is ever sorted in one task; a range's slots reach its
documents as one short array.

Sizes: the sources' counts and phases are held by the driver and sent to all tasks: MAX_SOURCES sources at most (more
is an error), so MAX_SOURCES ** 2 / 2 numbers. A source with less than 1 / MAX_WINDOW of the live weights is an error
too. Both follow the sources, not the rows.

Defined cases: rows without a source form a source of their own; weights may be given for sources that don't occur;
sources without a weight have weight 1 (equal shares by default); weights of 0 or less put a source after all
others; rows that repeat an id get places of their own; texts don't matter; an empty table gives an empty table;
other columns pass through, and input columns named like the output's or like a column of the method (`__source`,
`__hash`, `__range`, `__order`, `__row`, `__slots`, `__before`) are replaced or dropped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions

#: Documents in a block; rows of a source that are ranked together, roughly.
BLOCK_DOCS, RANKED_TOGETHER, SEED = 16, 4_000, 7
#: Sources at most; slots of a window at least and at most; slots that a task sends on together.
MAX_SOURCES, MIN_WINDOW, MAX_WINDOW, SENT_TOGETHER = 1_000, 4_096, 10_000_000, 50_000
#: The name of the source of rows without one.
NO_SOURCE = "\x00"
#: Columns of the method.
OWN = ["__source", "__hash", "__range", "__order", "__row", "__slots", "__before"]


@dataclass
class Phase:
    """The time in which the same sources live: share of names[i] is parts[i] / whole; before: blocks that each has run."""

    first: int
    slots: int
    names: list[str]
    parts: list[int]
    before: list[int]
    after: list[int]

    @property
    def whole(self) -> int:
        return sum(self.parts)

    @property
    def window(self) -> int:
        return max(MIN_WINDOW, -(-self.whole // min(self.parts)))

    @property
    def windows(self) -> int:
        return -(-self.slots // self.window)

    def run_by(self, t: int, forced: int | None = None) -> list[int]:
        """The blocks that each source has run in this phase by its slot t: the whole part of its share, or one more by largest remainders; a forced source is rounded up if it has any."""
        whole = self.whole
        out = [t * p // whole for p in self.parts]
        over = [t * p % whole for p in self.parts]
        for i in sorted(range(len(out)), key=lambda i: (i != forced or not over[i], -over[i], i))[: t - sum(out)]:
            out[i] += 1
        return out

    def edge(self, k: int) -> list[int]:
        """The blocks that each source has run when window k begins."""
        if k * self.window >= self.slots:
            return [a - b for a, b in zip(self.after, self.before)]
        return self.run_by(k * self.window)

    def scheduled(self, k: int) -> Iterator[tuple[str, int, int]]:
        """(source, block, slot) of window k, earliest deadline first."""
        whole, parts = self.whole, self.parts
        begin, end = self.edge(k), self.edge(k + 1)
        waiting = [(b * whole // parts[i], i, b) for i, b in enumerate(begin) if b < end[i]]  # (release, source, block)
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        for t in range(k * self.window, min(self.slots, (k + 1) * self.window)):
            while waiting and waiting[0][0] <= t:
                _, i, b = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(b + 1) * whole // parts[i]), i, b))
            _, i, b = heapq.heappop(ready)
            yield self.names[i], self.before[i] + b, self.first + t
            if b + 1 < end[i]:
                heapq.heappush(waiting, ((b + 1) * whole // parts[i], i, b + 1))


def phases(blocks: Mapping[str, int], weights: Mapping[str, Fraction]) -> list[Phase]:
    """Phases until all blocks have run; each ends when a source is used up."""
    done, first, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: n - done[s] for s, n in blocks.items() if done[s] < n}:
        live = {s: weights[s] for s in sorted(left) if weights[s] > 0} or dict.fromkeys(sorted(left), Fraction(1))
        unit = lcm(*(w.denominator for w in live.values()))
        names, parts = list(live), [int(w * unit) for w in live.values()]
        whole = sum(parts)
        if whole > min(parts) * MAX_WINDOW:
            raise ValueError(f"{names[parts.index(min(parts))]} has less than 1 / {MAX_WINDOW} of the weights")
        # the source that is used up first, and the last slot by which its share isn't more than it has
        i = min(range(len(names)), key=lambda i: Fraction(left[names[i]] * whole, parts[i]))
        p = Phase(first, left[names[i]] * whole // parts[i], names, parts, [done[s] for s in names], [])
        ran = p.run_by(p.slots, forced=i)
        p.after = [b + r for b, r in zip(p.before, ran)]
        done.update(zip(names, p.after))
        first += p.slots
        out.append(p)
    return out


def schedule(spark, plan: list[Phase]) -> DataFrame:
    """(__source, __block, __slot) of all blocks, a window of slots at a time."""
    shared = spark.sparkContext.broadcast(plan)
    begins = [0]
    for p in plan:
        begins.append(begins[-1] + p.windows)
    kinds = pa.schema([("__source", pa.string()), ("__block", pa.int64()), ("__slot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int]] = []
        sent = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
        for b in batches:
            for n in b.column(0).to_pylist():
                at = bisect_right(begins, n) - 1
                for row in shared.value[at].scheduled(n - begins[at]):
                    rows.append(row)
                    if len(rows) == SENT_TOGETHER:
                        yield sent()
                        rows.clear()
        if rows:
            yield sent()

    n = begins[-1]
    return spark.range(0, n, 1, min(n, shuffle_partitions(spark))).mapInArrow(run, "__source string, __block long, __slot long")


def mixed(docs: DataFrame, weights: Mapping[str, float] | Callable[[str], float] | None = None, doc_id: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with slot (of its block) and position (of the document in the mix, from 0 without gaps but inside last blocks)."""
    spark, docs = docs.sparkSession, docs.drop("slot", "position", *OWN)
    named = docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))).withColumn("__hash", F.xxhash64(F.col(doc_id), F.lit(SEED)))
    counts = named.groupBy("__source").count()
    rows = {r["__source"]: r["count"] for r in counts.limit(MAX_SOURCES + 1).collect()}
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return docs.withColumn("slot", F.lit(0).cast("long")).withColumn("position", F.lit(0).cast("long"))
    weight = weights if callable(weights) else (weights or {}).get
    given = {s: Fraction(1 if (w := weight(s)) is None else w) for s in rows}
    plan = phases({s: -(-n // block_docs) for s, n in rows.items()}, given)
    # the hash's upper 31 bits, scaled to the source's number of ranges: ranges are in hash order
    ranges = F.broadcast(spark.createDataFrame([(s, -(-n // RANKED_TOGETHER)) for s, n in rows.items()], "__source string, __ranges long"))
    at = F.shiftrightunsigned(F.col("__hash").bitwiseXOR(F.lit(-(1 << 63))), 33)
    placed = named.join(ranges, "__source").withColumn("__order", at).withColumn("__range", F.shiftright(at * F.col("__ranges"), 31)).drop("__ranges", "__hash")
    sizes = placed.groupBy("__source", "__range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    # the slots of a range's blocks, of which the first and the last may be shared with its neighbours
    blocks = sizes.withColumn("__block", F.explode(F.sequence(F.expr(f"__before div {block_docs}"), F.expr(f"(__before + n - 1) div {block_docs}"))))
    slots = blocks.join(schedule(spark, plan), ["__source", "__block"]).groupBy("__source", "__range", "__before").agg(F.transform(F.array_sort(F.collect_list(F.struct("__block", "__slot"))), lambda x: x["__slot"]).alias("__slots"))
    inside = Window.partitionBy("__source", "__range").orderBy("__order", doc_id)
    out = placed.withColumn("__row", F.row_number().over(inside)).join(slots, ["__source", "__range"])
    rank = F.col("__before") + F.col("__row") - 1
    block = F.floor(rank / block_docs) - F.floor(F.col("__before") / block_docs)
    out = out.withColumn("slot", F.get("__slots", block.cast("int"))).withColumn("position", (F.col("slot") * block_docs + rank % block_docs).cast("long"))
    return out.select(*docs.columns, "slot", "position")


def laid_out(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix's rows in order of their position, for writing: files and rows within follow the schedule."""
    return mix.repartitionByRange(shuffle_partitions(mix.sparkSession), "position").sortWithinPartitions("position").select(*columns)
