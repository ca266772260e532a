"""Phrases whose words come together more often than by chance.

Documents are put into shards of one language each. A shard numbers its words and keeps a full-text index of them in
which the suffixes' order goes as far as the longest phrase: every phrase is an interval of rows, and a table leads
from a row to that of the suffix one word later, which is the inverse of the step to the left of a Burrows-Wheeler
transform. A phrase's interval is extended in both directions at once: the rows of a phrase of k words that the step
leads into another phrase of k words are the interval of k + 1 words which begins with the one and ends with the
other, and its size is their count. All intervals of a depth are extended together, without sorting.

Counts are summed across shards, depth by depth. A phrase can be frequent only if what is left of it without its first
and without its last word is, so a shard extends frequent phrases alone; which are frequent comes back to the shards by
a join, as numbers. A phrase of k + 1 words is the pair of its parts' numbers, so keys are exact and short.

Defined cases: null and empty texts, and texts of separators alone, have no words; rows without a language are of
language `und`, together with rows that name it; words that a separator parts are never one phrase; occurrences may
overlap; long texts are taken whole, and cut between shards only at separators; rows that repeat an id or a text count
as often as they come; of phrases that tie in score and count the first in the order of bytes comes first; a language
without frequent phrases has no row; an empty table gives an empty table; other columns don't matter. Products of
counts are decimals of 38 digits, beyond which Spark raises an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import give_back, materialise, small_batches

#: Occurrences of a phrase at least; words of a phrase at most; phrases of a language that are reported.
LEAST, WORDS, TOP = 100, 5, 2000
#: Words of a shard, roughly; rows that a task sends on together; parts in which a language's phrases are ranked first; splits of the input that a task reads, as larger shards have fewer phrases in all.
SHARD_WORDS, SENT_TOGETHER, RANK_PARTS, SPLITS = 7 << 20, 1 << 16, 64, 4
#: Bits of a place within a shard, and of a shard's number within its task: a row's own number is its shard's and its place.
PLACE_BITS, OWN_BITS = 31, 12
#: The byte that stands for a separator of pieces; UTF-8 never has it.
_MARK = b"\xff"
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + _MARK * len(_SEPARATORS))


def words_and_marks(text: str) -> list[bytes]:
    """The text's words in order, A-Z lower-cased, with a mark wherever a piece ends."""
    found = text.encode("utf-8").translate(_PLAIN).replace(_MARK, b" \xff ").split(b" ")
    return [w for w in found if w]


def packed(a: np.ndarray) -> bytes:
    """32-bit integers, compressed by planes of bytes."""
    return pa.compress(np.ascontiguousarray(a.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(b, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<i4").ravel()


def renumbered(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """number[ids], in the place of ids."""
    for at in range(0, len(ids), SENT_TOGETHER):
        some = ids[at : at + SENT_TOGETHER]
        some[:] = number[some]
    return ids


class Gathering:
    """The words of a language that a task has read since its last shard; 0 is the mark."""

    def __init__(self):
        self.number = defaultdict(count(1).__next__, {_MARK: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        found = words_and_marks(text)
        found.append(_MARK)
        ids = np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))
        # held until the shard is full: two bytes a word as long as the numbers allow
        self.parts.append(ids if len(self.number) > 1 << 16 else ids.astype(np.uint16))
        self.size += len(found)

    def taken(self) -> np.ndarray:
        """The words' numbers; the parts go as they are copied."""
        out, at = np.empty(self.size, np.int32), 0
        for part in self.parts:
            out[at : at + len(part)] = part
            at += len(part)
        self.parts.clear()
        return out


def cut_at_marks(ids: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """ids in parts of about `limit`, each with a mark at its end."""
    marks = np.flatnonzero(ids == 0)
    at = 0
    while len(ids) - at > 2 * limit:
        k = np.searchsorted(marks, at + limit)
        if k == len(marks):
            break
        yield ids[at : marks[k] + 1]
        at = int(marks[k]) + 1
    if at < len(ids):
        yield ids[at:]


_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(shard, lang, size, ids, words, counts): numbered words of some documents of a language; word i has number i + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, held = task << OWN_BITS, {}
        if task >> (63 - PLACE_BITS - OWN_BITS):
            raise ValueError("too many tasks to number their shards")

        def settled(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            g = held.pop(name)
            every, whole = np.array([w.decode("utf-8") for w in list(g.number)[1:]], object), g.taken()
            del g
            for ids in cut_at_marks(whole, SHARD_WORDS):
                n = np.bincount(ids, minlength=len(every) + 1)
                some = np.flatnonzero(n[1:]) + 1
                again = np.zeros(len(n), np.int32)
                again[some] = np.arange(1, len(some) + 1)
                row = {"shard": number, "lang": name, "size": len(ids), "ids": packed(renumbered(ids, again)), "words": every[some - 1], "counts": n[some]}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _SHARDS], schema=_SHARDS)
                del n, again, row
                give_back()
                number += 1
                if number >> OWN_BITS != task:
                    raise ValueError("too many shards in a task")

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(name, g := held.get(name) or Gathering()).add(x)
                if g.size >= SHARD_WORDS:
                    yield from settled(name)
                elif sum(h.size for h in held.values()) >= 2 * SHARD_WORDS:
                    yield from settled(max(held, key=lambda k: held[k].size))
        for name in list(held):
            yield from settled(name)
        give_back()

    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, own.rdd.getNumPartitions() // SPLITS)
    return small_batches(own.coalesce(tasks)).mapInArrow(run, "shard long, lang string, size long, ids binary, words array<string>, counts array<long>")


def suffix_rows(ids: np.ndarray, depth: int) -> np.ndarray:
    """Where words begin in ids, in the order of the `depth` numbers from there on."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    bits = max(1, int(ids.max(initial=0)).bit_length())
    rows, left = np.flatnonzero(ids).astype(np.int32), depth
    while left:
        wide = min(left, 63 // bits)
        left -= wide
        key = np.zeros(len(rows), np.int64)
        for j in range(left, left + wide):
            key <<= bits
            key |= padded[rows + j]
        order = np.argsort(key, kind="stable")
        del key
        rows = rows[order]
        del order
    return rows


def index(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's first word, and the row of the suffix one word later, -1 where a mark is next."""
    rows = suffix_rows(ids, depth)
    at = np.full(len(ids) + 1, -1, np.int32)
    at[rows] = np.arange(len(rows), dtype=np.int32)
    return ids[rows], at[rows + 1]


def intervals(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of the runs of like values."""
    begin = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(first)))


def extended(step: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The intervals one word longer: begins, sizes, which of the given intervals each begins and ends with; and the steps between their rows.

    Rows outside of them can be in no longer interval either, so only theirs stay, numbered anew.
    """
    node = np.full(len(step) + 1, -1, np.int32)  # the last for steps to nowhere
    named = np.repeat(np.arange(len(low), dtype=np.int32), size)
    if len(named) == len(step):  # all rows, as at first
        node[:-1] = named
    else:
        node[np.repeat(low - np.cumsum(size) + size, size) + np.arange(len(named))] = named
    del named
    later = node[step]
    rows = np.flatnonzero((node[:-1] >= 0) & (later >= 0)).astype(np.int32)
    left, right = node[rows], later[rows]
    del node, later
    begin = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(rows) else np.empty(0, np.int64)
    again = np.full(len(step) + 1, -1, np.int32)
    again[rows] = np.arange(len(rows), dtype=np.int32)
    return begin, np.diff(np.append(begin, len(rows))), left[begin], right[begin], again[step[rows]]


#: A shard's index (shard, rows, step) or one of its intervals (place, size, left, right), whose place is the shard's number and the interval's begin.
_ROWS = pa.schema([("shard", pa.int64()), ("rows", pa.int64()), ("step", pa.binary()), ("place", pa.int64()), ("size", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])
_ROWS_SQL = "shard long, rows long, step binary, place long, size int, left long, right long"


def sent(shard: int, step: np.ndarray, *intervals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row with the steps of a shard's rows, then rows of its intervals: low, size, left, right."""
    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, len(step), packed(np.diff(step, prepend=0)), None, None, None, None), _ROWS)], schema=_ROWS)
    for at in range(0, len(intervals[0]), SENT_TOGETHER):
        low, *part = (x[at : at + SENT_TOGETHER] for x in intervals)
        n = len(low)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *(pa.array(x).cast(f.type) for x, f in zip(((shard << PLACE_BITS) | low, *part), list(_ROWS)[3:]))], schema=_ROWS)


def indexed(held: DataFrame, numbers: DataFrame, depth: int) -> DataFrame:
    """Of each shard its index (shard, rows, step) and the intervals of two frequent words (place, size, left, right); numbers: (shard, known: array of (at, id))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, n, ids, known = (b.column(c)[i] for c in ("shard", "size", "ids", "known"))
                at, number = (known.values.field(c).to_numpy() for c in ("at", "id"))
                ids = unpacked(ids.as_py(), n.as_py())
                dense = np.zeros(int(ids.max(initial=0)) + 1, np.int32)  # words that aren't frequent part pieces as marks do
                dense[at] = np.arange(1, len(at) + 1)
                ids = renumbered(ids, dense)
                first, step = index(ids, depth)
                low, size = intervals(first)
                word = number[first[low] - 1]
                del ids, first
                give_back()  # arrays of this size stay with the process otherwise
                low, size, left, right, step = extended(step, low, size)
                give_back()
                yield from sent(shard.as_py(), step, low, size, word[left], word[right])
        give_back()

    return held.select("shard", "size", "ids").join(numbers, "shard").mapInArrow(run, _ROWS_SQL)


def deeper(steps: DataFrame, frequent: DataFrame) -> DataFrame:
    """The same, one word longer, of the frequent intervals; frequent: (shard, known: array of (at, size, id))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, n, step, known = (b.column(c)[i] for c in ("shard", "rows", "step", "known"))
                low, size, phrase = (known.values.field(c).to_numpy() for c in ("at", "size", "id"))
                order = np.argsort(low)  # gathered in any order, and extended() takes intervals that hold all rows as they come
                low, size, phrase = low[order], size[order], phrase[order]
                step = np.cumsum(unpacked(step.as_py(), n.as_py()), dtype=np.int64)
                low, size, left, right, step = extended(step, low.astype(np.int64), size.astype(np.int64))
                yield from sent(shard.as_py(), step, low, size, phrase[left], phrase[right])
        give_back()

    return steps.join(frequent, "shard").mapInArrow(run, _ROWS_SQL)


def frequent_only(counts: DataFrame, key: list[str], n: str, least: int, label: str) -> DataFrame:
    """The rows (place and others) whose key comes to `least` or more over all shards, with the sum a, the key's id, and whether the row is the one that stands for its key.

    One shuffle sums a key's shards, of which each has one row, and tells them the sum. The id is the least place.
    """
    own = Window.partitionBy(*key)
    summed = counts.withColumn("a", F.sum(n).over(own)).withColumn("id", F.min("place").over(own))
    return materialise(summed.where(F.col("a") >= least).withColumn("first", F.col("place") == F.col("id")), label)


def by_shard(frequent: DataFrame, *columns: str) -> DataFrame:
    """(shard, known: array of (at, columns and id)), of the frequent rows."""
    at = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("at")
    return frequent.groupBy(F.shiftright("place", PLACE_BITS).alias("shard")).agg(F.collect_list(F.struct(at, *columns, "id")).alias("known"))


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741  the contract's names
    """floor(1000 * a * n / (l * r)), exact."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(a) * whole(n), whole(l) * whole(r))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS) -> DataFrame:
    """Every phrase of 2 to `words` words that occurs `least` times or more in its language.

    Output: lang, phrase, words, a (its count), l and r (counts of its parts at the cut of the lowest score), n (words of
    the language), score, most_left and most_right (the highest count of a frequent phrase with one word more before or
    after it, 0 without one).
    """
    held = materialise(shards(docs, text, lang), "shards")
    totals = held.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    counts = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    counts = counts.select("lang", F.shiftleft("shard", PLACE_BITS).bitwiseOR(F.col("at").cast("long") + 1).alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    known = frequent_only(counts, ["lang", "word"], "n", least, "words")
    none = F.array().cast("array<bigint>")
    level = known.where("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("before"), none.alias("after"))
    found = materialise(indexed(held, by_shard(known), words), "index")
    levels = []
    for size in range(2, words + 1):
        frequent = frequent_only(found.where("step is null").select("place", "size", "left", "right"), ["left", "right"], "size", least, "frequent")
        one = level.select(F.col("id").alias("left"), "lang", "phrase", F.col("a").alias("a_left"), "before")
        two = level.select(F.col("id").alias("right"), "last", F.col("a").alias("a_right"), "after")
        longer = frequent.where("first").select("id", "left", "right", "a").join(one, "left").join(two, "right")
        level = materialise(
            longer.select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", F.concat("before", F.array("a_left")).alias("before"), F.concat("after", F.array("a_right")).alias("after"), F.lit(size).alias("words")), "level"
        )
        levels.append(level)
        if size < words:
            found = materialise(deeper(found.where("step is not null").select("shard", "rows", "step"), by_shard(frequent, "size")), "longer")
    out = []
    for level, longer in zip(levels, [*levels[1:], levels[-1].limit(0)]):
        most = lambda side: longer.groupBy(F.col(side).alias("id")).agg(F.max("a").alias(f"most_{side}"))  # noqa: B023, E731
        # a longer phrase that ends with this one has a word more before it
        out.append(level.join(most("right").withColumnRenamed("most_right", "most_left_"), "id", "left").join(most("left").withColumnRenamed("most_left", "most_right_"), "id", "left"))
    whole = reduce(DataFrame.unionByName, out).join(totals, "lang")
    # the cut after k words: before[k - 1] counts the first k words, after[words - k - 1] the others
    cut = lambda l, k: F.struct(score(F.col("a"), F.col("n"), l, F.get("after", F.col("words") - k - 2)).alias("score"), (k + 1).alias("k"))  # noqa: E731, E741
    best = whole.withColumn("best", F.array_min(F.transform("before", cut)))
    return best.select(
        "lang", "phrase", "words", "a", F.get("before", F.col("best.k") - 1).alias("l"), F.get("after", F.col("words") - F.col("best.k") - 1).alias("r"), "n", F.col("best.score").alias("score"),
        F.coalesce("most_left_", F.lit(0).cast("long")).alias("most_left"), F.coalesce("most_right_", F.lit(0).cast("long")).alias("most_right"),
    )


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP) -> DataFrame:
    """Each language's `top` phrases by score, then count, then bytes, with their rank; those that never come without one word more are left out.

    A phrase within a longer one of the same count is within one of a single word more of that count, so next lengths suffice.
    """
    found = materialise(phrases(docs, text, lang, least, words).where(F.greatest("most_left", "most_right") < F.col("a")), "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return ranked.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
