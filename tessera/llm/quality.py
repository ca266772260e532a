"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of the target text (documents labelled good), one of all raw
text, give every document the log of its importance weight: the sum of log ratios over its unigrams and bigrams.
Adding independent Gumbel noise and taking the k largest samples k documents without replacement in proportion to
their weights. k is the number of documents whose weight lies above the cut that separates the labelled ones best,
so it follows the corpus. For the cut a text of the target is weighed by a model of the others, or else the cut would
suit texts that the model has seen, and unseen good ones would go. The k-th largest key is found exactly by counting in ranges of the key, digit by digit.

The target model is fitted on at most TARGET_ROWS labelled rows, those of least hash of their id; the raw model,
the weights, k and the threshold are of all rows.

Defined cases: null and empty texts have log weight 0; a bigram of one word twice is one feature whatever the word;
long texts are taken whole; without labels of both kinds every row is kept; keys that tie at the threshold are all
kept; noise depends on the id alone, rows without an id have none; an empty table gives an empty table; other
columns pass through, and input columns named like the output's are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tessera.llm.common import arrow_map, materialise, small_batches, with_columns
from tessera.llm.shingles import mixed

#: Buckets of hashed n-grams; labelled rows of each kind at most; seed of the noise; steps of a key.
BUCKETS, TARGET_ROWS, SEED, STEPS = 1 << 16, 20_000, 42, 1 << 20
#: Keys are compared as integers of 3 digits of this many bits.
DIGIT_BITS, OFFSET = 18, 1 << 53
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xA0761D6478BD642F)


def ngram_buckets(text: str | None) -> np.ndarray:
    """The bucket of each unigram and bigram of the text."""
    found = _TOKEN.findall((text or "").lower())
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    pairs = np.where(h[1:] == h[:-1], _AGAIN, mixed(h[:-1] * _STEP + h[1:]))
    return (np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def labelled(labels: DataFrame, doc_id: str, label: str, rows: int) -> DataFrame:
    """(id, label) of at most `rows` labelled documents of each kind, those of least hash; bounded, so it may be broadcast."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    parts = [known.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(rows) for x in (0, 1)]
    return parts[0].union(parts[1])


def counted(docs: DataFrame, text: str) -> dict[str, np.ndarray]:
    """Bucket counts of all rows and of the target's (label 1); a task adds up its own before anything is sent."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = ngram_buckets(x)
                np.add.at(raw, found, 1)
                if good == 1:
                    np.add.at(target, found, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": some, "raw": raw[some], "target": target[some]})

    sums = small_batches(docs.select(text, "__label")).mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = {"raw": np.zeros(BUCKETS), "target": np.zeros(BUCKETS)}
    for row in sums.collect():  # BUCKETS rows at most
        out["raw"][row["bucket"]], out["target"][row["bucket"]] = row["raw"], row["target"]
    return out


def weighted(docs: DataFrame, counts: dict[str, np.ndarray], text: str) -> DataFrame:
    """docs with log_weight and __unseen, the weight that a labelled text has by a target model of the other texts; null without a label."""
    raw, target = counts["raw"], counts["target"]
    ratios = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if target.any() else np.zeros(BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast((ratios, target))
    own = ("log_weight", "__unseen")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in own] + [T.StructField(n, T.DoubleType()) for n in own])

    def run(b: pa.RecordBatch) -> pa.Table:
        ratios, target = shared.value
        total = target.sum()
        weights, unseen = [], []
        for x, label in zip(b.column(text).to_pylist(), b.column("__label").to_pylist()):
            found = ngram_buckets(x)
            w = float(ratios[found].sum())
            weights.append(w)
            if label == 1 and len(found):
                at, n = np.unique(found, return_counts=True)
                seen = np.log((target[at] + 1) / (total + BUCKETS))
                w += float((n * (np.log((target[at] - n + 1) / (total - len(found) + BUCKETS)) - seen)).sum())
            unseen.append(None if label is None else w)
        return with_columns(b, log_weight=pa.array(weights, pa.float64()), __unseen=pa.array(unseen, pa.float64())).select(schema.names)

    return arrow_map(docs, schema, run)


def best_cut(weights: list[tuple[float, int]]) -> float | None:
    """The cut with the highest mean of the shares of good above and bad below; None without both kinds."""
    if len({y for _, y in weights}) < 2:
        return None
    w, y = np.array(sorted(weights)).T
    good, bad = (y == 1).sum(), (y == 0).sum()
    gain = np.concatenate([[1.0], (good - np.cumsum(y == 1)) / good + np.cumsum(y == 0) / bad])
    at = int(gain.argmax())
    if at == 0:
        return float(w[0])
    return float((w[at - 1] + w[at]) / 2) if at < len(w) else float(w[-1]) + 1.0


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of integers below 2 ** (3 * DIGIT_BITS), from counts by digit; None if there are fewer."""
    low, rest = 0, k
    for level in (2, 1, 0):
        width = 1 << (DIGIT_BITS * level)
        within = keys.where(F.col(column).between(low, low + (width << DIGIT_BITS) - 1))
        digits = within.groupBy(F.floor((F.col(column) - low) / width).alias("d")).count().collect()  # 2 ** DIGIT_BITS rows at most
        for d, n in sorted(digits, reverse=True):
            if n >= rest:
                low += int(d) * width
                break
            rest -= n
        else:
            return None
    return low


def resampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep_text: bool = True) -> DataFrame:
    """docs (without texts unless asked) with log_weight, sort_key (weight and noise in integer steps) and kept (whether the sample has it)."""
    sample = labelled(labels, doc_id, label, TARGET_ROWS).withColumnsRenamed({"id": "__id", "label": "__label"})
    marked = docs.drop("__id", "__label", "__unseen").join(F.broadcast(sample), F.col(doc_id) == F.col("__id"), "left").drop("__id")
    counts = counted(marked, text)
    u = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(SEED)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    noise = F.when(F.col(doc_id).isNull(), 0.0).otherwise(-F.log(-F.log(u)))
    key = F.least(F.greatest(F.round((F.col("log_weight") + noise) * STEPS), F.lit(-float(OFFSET))), F.lit(float(OFFSET - 1))).cast("long") + OFFSET
    whole = weighted(marked, counts, text).withColumn("sort_key", key)
    scored = materialise(whole.drop(text), "weights")
    known = scored.where("__label is not null").select("__unseen", "__label").collect()  # 2 * TARGET_ROWS rows, but for repeated ids
    cut = best_cut([tuple(r) for r in known])
    k = scored.count() if cut is None else scored.where(F.col("log_weight") >= cut).count()
    least = kth_largest(scored, "sort_key", k) if k else 1 << 62
    # texts are weighed again, with the same result, rather than written
    return (whole if keep_text else scored).drop("__label", "__unseen").withColumn("kept", F.col("sort_key") >= F.lit(0 if least is None else least))
