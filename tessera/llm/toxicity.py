"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index of all their words.

Terms are all words of the examples, lower-cased, and those beginnings of 4 to 6 letters that toxic examples hold
significantly more often, so that inflected forms count together. What passes that test weighs BOOST times as much;
no word is left out. Document frequencies are of all documents. A text's votes are those of the NEIGHBOURS examples
of highest cosine and of all that tie with the last of them, weighted by powers of the cosine. A monotone map, fitted
on the votes that the examples themselves get from other texts, turns the share of toxic votes into the score; the
nearest examples are the evidence.

The index: examples are in blocks of like ones. Rare terms' postings are read in full. Common terms' weights are kept
by block with their maxima; a block is read only if the bound from its maxima can reach the k-th cosine found so far.

A score depends on nothing but the text: an example with the text's own digest never votes, so that no text is judged
by its own label, and copies score alike whether they are labelled or not.

Fitted on a bounded sample: at most EXAMPLES labelled rows of each kind, those of least hash of their id; votes and
the map weigh each kind by its share of all labels. All rows are scored and counted. Words that no example holds can't
tell examples apart and are not part of a text's length. Terms are told apart by 64-bit hashes.

Defined cases: null and empty texts, texts without a word of any example, and all texts where labels of one kind are
missing score the base rate of the labels (0 without labels); long texts are taken whole; an example whose id repeats
with several texts is the least of them; labels that repeat an id count once, as the larger; rows that repeat an id
are all scored, by their own texts; ids of any type; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tessera.llm.bpe import Memo
from tessera.llm.common import arrow_map, give_back, materialise, shuffle_partitions, small_batches
from tessera.llm.quality import labelled
from tessera.llm.shingles import shingle_hashes

#: Labelled rows of each kind at most; neighbours that vote; neighbours given as evidence; power of a cosine in its vote.
EXAMPLES, NEIGHBOURS, EVIDENCE, POWER = 2_000, 25, 3, 3
#: How much more a term weighs that passes the label test; its least toxic examples, log-likelihood ratio and ratio of shares.
BOOST, MIN_EXAMPLES, MIN_RATIO, MIN_LIFT = 8.0, 3, 12.0, 3.0
#: Lengths of word beginnings; terms that a task counts before it sends them on.
BEGINNINGS, COUNTED_TERMS = (4, 5, 6), 200_000
#: Terms kept by block at most, and the least share of examples that hold one; examples of a block; texts scored together.
COMMON_TERMS, COMMON_SHARE, BLOCK, TOGETHER = 256, 1 / 16, 128, 64
#: Digits of a cosine by which neighbours tie, and of a score.
COSINE_DIGITS, SCORE_DIGITS, WORDS_BYTES = 10, 9, 16 << 20
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def term(name: str) -> int:
    """The 64-bit hash of a word, as a signed integer."""
    h = xxh3_64_intdigest(name)
    return h - (1 << 64) if h >> 63 else h


def beginnings(word: str) -> set[str]:
    return {word[:n] for n in BEGINNINGS if len(word) >= n}


def digest(text: str | None) -> int:
    return term(text or "")


def chosen(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, label, text, counts): one row for each example; of copies and near copies of one label, by least shingle hash, one counts."""
    one = docs.select(doc_id, text).join(F.broadcast(sample), F.col(doc_id) == F.col("id")).groupBy("id", "label").agg(F.coalesce(F.min(text), F.lit("")).alias("text"))
    schema = T.StructType([*one.schema.fields, T.StructField("least", T.LongType())])

    def run(b: pa.RecordBatch) -> pa.Table:
        least = [int(h.min().view(np.int64)) if len(h := shingle_hashes(x)) else 0 for x in b.column(2).to_pylist()]
        return pa.Table.from_batches([b]).append_column("least", pa.array(least, pa.int64()))

    rows = materialise(arrow_map(one, schema, run), "examples")
    firsts = rows.groupBy("label", "least").agg(F.min("id").alias("first"))
    return rows.join(F.broadcast(firsts), ["label", "least"]).select("id", "label", "text", (F.col("id") == F.col("first")).alias("counts"))


def term_counts(examples: DataFrame) -> pa.Table:
    """(term, name, toxic, clean): how many examples of each label that count hold a term; a name for beginnings, of those that may pass the test."""
    kinds = pa.schema([("term", pa.int64()), ("name", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        counts: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})  # words, beginnings

        def sent() -> pa.RecordBatch:
            held = [*counts[0].values(), *counts[1].values()]
            out = [list(map(term, counts[0])) + [0] * len(counts[1]), [None] * len(counts[0]) + list(counts[1]), [h[0] for h in held], [h[1] for h in held]]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.types)], schema=kinds)

        for b in batches:
            for label, x, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = set(words(x))
                for of, names in zip(counts, (found, set(chain.from_iterable(map(beginnings, found))))):
                    for name in names:
                        of.setdefault(name, [0, 0])[label] += n
                if len(counts[0]) + len(counts[1]) > COUNTED_TERMS:
                    yield sent()
        yield sent()

    found = small_batches(examples.select("label", "text", F.col("counts").cast("int"))).mapInArrow(run, "term long, name string, clean long, toxic long")
    # words and beginnings of 2 * EXAMPLES rows at most
    return found.groupBy("term", "name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("name").isNull() | (F.col("toxic") >= MIN_EXAMPLES)).toArrow()


@dataclass
class Vocabulary:
    """The terms by number: the words' hashes, ascending, then the beginnings; their weights so far."""

    words: np.ndarray
    beginnings: list[str]
    weight: np.ndarray

    def numbers(self) -> Callable[[str], tuple[int, ...]]:
        """A function that gives the numbers of a word and of its beginnings."""
        word = dict(zip(self.words.tolist(), range(len(self.words)))).get
        begin = dict(zip(self.beginnings, range(len(self.words), len(self.weight)))).get

        def of(w: str) -> tuple[int, ...]:
            found = [word(term(w)), *(begin(w[:n]) for n in BEGINNINGS if len(w) >= n)]
            return tuple(at for at in found if at is not None)

        return of


def vocabulary(counts: pa.Table, n_clean: int, n_toxic: int) -> Vocabulary:
    """All words, and the beginnings that toxic examples hold significantly more often."""
    hashes, c, t = (counts[k].to_numpy() for k in ("term", "clean", "toxic"))
    whole = counts["name"].is_null().to_numpy()
    names = counts["name"].to_pylist()
    passed = np.zeros(len(hashes), bool)
    if n_clean and n_toxic:
        tested = t >= MIN_EXAMPLES
        share = (t + c) / (n_clean + n_toxic)
        part = lambda x, n: x * np.log(np.maximum(x, 1) / np.maximum(share * n, 1e-300))
        lift = (t / n_toxic) / ((c + 0.5) / n_clean)
        # the more terms are tested, the more reach any ratio by chance
        passed = tested & (2 * (part(t, n_toxic) + part(c, n_clean)) >= max(MIN_RATIO, 2 * log(max(1, tested.sum())))) & (lift >= MIN_LIFT)
    own = np.flatnonzero(whole)
    own = own[np.argsort(hashes[own])]
    begins = sorted(names[i] for i in np.flatnonzero(passed & ~whole))
    return Vocabulary(hashes[own], begins, np.concatenate([np.where(passed[own], BOOST, 1.0), np.full(len(begins), BOOST)]))


def term_vectors(rows: DataFrame, text: str, known: Vocabulary) -> DataFrame:
    """rows with digest, terms (numbers of the known terms that the text holds, ascending) and counts instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("digest", T.LongType()), T.StructField("terms", ints), T.StructField("counts", ints)])

    def run(batches):
        memo = Memo(shared.value.numbers(), WORDS_BYTES)
        for b in batches:
            texts = b.column(text).to_pylist()
            found = [np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words(x))), np.int32), return_counts=True) for x in texts]
            ends = np.cumsum([0, *(len(t) for t, _ in found)]).astype(np.int32)
            column = lambda i: pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *(r[i] for r in found)]).astype(np.int32))
            kept = [b.column(f.name) for f in schema.fields[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([digest(x) for x in texts], pa.int64()), column(0), column(1)], names=schema.names)
        give_back()

    return small_batches(rows).mapInArrow(run, schema)


def document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows hold each term; a task adds up its own before anything is sent."""

    def run(batches):
        held = np.zeros(n_terms, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"t": some, "n": held[some]})

    found = vectors.select("terms").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    out = np.zeros(n_terms)
    out[found["t"].to_numpy()] = found["n"].to_numpy()
    return out


class BlockMaxIndex:
    """Unit vectors of the examples: postings of rare terms, blocks with maxima of common ones."""

    def __init__(self, ids: list, labels: np.ndarray, digests: np.ndarray, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        n = len(labels)
        example = np.repeat(np.arange(n), np.diff(ends))
        held = np.bincount(terms, minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:COMMON_TERMS]
        common = common[held[common] > n * COMMON_SHARE]
        # the row of each common term, -1 for others
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        rows = self.row[terms]
        matrix = np.zeros((len(common), n))
        matrix[rows[rows >= 0], example[rows >= 0]] = weights[rows >= 0]
        # like examples, by label and heaviest common term, are in one block
        strongest = matrix.argmax(0) if len(common) else np.zeros(n, int)
        order = np.lexsort((np.arange(n), strongest, labels))
        place = np.empty(n, int)
        place[order] = np.arange(n)
        self.n, self.blocks = n, -(-n // BLOCK)
        self.ids, self.labels, self.digests = [ids[i] for i in order], labels[order], digests[order]
        padded = np.zeros((len(common), self.blocks * BLOCK))
        padded[:, :n] = matrix[:, order]
        self.matrix = np.ascontiguousarray(padded.reshape(len(common), self.blocks, BLOCK).transpose(1, 0, 2))
        self.maxima = self.matrix.max(2) if n else np.zeros((0, len(common)))
        rare = rows < 0
        by_term = np.argsort(terms[rare], kind="stable")
        self.example, self.weight = place[example[rare][by_term]].astype(np.int32), weights[rare][by_term]
        self.starts = np.searchsorted(terms[rare][by_term], np.arange(n_terms + 1))

    def nearest(self, digests: np.ndarray, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int):
        """For each of some texts (indexes, cosines) of its k nearest examples and what ties, nearest first; text: which of them holds the term."""
        texts, wide = len(digests), self.blocks * BLOCK
        row = self.row[terms]
        common = row >= 0
        given = np.zeros((texts, self.matrix.shape[1]))
        given[text[common], row[common]] = weights[common]
        terms, text, weights = terms[~common], text[~common], weights[~common]
        first, count = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        rare = np.bincount(np.repeat(text * wide, count) + self.example[at], self.weight[at] * np.repeat(weights, count), texts * wide).reshape(texts, self.blocks, BLOCK)
        bound = given @ self.maxima.T + rare.max(2)
        cos = np.full((texts, self.blocks, BLOCK), -1.0)
        own = np.zeros((self.blocks, BLOCK), np.int64)
        own.ravel()[: self.n] = self.digests

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                who = np.flatnonzero(wanted[:, b])
                found = np.round(rare[who, b] + given[who] @ self.matrix[b], COSINE_DIGITS)
                cos[who, b] = np.where(own[b] == digests[who][:, None], -1.0, found)

        # the most promising blocks first; then all that may still hold one of the k nearest
        begun = bound >= np.sort(bound, 1)[:, -2:][:, :1]
        read(begun)
        flat = cos.reshape(texts, wide)[:, : self.n]
        kth = lambda: np.partition(flat, self.n - k, 1)[:, self.n - k] if self.n > k else np.full(texts, -1.0)
        read(~begun & (bound >= kth()[:, None] - 1e-9) & (bound > 0))
        for c, least in zip(flat, kth()):
            at = np.flatnonzero((c > 0) & (c >= least))
            at = at[np.argsort(-c[at], kind="stable")]
            yield at, c[at]


def toxic_share(labels: np.ndarray, cos: np.ndarray, worth: np.ndarray) -> float | None:
    """The share of toxic votes; None without votes."""
    w = cos**POWER * worth[labels]
    return float((w * labels).sum() / w.sum()) if len(w) and w.sum() > 0 else None


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, fitted): the ascending distinct x and the weighted isotonic fit of y at each."""
    values, at = np.unique(x, return_inverse=True)
    mass, total = np.bincount(at, weight), np.bincount(at, weight * y)
    pools: list[list[float]] = []  # (total, mass, values)
    for t, m in zip(total.tolist(), mass.tolist()):
        pools.append([t, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, m2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + m2, pools[-1][2] + n2]
    return values, np.repeat([t / m for t, m, _ in pools], [n for _, _, n in pools])


def _votes(b: pa.RecordBatch, index: BlockMaxIndex, weight: np.ndarray):
    """(indexes, cosines) of the voters for each row with digest, terms and counts."""
    for lo in range(0, b.num_rows, TOGETHER):
        part = b.slice(lo, TOGETHER)
        size = np.diff(part.column("terms").offsets.to_numpy())
        terms = part.column("terms").flatten().to_numpy().astype(np.int64)
        weights = part.column("counts").flatten().to_numpy() * weight[terms]
        text = np.repeat(np.arange(part.num_rows), size)
        weights = weights / np.sqrt(np.bincount(text, weights * weights, part.num_rows))[text]
        yield from index.nearest(part.column("digest").to_numpy(), text, terms, weights, NEIGHBOURS)


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, score, evidence) of every row; labels: the rows that may be learned from."""
    spark = docs.sparkSession
    given = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    kinds = {r["label"]: r["n"] for r in given.groupBy(F.col(doc_id)).agg(F.max(label).cast("int").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    base = kinds.get(1, 0) / max(1, sum(kinds.values()))
    example = T.StructType([T.StructField("example", docs.schema[doc_id].dataType), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(example))])
    sample = materialise(labelled(labels, doc_id, label, EXAMPLES), "labels")
    examples = materialise(chosen(docs, sample, doc_id, text), "examples")
    n = {r["label"]: (r["all"], r["counted"]) for r in examples.groupBy("label").agg(F.count("*").alias("all"), F.count_if("counts").alias("counted")).collect()}
    if len(n) < 2:
        return docs.select(doc_id, F.lit(base).alias("score"), F.array().cast(schema["evidence"].dataType).alias("evidence"))
    known = vocabulary(term_counts(examples), n[0][1], n[1][1])
    vectors = materialise(term_vectors(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", known), "vectors")
    n_terms = len(known.weight)
    weight = known.weight * (np.log((1 + vectors.count()) / (1 + document_frequencies(vectors, n_terms))) + 1)
    of_examples = materialise(term_vectors(examples.select("id", "label", "text"), "text", known), "vectors")
    # 2 * EXAMPLES rows at most, never as Python objects but for their ids
    found = of_examples.orderBy("id").toArrow().combine_chunks()
    terms, counts = (found[c].combine_chunks() for c in ("terms", "counts"))
    ends, terms, counts = terms.offsets.to_numpy(), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
    weights = counts * weight[terms]
    owner = np.repeat(np.arange(found.num_rows), np.diff(ends))
    weights = weights / np.sqrt(np.bincount(owner, weights * weights, found.num_rows))[owner]
    index = BlockMaxIndex(found["id"].to_pylist(), found["label"].to_numpy().astype(np.int64), found["digest"].to_numpy(), ends, terms, weights, n_terms)
    del found, terms, counts, weights, owner
    # the sample has its own share of each label; a vote counts as often as its label is rarer there
    worth = np.array([kinds.get(x, 0) / n[x][0] for x in (0, 1)])
    worth = worth / worth.max()
    shared = spark.sparkContext.broadcast((index, weight, worth))

    def shares(b: pa.RecordBatch) -> pa.Table:
        index, weight, worth = shared.value
        return pa.table({"label": b.column("label"), "share": pa.array([toxic_share(index.labels[at], cos, worth) for at, cos in _votes(b, index, weight)], pa.float64())})

    learned = arrow_map(of_examples.repartition(shuffle_partitions(spark)), T.StructType([T.StructField("label", T.IntegerType()), T.StructField("share", T.DoubleType())]), shares).where("share is not null").toArrow()  # examples
    y = learned["label"].to_numpy()
    fitted = spark.sparkContext.broadcast(monotone(learned["share"].to_numpy(), y, worth[y]) if len(y) else None)
    near = pa.list_(pa.struct([("example", pa.null()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(b: pa.RecordBatch) -> pa.Table:
        index, weight, worth = shared.value
        score, why = [], []
        for at, cos in _votes(b, index, weight):
            share = toxic_share(index.labels[at], cos, worth)
            score.append(base if share is None or fitted.value is None else round(float(np.interp(share, *fitted.value)), SCORE_DIGITS))
            why.append([{"example": index.ids[a], "label": int(index.labels[a]), "cosine": min(1.0, float(c))} for a, c in zip(at[:EVIDENCE].tolist(), cos[:EVIDENCE])])
        kind = pa.list_(pa.struct([("example", b.schema.field("id").type), *list(near.value_type)[1:]]))
        return pa.table({doc_id: b.column("id"), "score": pa.array(score, pa.float64()), "evidence": pa.array(why, kind)})

    return arrow_map(vectors, schema, run)
