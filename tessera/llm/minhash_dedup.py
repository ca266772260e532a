"""Near-duplicate detection by fast similarity sketches, banding and exact verification.

1. A task turns every whole text into its distinct word shingles, a digest of the set and the band hashes of a fast
   similarity sketch. Rows of equal sets are one class, told from others by the digest and numbered; copies are never
   paired, and rows that repeat an id with other texts are in classes of their own.
2. Classes that share a band are candidates. In each band's bucket the class that meets most others over all bands
   is the hub; every member is verified against it on the full sets. So a group of n near copies costs n links.
3. Buckets whose members are still in different components are compared further. Linked sets differ by less than
   4/3 in size, so members meet only within their class of sizes and the next, in blocks of bounded size: a task
   gets two blocks of sets, computes all intersections there and emits links alone. No pair of candidates is
   ever a row, and no bucket is capped.
4. Components of the links, by joins; a component's id is the least document id of its classes.

With T = 240 coordinates in bands of 5, two sets of resemblance 0.75 share no band with a chance of 2e-6.

Defined cases: null and empty texts and texts without words have no shingle, link with nothing and are kept; fewer
words than a shingle: the whole sequence is one; long texts are taken whole; rows that repeat an id each belong to
the component of their own text, and are kept if the id is the least there; rows without an id are linked with
nothing, have no component and are kept; an empty table gives an empty table; other columns of the input don't matter.
Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, materialise, small_batches
from tessera.llm.components import components
from tessera.llm.membership import may_be_in
from tessera.llm.shingles import shingle_set
from tessera.llm.sketching import band_hashes, similarity_sketch

#: Words of a shingle; least resemblance in hundredths; coordinates of a sketch and of a band; classes in a block.
WORDS, PERCENT, COORDINATES, BAND_ROWS, BLOCK = 5, 75, 240, 5, 512
#: Columns of a dense intersection at a time.
DENSE_COLUMNS = 4096
#: Classes of sizes: sets whose sizes differ by 4/3 at most are in one or in neighbouring classes (just below 1 / ln(4/3)).
SIZE_STEP = 3.47


def described(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, n, digest, bands, text_key) of each row; digest, bands and text_key are null without shingles or id."""
    kinds = {"n": T.LongType(), "digest": T.BinaryType(), "bands": T.ArrayType(T.LongType()), "text_key": T.BinaryType()}
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(k, v) for k, v in kinds.items())])

    def run(b: pa.RecordBatch) -> pa.Table:
        n, digests, bands, keys = [], [], [], []
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = shingle_set(x, words)
            some = len(found) > 0 and i is not None
            n.append(len(found))
            digests.append(digest_of(found) if some else None)
            bands.append(band_hashes(similarity_sketch(found, COORDINATES), BAND_ROWS) if some else None)
            keys.append(hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() if some else None)
        return pa.table({"id": b.column(0), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "text_key": pa.array(keys, pa.binary())})

    return arrow_map(docs.select(doc_id, text), schema, run)


def digest_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, found) of each wanted class (id, digest, least): its distinct shingle hashes, ascending, as little-endian 64-bit integers."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("found", T.BinaryType())])

    def run(b: pa.RecordBatch) -> pa.Table:
        found = [shingle_set(x, words) for x in b.column(0).to_pylist()]
        return pa.table({"digest": pa.array(map(digest_of, found), pa.binary()), "found": pa.array([x.tobytes() for x in found], pa.binary())})

    # texts stay in place; what the filter lets through besides has no wanted digest
    texts = small_batches(docs).where(may_be_in(wanted, "least")(doc_id)).select(text)
    # rows that repeat id and text bring a class more than once
    return arrow_map(texts, schema, run).join(wanted.select("id", "digest"), "digest").dropDuplicates(["digest"]).select("id", "found")


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """100 * intersection >= percent * union, in integers."""
    return 100 * both >= percent * (a + b - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets."""
    one = pairs.join(sets.withColumnsRenamed({"id": "a", "found": "found_a"}), "a")
    two = one.join(sets.withColumnsRenamed({"id": "b", "found": "found_b"}), "b").select("a", "b", "found_a", "found_b")
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batch: pa.RecordBatch) -> pa.Table:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            most, least = max(len(x), len(y)), min(len(x), len(y))
            ok.append(100 * least >= percent * most and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
        return pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(two, schema, run)


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one with every set of two."""
    out = np.zeros((len(one), len(two)), np.int64)
    a, b = np.concatenate(one), np.concatenate(two)
    shared = np.intersect1d(a, b)
    at_a, at_b = np.repeat(np.arange(len(one)), [len(x) for x in one]), np.repeat(np.arange(len(two)), [len(x) for x in two])
    in_a, in_b = np.isin(a, shared), np.isin(b, shared)
    a, at_a, b, at_b = np.searchsorted(shared, a[in_a]), at_a[in_a], np.searchsorted(shared, b[in_b]), at_b[in_b]
    for lo in range(0, len(shared), DENSE_COLUMNS):
        wide = min(DENSE_COLUMNS, len(shared) - lo)
        m, n = np.zeros((len(one), wide), np.float32), np.zeros((len(two), wide), np.float32)
        pick = (a >= lo) & (a < lo + wide)
        m[at_a[pick], a[pick] - lo] = 1
        pick = (b >= lo) & (b < lo + wide)
        n[at_b[pick], b[pick] - lo] = 1
        out += (m @ n.T).astype(np.int64)
    return out


def in_size_classes(members: DataFrame) -> DataFrame:
    """(bucket, size, id, component, guest): the members (bucket, id, component, n) of buckets that are still open, by class of sizes.

    A member is at home in its own class and a guest in the next. Classes without members of two components, one of
    them at home, have nothing to compare; of classes with the same members one is enough.
    """
    own = F.floor(F.log("n") * SIZE_STEP).cast("int")
    placed = members.withColumn("own", own).withColumn("class", F.explode(F.array("own", F.col("own") + 1))).withColumn("guest", F.col("class") > F.col("own")).drop("own", "n")
    seen = F.xxhash64("id", "guest")
    open_ = (
        placed.groupBy("bucket", "class")
        .agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("guest").alias("guests"), F.sum(seen % (1 << 40)).alias("one"), F.bit_xor(F.xxhash64("id", "guest", F.lit(1))).alias("two"))
        .where("lo <> hi and not guests")
    )
    open_ = open_.groupBy("size", "one", "two").agg(F.min(F.struct("bucket", "class")).alias("x")).select("x.bucket", "x.class", "size")
    return placed.join(open_, ["bucket", "class"]).select(F.xxhash64("bucket", "class").alias("bucket"), "size", "id", "component", "guest")


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside each bucket, but for those between guests; members: (bucket, size, id, component, guest)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "component", "guest", "id")
        .join(sets, "id")
    )

    def run(t: pa.Table) -> pa.Table:
        x = t.column("x")[0].as_py()
        own = t.column("own").to_numpy()
        ids, comps, guest = (t.column(c).to_numpy() for c in ("id", "component", "guest"))
        found = [np.frombuffer(f.as_py(), np.uint64) for f in t.column("found")]
        left = np.flatnonzero(own == x)
        right = left if t.column("y")[0].as_py() == x else np.flatnonzero(own != x)
        if not len(left) or not len(right):
            return pa.table({"a": ids[:0], "b": ids[:0]})
        size = np.array([len(f) for f in found])
        both = intersections([found[i] for i in left], [found[i] for i in right])
        ok = linked(both, size[left][:, None], size[right][None, :], percent) & (comps[left][:, None] != comps[right][None, :]) & ~(guest[left][:, None] & guest[right][None, :])
        i, j = np.nonzero(ok)
        return pa.table({"a": ids[left[i]], "b": ids[right[j]]})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect whatever the candidates connect; classes: (id, digest, least, n, bands)."""
    members = classes.select(F.explode("bands").alias("bucket"), "id")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    live = materialise(members.join(shared, "bucket"), "buckets")
    degree = live.groupBy("id").agg(F.sum(F.col("size") - 1).alias("degree"))
    ids = materialise(degree.join(classes.select("id", "digest", "least", "n"), "id"), "degrees")
    sets = materialise(shingle_sets(docs, ids, doc_id, text, words), "sets")
    hubs = live.join(ids.select("id", "degree"), "id").groupBy("bucket").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    star = live.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = materialise(verified(star, sets, percent), "links")
    known = components(first)
    placed = live.select("bucket", "id").join(known, live["id"] == known["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    # buckets of one component are done; only the others' members are looked at by size
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left = materialise(placed.join(mixed, "bucket").join(ids.select("id", "n"), "id"), "open")
    rest = materialise(in_size_classes(left), "open")
    return first.union(materialise(block_links(rest, sets, percent), "links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least id reachable over links), kept, n_links (verified links of its class), text_key (MD5 of a text with shingles), component_key (tells components apart)."""
    rows = materialise(described(docs, doc_id, text, words), "described")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.min_by("bands", "id").alias("bands"))
    # numbers are written, so they stay as they are
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = links(classes, docs, doc_id, text, words, percent)
    known = components(found)
    degree = found.union(found.select("b", "a")).groupBy(F.col("a").alias("linked")).agg(F.count("*").alias("n_links"))
    linked_classes = materialise(
        classes.select("id", "digest", "least").join(known, classes["id"] == known["node"]).join(degree, classes["id"] == degree["linked"]).select("digest", "least", "component", "n_links"), "linked"
    )
    # a table of its own, so that the join on a hot component can be split
    least = materialise(linked_classes.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of_class = linked_classes.join(least, "component").select(F.col("digest").alias("linked"), "component", "component_id", "n_links")
    alone = classes.select("digest", "least")
    joined = rows.join(alone, "digest", "left").join(of_class, F.col("digest") == F.col("linked"), "left")
    component = F.coalesce("component_id", "least", "id")
    # an id may repeat with unlike texts, so it doesn't tell components apart
    key = F.coalesce(F.col("component").cast("string"), F.hex("digest"))
    return joined.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "text_key", key.alias("component_key"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the least id, then of the least MD5 of its text, then of the least other columns.

    Rows, not ids, are dropped: a text that shares its id with another's is judged by itself. Rows without shingles or id stay.
    """
    found = near_duplicates(docs, doc_id, text, words, percent).where("text_key is not null")
    rows = materialise(found.groupBy(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key")).agg(F.count("*").alias("n"), F.first("component_key").alias("component")), "texts")
    best = F.min(F.struct("__id", "__key"))
    # a table of its own, so that the join on a hot component can be split
    stay = materialise(rows.groupBy("component").agg(best.alias("x")), "stay")
    gone = materialise(rows.join(stay, "component").where(F.struct("__id", "__key") != F.col("x")).select("__id", "__key"), "gone")
    repeated = rows.where("n > 1").join(stay.select("x.*"), ["__id", "__key"], "left_semi").select("__id", "__key")
    columns = docs.columns
    keyed = docs.withColumn("__id", F.col(doc_id)).withColumn("__key", F.unhex(F.md5(F.col(text).cast("binary"))))
    # only rows whose id may be that of a dropped one are shuffled
    asked = may_be_in(gone, "__id")("__id")
    left = small_batches(keyed).where(~asked).union(keyed.where(asked).join(gone, ["__id", "__key"], "left_anti").select(keyed.columns))
    if repeated.isEmpty():
        return left.select(columns)
    repeated = materialise(repeated, "repeated")
    again = left.join(repeated, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return left.join(repeated, ["__id", "__key"], "left_anti").select(columns).union(again)
