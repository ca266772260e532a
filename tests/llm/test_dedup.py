import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import components, line_dedup, membership, minhash_dedup
from tessera.llm.shingles import shingle_set
from tessera.llm.sketching import similarity_sketch


def text(r, n):
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def edited(r, t, k):
    w = t.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows, passage = [], text(r, 60)
    for g in range(6):
        base = text(r, r.choice([8, 60, 200]))
        rows += [edited(r, base, r.choice([0, 1, 1, 2, 4])) for _ in range(12)]
    rows += [passage + " " + text(r, r.choice([5, 20, 60])) for _ in range(25)]
    rows += [None, "", " \n", "one two", "ONE  two", "one two three four five", "x" * 3000, "a b c d e f", "A b c d e f"]
    order = list(range(len(rows)))
    r.shuffle(order)
    rows = [(i * 3, rows[i]) for i in order]
    df = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = {x["doc_id"]: x for x in minhash_dedup.near_duplicates(df).collect()}
    want = brute(rows)
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (x["component_id"] == i) for i, x in got.items())


def test_missing_ids_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((str(x["doc_id"]), str(x["component_id"]), x["kept"]) for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u v"), (3, "p q r s t u v w"), (4, "x y z a b c d e f"), (4, "lone text of five words"), (5, "lone text of five words"), (0, None), (0, "lone text of five words")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["n_links"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # 1's second text and 3's share three of four shingles
    assert got == sorted([(1, 2, 1, True, 0), (1, 3, 1, True, 1), (3, 4, 1, False, 1), (4, 5, 4, True, 0), (4, 1, 0, False, 0), (5, 1, 0, False, 0), (0, 0, 0, True, 0), (0, 1, 0, True, 0)])


def test_one_row_of_each_component_stays(spark):
    rows = [(0, "a b c d e f", 1), (1, "A b c d e f", 1), (1, "like nothing else at all", 1), (2, "p q r s t u v w", 1), (2, "p q r s t u v w", 1), (2, "p q r s t u v w", 3), (3, "p q r s t u v w x", 1)]
    rows += [(4, None, 1), (4, None, 1), (5, "", 1), (None, "a b c d e f", 1), (6, "one word " * 400, 1), (7, "one word " * 400, 1), (8, "two texts of one number", 1), (8, "and they are quite unlike", 1)]
    got = [tuple(r) for r in minhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()]
    want = [(0, "a b c d e f", 1), (1, "like nothing else at all", 1), (2, "p q r s t u v w", 1), (4, None, 1), (4, None, 1), (5, "", 1), (None, "a b c d e f", 1), (6, "one word " * 400, 1), (8, "two texts of one number", 1), (8, "and they are quite unlike", 1)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert minhash_dedup.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_by_size_lose_no_link(spark, monkeypatch):
    """Texts around one long passage meet in few buckets; the hub of a bucket is like few of them."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    r = random.Random(9)
    passage = text(r, 90)
    rows = [(i, passage + " " + text(r, 3 * (i % 30))) for i in range(120)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_size_classes_keep_linked_sizes_together():
    for n in range(1, 4000):
        least, most = -(-3 * n // 4), 4 * n // 3
        of = lambda m: int(np.floor(np.log(m) * minhash_dedup.SIZE_STEP))
        assert of(n) - of(least) <= 1 and of(most) - of(n) <= 1


def test_sketches_agree_as_sets_resemble():
    r = np.random.default_rng(3)
    for n in (1, 3, 40, 2000):
        same = []
        for _ in range(20):
            both, a, b = (r.integers(0, 1 << 63, size=k, dtype=np.uint64) for k in (3 * n, n, n))
            x, y = similarity_sketch(np.unique(np.r_[both, a]), 240), similarity_sketch(np.unique(np.r_[both, b]), 240)
            assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
            same.append((x == y).mean())
        assert abs(np.mean(same) - 0.6) < 0.06


def test_block_intersections():
    r = np.random.default_rng(4)
    one, two = ([np.unique(r.integers(0, 300, size=60).astype(np.uint64)) for _ in range(k)] for k in (7, 5))
    want = [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert minhash_dedup.intersections(one, two).tolist() == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert {v for k, v in got.items() if k >= 100} == {100}


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(1)
    pool = [" ".join(f"Word{r.randrange(99)}" for _ in range(9)) for _ in range(12)] + ["É" * 40, "É" * 39, "é" * 40, "short", ""]
    rows = [(i, "\n".join(f"{r.choice(['', ' ', chr(9)])}{r.choice([str.upper, str])(r.choice(pool))}{r.choice(['', chr(13)])}" for _ in range(r.randrange(1, 7)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, pool[0]), (63, "z" * 5000)] + [(64 + i, "z" * 5000 + "\nend") for i in range(5)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, digests string")
    got = [(x["doc_id"], x["n_lines"], x["n_dropped"], x["kept"]) for x in line_dedup.drop_repeated(df).collect()]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=order) == sorted(brute_lines(rows), key=order)
    assert line_dedup.drop_repeated(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_both_ways_to_drop_lines(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "MAX_SENT", sent)
    hot = "\u00c9 line that a third of all documents hold, in any case"
    rows = [(i, f"{hot.upper() if i % 2 else hot}\nown {i}\r\n{'q' * 39}\n{'Q' * 40}\n") for i in range(30)] + [(None, hot), (3, hot), (40, None), (41, "\n" * 3)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, __id int, __digests string, kept int")
    got = line_dedup.drop_repeated(df)
    assert got.columns == ["doc_id", "text", "kept", "n_lines", "n_dropped"]
    want = sorted(map(repr, brute_lines(rows)))
    assert sorted(repr((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept"])) for x in got.collect()) == want


def test_a_saturated_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(line_dedup, "FAN_IN", 2)
    rows = [(i, f"{'shared line of text ' * 3}{i % 3}\n{'own line of this text ' * 3}{i}") for i in range(30)]
    got = [(x["doc_id"], x["n_lines"], x["n_dropped"], x["kept"]) for x in line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == brute_lines(rows) and hashlib.sha256(got[0][3].encode())



def test_filter_has_every_key_and_few_others(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "k")
    rows = spark.range(30_000).withColumn("hit", membership.may_be_in(keys, "k")("id"))
    assert rows.where("id % 3 = 0 and not hit").count() == 0
    assert rows.where("id % 3 <> 0 and hit").count() < 1_000
    assert rows.where(membership.may_be_in(keys.limit(0), "k")("id")).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, text(r, 40)) for i in range(30)]
    rows += [(100 + i, edited(r, rows[i][1], 1)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(x) for x in minhash_dedup.one_of_each(docs).collect())
    monkeypatch.setattr(membership, "positions", lambda key, bits: [F.lit(0).cast("long") * F.xxhash64(key)] * 3)
    assert sorted(tuple(x) for x in minhash_dedup.one_of_each(docs).collect()) == want


def test_texts_stay_in_place(spark):
    """Neither the sets nor the rows that stay are made by a shuffle of all texts, whatever sizes are sent whole."""
    r = random.Random(6)
    rows = [(i, text(r, 40)) for i in range(60)]
    rows += [(100 + i, edited(r, rows[i][1], 1)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash_dedup.one_of_each(docs)
        assert left.count() == 60
        plan = left._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.lstrip().startswith("Union")
