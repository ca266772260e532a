import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import collocations, queries
from tests.oracle import differences

SEPARATORS = re.compile(r"[.,;:!?\x0A-\x0D]")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, words, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every piece."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        for piece in SEPARATORS.split((text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    gone = set()
    for (lang, *q), a in candidates.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                inner = (lang, *q[i : i + k])
                if inner in candidates and 100 * a >= 100 * candidates[inner]:
                    gone.add(inner)
    out = []
    for p, a in candidates.items():
        if p not in gone:
            lang, *w = p
            cuts = []
            for k in range(1, len(w)):
                l, r = counts[(lang, *w[:k])], counts[(lang, *w[k:])]  # noqa: E741
                cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
            s, _, l, r = min(cuts)  # noqa: E741
            out.append((lang, " ".join(w), a, l, r, n[lang], s))
    found = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        found += [(lang, i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(found)


def odd_rows():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma", "DELTA", "é", "Éa", "日本", "x\x85y", "a-b", "\xa0"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary[: 5 + i % 45]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", " \x0b "]) for w in words)
        rows.append((i % 90 if i % 7 else None, rng.choice(["en", "de", None, "und"]), text, "x"))
    rows += [(1, "en", None, None), (2, "en", "", None), (3, None, " .\n", None), (4, "fr", "only once", None), (5, "en", "a a a a a a a a " * 30, None), (6, "de", "new york city " * 2000, "y"), *[rows[5]] * 40]
    return rows


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string").repartition(3)
    return sorted(map(tuple, collocations.collocations(df, **settings).collect()))


def test_against_brute_force(spark):
    rows = odd_rows()
    for least, top in ((4, 2000), (10, 15)):
        want = brute([(r[1], r[2]) for r in rows], least, 5, top)
        assert len(want) > 20 and run(spark, rows, least=least, top=top) == want


def test_small_shards_change_nothing(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string").coalesce(1)
    # the function goes to the tasks by value of its module's names, so a copy of the module's constant is set there
    held = collocations.materialise(collocations.shards(df, "text", "lang"), "shards")
    whole = collocations.unpacked(held.first()["ids"], held.first()["size"])
    parts = list(collocations.cut_at_marks(whole, 50))
    assert len(parts) > 3 and all(p[-1] == 0 for p in parts) and np.concatenate(parts).tolist() == whole.tolist()
    assert run(spark, rows, least=4, top=50) == sorted(map(tuple, collocations.collocations(df.repartition(16), least=4, top=50).collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(2, 5))
def test_intervals_are_counts(ids, depth):
    ids = np.array([*ids, 0], np.int32)
    first, step = collocations.index(ids, depth)
    low, size = collocations.intervals(first)
    names = [(int(first[x]),) for x in low]
    text = ids.tolist()
    for k in range(2, depth + 1):
        low, size, left, right, step = collocations.extended(step, low, size)
        assert all(names[a][1:] == names[b][:-1] for a, b in zip(left.tolist(), right.tolist()))
        names = [names[a] + names[b][-1:] for a, b in zip(left.tolist(), right.tolist())]
        want = Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
        assert dict(zip(names, size.tolist())) == dict(want) and len(names) == len(want)


@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=50))
def test_packing(a):
    a = np.array(a, np.int32)
    assert collocations.unpacked(collocations.packed(a), len(a)).tolist() == a.tolist()


def test_many_numbers_sort_in_passes():
    rng = np.random.default_rng(5)
    for top in (3, 5000, 1 << 22, 1 << 30):
        ids = np.append(rng.integers(0, top, 3000), 0).astype(np.int32)
        ids[rng.integers(0, 3000, 300)] = ids[0]
        text = [*ids.tolist(), 0, 0, 0, 0]
        rows = collocations.suffix_rows(ids, 5).tolist()
        assert rows == sorted(rows, key=lambda i: (text[i : i + 5], i))


def test_scores_are_exact(spark):
    rows = [(9_999_999_999_999, 30_000_000_000_001, 10_000_000_000_007, 12_345_678_901_234), (100, 10**13, 100, 100), (7, 10**15 + 1, 7, 11)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(*(df[c] for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_empty_tables(spark):
    for rows in ([], [(1, "en", "", None)], [(1, "en", "too few words", None)]):
        assert run(spark, rows) == []


def test_query_with_a_lower_bound_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], 8, 5, 2000)
    assert len(want) > 100 and sorted(map(tuple, collocations.collocations(docs, least=8).collect())) == want


def test_query_equals_its_oracle_where_phrases_are_frequent(spark):
    rows, ours, theirs = differences(spark, "/root/testdata/sf0.01", queries.op13_collocations, queries.OP13_SQL)
    assert rows > 20 and ours == theirs == []


def test_intervals_are_taken_in_any_order(spark):
    """All rows of a shard are in frequent intervals, which come in descending order."""
    ids = np.array([*[1] * 9, 2, 1, 2, 1, 1, 2, 0], np.int32)
    step = collocations.index(ids, 5)[1]
    low, size, _, _, step = collocations.extended(step, *collocations.intervals(collocations.index(ids, 5)[0]))
    assert size.sum() == len(step)
    steps = spark.createDataFrame([(3, len(step), bytearray(collocations.packed(np.diff(step, prepend=0))))], "shard long, rows long, step binary")
    known = [(a, s, i) for i, (a, s) in reversed(list(enumerate(zip(low.tolist(), size.tolist()))))]
    frequent = spark.createDataFrame([(3, known)], "shard long, known array<struct<at: int, size: int, id: long>>")
    found = collocations.deeper(steps, frequent).where("step is null").select("size", "left", "right").collect()
    pairs = [tuple(ids[i : i + 2]) for i in range(len(ids) - 2)]
    number = {p: i for i, p in enumerate(sorted({p for p in pairs if 0 not in p}))}
    want = Counter((number[a], number[b]) for a, b in zip(pairs, pairs[1:]) if 0 not in a + b)
    assert {(r["left"], r["right"]): r["size"] for r in found} == want and len(found) == len(want)


def test_a_shard_is_gathered_in_few_bytes():
    g = collocations.Gathering()
    texts = [f"a b w{i}. c" for i in range(70_000)]
    for t in texts[:60_000]:
        g.add(t)
    assert g.size == 6 * 60_000 and sum(p.nbytes for p in g.parts) == 2 * g.size
    for t in texts[60_000:]:
        g.add(t)
    words = list(g.number)
    got = g.taken()
    assert got.dtype == np.int32 and not g.parts and [words[i] for i in got] == [w for t in texts for w in [*collocations.words_and_marks(t), b"\xff"]]
    number = np.random.default_rng(1).permutation(len(words)).astype(np.int32)
    want, at = number[got], got
    assert collocations.renumbered(got, number) is at and (got == want).all()
