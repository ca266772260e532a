import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import fingerprint, ordering
from tessera.llm.queries import op10_fingerprint
from tessera.llm.shingles import shingle_hashes, shingle_set, words


def test_words_and_shingles():
    assert words("  A b\x0bC\xa0d É ") == [b"a", b"b", "c\xa0d".encode(), "É".encode()]
    assert words(None) == [] and len(shingle_hashes("")) == 0
    assert len(shingle_hashes("a b c")) == 1 and len(shingle_hashes("a b c d e f")) == 2
    assert shingle_hashes("a b c d e")[0] != shingle_hashes("a b c e d")[0]
    assert (shingle_set("A B c d E") == shingle_set("a b\nc  d e")).all()


def test_sketches_merge_and_estimate():
    r = random.Random(5)
    a = " ".join(str(r.randrange(10**6)) for _ in range(3000))
    b = a[: len(a) // 2] + " " + " ".join(str(r.randrange(10**6)) for _ in range(1500))
    x, y = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    both, union = len(np.intersect1d(shingle_set(a), shingle_set(b))), len(np.union1d(shingle_set(a), shingle_set(b)))
    assert abs(fingerprint.resemblance(x, y) - both / union) < 0.15
    assert abs(fingerprint.distinct(x) - len(shingle_set(a))) < 0.3 * len(shingle_set(a))
    assert (fingerprint.merge(x, y) == np.union1d(shingle_set(a), shingle_set(b))[: fingerprint.K]).all()
    assert fingerprint.containment(fingerprint.fingerprint("a b c d e f"), fingerprint.fingerprint("a b c d e f g h")) == 1.0


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("", "a", 0.0), ("a b c", "A  b c", 1.0), ("a b c d e f", "a b c d e g", 1 / 3)])
def test_small_texts_are_exact(a, b, want):
    assert fingerprint.resemblance(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) == pytest.approx(want)


def test_sketch_of_repeats():
    h = np.repeat(np.arange(200, dtype=np.uint64), 50)
    assert (fingerprint.sketch(h, 128) == np.arange(128)).all()


def test_merged_by_source(spark):
    df = spark.createDataFrame([("s", "a b c d e f"), ("s", "x y"), (None, "q"), ("t", None)], "source string, text string")
    got = {r["source"]: fingerprint.unpacked(r["fingerprint"]) for r in fingerprint.merged(fingerprint.with_fingerprints(df, {"text": "fingerprint"}), "source").collect()}
    assert (got["s"] == np.union1d(shingle_set("a b c d e f"), shingle_set("x y"))).all() and len(got["t"]) == 0 and len(got[None]) == 1


def test_next_in_order(spark):
    rows = [(i * 37 % 101, f"t{i}") for i in range(101)] + [(None, "none"), (500, "b"), (500, "a")]
    got = ordering.with_next(spark.createDataFrame(rows, "k long, v string"), "k", "v", "n").collect()
    want = [v for _, v in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1]))]
    assert sorted((r["v"], r["n"]) for r in got) == sorted(zip(want, want[1:] + want[:1]))
    one = ordering.with_next(spark.createDataFrame([(1, "x")], "k long, v string"), "k", "v", "n").collect()
    assert [r["n"] for r in one] == ["x"]
    assert ordering.with_next(spark.createDataFrame([], "k long, v string"), "k", "v", "n").count() == 0


def test_query(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in op10_fingerprint(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        x, y, z = map(fingerprint.fingerprint, (t, edited, following))
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.packed(x).hex() and r["edited_fingerprint"] == fingerprint.packed(y).hex()
        assert r["near_edited"] == pytest.approx(fingerprint.resemblance(x, y)) and r["near_next"] == pytest.approx(fingerprint.resemblance(x, z))


def plain_shingles(text):
    """Five-word shingles as strings, without the library's words or hashes."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_query_against_sets_of_strings(spark, sf):
    """Likeness and size are exact where both sets fit into the sketch, and within five deviations else."""
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in op10_fingerprint(spark, sf).collect()}
    prints, exact = {}, 0
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        own, r = plain_shingles(t), rows[d]
        for other, near in ((plain_shingles(t[: len(t) - half] + following[:half]), r["near_edited"]), (plain_shingles(following), r["near_next"])):
            want = len(own & other) / len(own | other) if own | other else 1.0
            small = max(len(own), len(other)) <= fingerprint.K
            exact += small
            assert near == pytest.approx(want, abs=1e-9 if small and len(own | other) <= fingerprint.K else 5 * 0.5 / fingerprint.K**0.5), d
        assert r["n_distinct"] == pytest.approx(len(own), rel=0 if len(own) < fingerprint.K else 5 / fingerprint.K**0.5), d
        prints.setdefault(frozenset(own), set()).add(r["fingerprint"])
    assert exact > 20 and all(len(p) == 1 for p in prints.values())
    assert len({p for ps in prints.values() for p in ps}) == len(prints)
