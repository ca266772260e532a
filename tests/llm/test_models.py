import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import quality, toxicity
from tessera.llm.queries import op6_quality_resample, op7_toxicity_knn
from tessera.llm.shingles import shingle_hashes


def test_buckets():
    assert len(quality.ngram_buckets(None)) == 0 and len(quality.ngram_buckets("a b!")) == 5
    assert (quality.ngram_buckets("A b") == quality.ngram_buckets("a B")).all()
    assert quality.ngram_buckets("x x")[2] == quality.ngram_buckets("y y")[2]


@pytest.mark.parametrize("k", [1, 2, 7, 50, 100])
def test_kth_largest(spark, k):
    r = np.random.default_rng(k)
    keys = [int(x) for x in r.integers(0, 1 << 54, 60)] + [5] * 40
    df = spark.createDataFrame([(x,) for x in keys], "key long")
    assert quality.kth_largest(df, "key", k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, "key", 101) is None


def test_best_cut():
    assert quality.best_cut([(1.0, 1), (2.0, 1)]) is None
    assert quality.best_cut([(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 1)]) == 1.5


def test_resampling_by_hand(spark):
    good = [(i, f"calm words of plain prose number {i} go on and on here") for i in range(60)]
    bad = [(100 + i, f"%%% BUY ### now {i} !!! $$$ ### %%% !!! ### click") for i in range(20)]
    rows = good + bad + [(300, None), (301, ""), (None, "calm words of plain prose go on"), (0, good[0][1])]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, kept int, log_weight double")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 20, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.resampled(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & {100 + i for i in range(20)} and len(kept & set(range(60))) >= 58
    assert {r["log_weight"] for r in got if r["doc_id"] in (300, 301)} == {0.0}
    weights = [r["log_weight"] for r in got if r["doc_id"] == 0]
    assert len(weights) == 2 and weights[0] == weights[1]
    cut = quality.best_cut([(r["log_weight"], 1 if r["doc_id"] < 60 else 0) for r in got if r["doc_id"] is not None and (r["doc_id"] < 60 or 100 <= r["doc_id"] < 200) and r["doc_id"] % 2 == 0])
    assert sum(r["kept"] for r in got) == sum(r["log_weight"] >= cut for r in got)
    top = sorted((r["sort_key"] for r in got), reverse=True)[: sum(r["kept"] for r in got)]
    assert min(top) == min(r["sort_key"] for r in got if r["kept"])


def test_resampling_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in quality.resampled(docs, none).collect()] == [True, True]
    assert quality.resampled(docs.limit(0), none).count() == 0


def test_quality_query_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = op6_quality_resample(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    good, bad = n.get((1, True), 0), n.get((0, False), 0)
    assert good / (good + n.get((1, False), 0)) > 0.97 and bad / (bad + n.get((0, True), 0)) > 0.9


def brute_resampled(texts, good, noise):
    """(log weight, kept) of texts (by id) from labels of some, with dictionaries: no arrays, digits or cuts of the library."""
    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        pairs = [0xA0761D6478BD642F if a == b else mix((a * 0x9E3779B97F4A7C15 + b) & full) for a, b in zip(h, h[1:])]
        return [x % 65536 for x in h + pairs]

    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if good.get(i) == 1:
            target.update(grams(t))
    def weight_by(target, i):
        size, raws = sum(target.values()) + 65536, sum(raw.values()) + 65536
        return math.fsum(math.log((target[b] + 1) / size) - math.log((raw[b] + 1) / raws) for b in grams(texts[i]))

    weight = {i: weight_by(target, i) for i in texts}
    known = sorted((weight_by(target - Counter(grams(texts[i])), i) if y else weight[i], y) for i, y in good.items())
    n = Counter(y for _, y in known)
    # of all places between two labelled weights the one that tells the labels apart best, the lowest of equals
    gain = lambda at: sum(y for _, y in known[at:]) / n[1] + sum(1 - y for _, y in known[:at]) / n[0]
    at = max(range(len(known) + 1), key=lambda a: (round(gain(a), 9), -a))
    cut = (known[at - 1][0] + known[at][0]) / 2
    k = sum(w >= cut for w in weight.values())
    keys = {i: round((w + noise[i]) * (1 << 20)) for i, w in weight.items()}
    least = sorted(keys.values(), reverse=True)[k - 1]
    return {i: (weight[i], keys[i] >= least) for i in texts}


def test_quality_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in texts}
    u = spark.createDataFrame([(i,) for i in texts], "i long").selectExpr("i", "(pmod(xxhash64(i, 42), 1099511627776) + 0.5D) / 1099511627776D AS u").collect()
    want = brute_resampled(texts, good, {r["i"]: -math.log(-math.log(r["u"])) for r in u})
    got = {r["doc_id"]: r for r in op6_quality_resample(spark, sf).collect()}
    assert got.keys() == want.keys() and 0 < sum(kept for _, kept in want.values()) < len(want)
    assert max(abs(got[i]["log_weight"] - w) for i, (w, _) in want.items()) < 1e-6
    assert {i for i in got if got[i]["kept"]} == {i for i, (_, kept) in want.items() if kept}


def test_quality_on_labels_that_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    rest = labels.where("crc32(cast(doc_id as string)) % 2 = 1")
    found = quality.resampled(docs, half, keep_text=False).join(rest, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[1, True] >= 0.93 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.97 * (n[0, False] + n.get((0, True), 0))


def brute_votes(mine, others, k):
    """(cosine, number) of the k nearest others and what ties, by dictionaries."""
    cos = sorted(((round(sum(v * o.get(w, 0.0) for w, v in mine.items()), 10), j) for j, o in others.items()), reverse=True)
    cos = [c for c in cos if c[0] > 0]
    return [c for c in cos if len(cos) <= k or c[0] >= cos[k - 1][0]]


def test_index_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    r = np.random.default_rng(0)
    rows = []
    for i in range(900):
        # a few common terms, in two groups, and many rare ones
        t = np.unique(np.concatenate([r.integers(0, 6, r.integers(0, 5)) + 6 * (i % 2), r.integers(12, 400, r.integers(1, 8))]))
        w = r.random(len(t)) + 0.1
        rows.append((t, w / np.sqrt((w * w).sum())))
    rows[7] = rows[3]
    ends = np.cumsum([0, *(len(t) for t, _ in rows)])
    digests = np.arange(900)
    index = toxicity.BlockMaxIndex(list(range(900)), np.arange(900) % 3 // 2, digests, ends, np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows]), 400)
    assert index.matrix.shape[1] > 0 and index.blocks > 50
    own = np.arange(0, 900, 37)
    text = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
    got = index.nearest(digests[own], text, np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]), 25)
    for i, (at, cos) in zip(own, got):
        mine = dict(zip(rows[i][0].tolist(), rows[i][1].tolist()))
        want = brute_votes(mine, {j: dict(zip(t.tolist(), w.tolist())) for j, (t, w) in enumerate(rows) if j != i}, 25)
        assert np.allclose(cos, [c for c, _ in want], atol=1e-9) and {index.ids[a] for a in at} == {j for _, j in want}


def brute_scores(texts, toxic):
    """Scores of texts (by number) from labels of some of them, without an index, arrays or Spark."""
    held = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in texts.items()}
    begin = lambda w: {w[:n] + "-" for n in (4, 5, 6) if len(w) >= n}
    base = sum(toxic.values()) / len(toxic)
    firsts = {}
    for i in sorted(toxic):
        h = shingle_hashes(texts[i])
        firsts.setdefault((toxic[i], int(h.min().view(np.int64)) if len(h) else 0), i)
    counts = (Counter(), Counter())
    n = Counter(y for y, _ in firsts)
    for (y, _), i in firsts.items():
        counts[y].update({x for w in held[i] for x in {w, *begin(w)}})
    tested = [w for w, k in counts[1].items() if k >= 3]
    passed = set()
    for w in tested:
        t, c = counts[1][w], counts[0][w]
        share = (t + c) / (n[0] + n[1])
        ratio = 2 * sum(x * math.log(x / (share * m)) for x, m in ((t, n[1]), (c, n[0])) if x)
        if ratio >= max(12, 2 * math.log(max(1, len(tested)))) and (t / n[1]) / ((c + 0.5) / n[0]) >= 3:
            passed.add(w)
    known = {w for i in toxic for w in held[i]} | passed
    terms = {i: Counter() for i in texts}
    for i in texts:
        for w, k in held[i].items():
            for x in {w} & known | begin(w) & passed:
                terms[i][x] += k
    df = Counter(x for i in texts for x in terms[i])
    weight = {x: (math.log((1 + len(texts)) / (1 + df[x])) + 1) * (8 if x in passed else 1) for x in known}
    units = {}
    for i in texts:
        v = {x: k * weight[x] for x, k in terms[i].items()}
        size = math.sqrt(sum(a * a for a in v.values()))
        units[i] = {x: a / size for x, a in v.items()}

    def share(i):
        found = [(c**3, toxic[j]) for c, j in brute_votes(units[i], {j: units[j] for j in toxic if (texts[j] or "") != (texts[i] or "")}, 25)]
        return sum(w * y for w, y in found) / sum(w for w, _ in found) if found else None

    shares = {i: share(i) for i in texts}
    pairs = sorted((shares[i], toxic[i]) for i in toxic if shares[i] is not None)
    xs = sorted({x for x, _ in pairs})
    by = {x: [y for a, y in pairs if a == x] for x in xs}
    mean = lambda a, b: sum(sum(by[x]) for x in xs[a : b + 1]) / sum(len(by[x]) for x in xs[a : b + 1])
    # the isotonic fit by its min-max formula
    fit = [max(min(mean(a, b) for b in range(j, len(xs))) for a in range(j + 1)) for j in range(len(xs))]
    return {i: base if s is None else float(np.interp(s, xs, fit)) for i, s in shares.items()}


def test_scores_against_brute_force(spark):
    r = np.random.default_rng(3)
    texts = {i: " ".join(f"w{x}" for x in r.zipf(1.5, r.integers(3, 40)) % 300) + (f" vexling{i % 4}" if i % 6 == 0 else "") for i in range(150)}
    texts |= {300: "thou grumbling sporkhead begone", 302: "sporkhead", 303: texts[17], 304: texts[12], 305: None, 306: "", 307: "nothing known"}
    toxic = {i: int(i % 6 == 0 or i == 300) for i in [*range(110), 300]}
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, score int, digest int")
    labels = spark.createDataFrame([*toxic.items(), (17, 0), (None, 1), (5, None), (9999, 0)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.scores(docs, labels).collect()}
    want = brute_scores(texts, toxic)
    base = sum(toxic.values()) / (len(toxic) + 1)
    assert got.keys() == texts.keys()
    for i in (305, 306, 307):
        assert got[i]["score"] == base and got[i]["evidence"] == []
    # a label without a document counts in the base rate and the votes' worth alone
    assert max(abs(got[i]["score"] - want[i]) for i in texts if i < 305) < 0.02
    assert got[303]["score"] == got[17]["score"] and got[304]["score"] == got[12]["score"] > 0.3
    assert all(e["label"] in (0, 1) and 0 < e["cosine"] <= 1 and texts[e["example"]] != texts[i] for i in texts for e in got[i]["evidence"])


def test_toxicity_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not held_out[r["doc_id"]]}
    got = {r["doc_id"]: r for r in op7_toxicity_knn(spark, sf).collect()}
    want = brute_scores(texts, toxic)
    assert got.keys() == texts.keys() and {i: r["held_out"] for i, r in got.items()} == held_out
    assert max(abs(got[i]["score"] - want[i]) for i in texts) < 1e-6
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([3.0, 1.0, 2.0, 2.0, 5.0]), np.array([0.0, 0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0, 2.0]))
    assert x.tolist() == [1, 2, 3, 5] and np.allclose(y, [0, 1 / 3, 1 / 3, 1])


def test_scores_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scores(docs, none).collect()] == [0.0, 0.0]
    assert [r["score"] for r in toxicity.scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect()] == [1.0, 1.0]
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.scores(docs.limit(0), both).count() == 0
    named = spark.createDataFrame([("x", "a b"), ("y", "b c"), ("x", "c d")], "doc_id string, text string")
    assert toxicity.scores(named, spark.createDataFrame([("x", 1), ("y", 0)], "doc_id string, toxic int")).count() == 3


def test_toxicity_query_held_out_and_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    rows = op7_toxicity_knn(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in hit) >= 0.9 * len(hit)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    for lo, hi in ((0, 0.3), (0.3, 1.01)):
        part = [r for r in rows if lo <= r["score"] < hi]
        assert abs(np.mean([r["score"] for r in part]) - np.mean([r["toxic"] for r in part])) < 0.05


def test_resampling_writes_no_text(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of many words " * 3) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "materialise", lambda df, label="": (seen.append(df.columns), df)[1])
    got = quality.resampled(docs, labels)
    assert got.count() == 20 and "text" in got.columns
    assert seen and all("text" not in c for c in seen)
