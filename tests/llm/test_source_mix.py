import random
from collections import Counter
from fractions import Fraction

import pytest

from tessera.llm import source_mix
from tessera.llm.queries import op5_source_mix, target_weight


def follows(order, weights):
    """Whether a list of sources, one a slot, keeps within one block of the exact weights until sources are used up, phase by phase."""
    left, t0 = Counter(order), 0
    while t0 < len(order):
        live = {s: Fraction(weights.get(s, 1)) for s in left if left[s] and weights.get(s, 1) > 0} or {s: Fraction(1) for s in left if left[s]}
        whole = sum(live.values())
        end = min(left[s] * whole / w for s, w in live.items()) // 1
        had = dict.fromkeys(live, 0)
        for t in range(1, end + 1):
            had[order[t0 + t - 1]] += 1
            if any(abs(t * w / whole - had[s]) >= 1 for s, w in live.items()):
                return False
        for s in live:
            left[s] -= had[s]
        t0 += end
    return not any(left.values())


def in_order(plan):
    rows = [x for p in plan for k in range(p.windows) for x in p.scheduled(k)]
    assert sorted(t for _, _, t in rows) == list(range(len(rows)))
    seen = Counter()
    for s, block, _ in sorted(rows, key=lambda x: x[2]):
        assert block == seen[s]
        seen[s] += 1
    return [s for s, _, _ in sorted(rows, key=lambda x: x[2])], seen


@pytest.mark.parametrize("seed", range(40))
def test_schedule_keeps_within_a_block(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(source_mix, "MIN_WINDOW", r.choice([1, 7, 50, 4096]))
    n = r.randint(1, 12)
    weights = {f"s{i}": Fraction(r.choice([r.random() + 0.001, r.randint(1, 9), 0.1, Fraction(1, 3)])) for i in range(n)}
    if seed % 3 == 0:  # shares that often come out even
        weights = {s: Fraction(r.randint(1, 9)) for s in weights}
    blocks = {s: r.randint(1, 300) for s in weights}
    order, seen = in_order(source_mix.phases(blocks, weights))
    assert seen == blocks and follows(order, weights)


def test_a_rare_source_gets_its_share_and_no_more():
    weights = {"a": Fraction("0.999"), "b": Fraction("0.001")}
    order, _ = in_order(source_mix.phases({"a": 9000, "b": 500}, weights))
    assert follows(order, weights) and order[:3000].count("b") in (2, 3, 4)
    with pytest.raises(ValueError):
        source_mix.phases({"a": 5, "b": 5}, {"a": Fraction(1), "b": Fraction(1, 10**9)})


def check(rows, weights):
    """Positions are distinct, blocks are whole, and the slots follow the weights."""
    assert len({r["position"] for r in rows}) == len(rows)
    blocks = {}
    for r in rows:
        blocks.setdefault(r["slot"], set()).add(r["source"])
    assert sorted(blocks) == list(range(len(blocks))) and all(len(s) == 1 for s in blocks.values())
    assert follows([next(iter(blocks[i])) for i in range(len(blocks))], weights)


def test_mix_keeps_all_rows(spark):
    rows = [(i, ["hot", "a", "b", None][0 if i % 3 else i // 3 % 4], i) for i in range(900)] + [(5, "a", 0), (None, "a", 0)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, source string, slot long, __range string")
    got = source_mix.mixed(df, {"hot": 3, "b": 0.5}, block_docs=4).collect()
    assert sorted(map(str, ((r["doc_id"], r["source"]) for r in got))) == sorted(map(str, ((a, b) for a, b, _ in rows)))
    check([r.asDict() | {"source": source_mix.NO_SOURCE if r["source"] is None else r["source"]} for r in got], {"hot": 3, "b": 0.5})
    plain = df.drop("__range")
    laid = source_mix.laid_out(source_mix.mixed(plain, {"hot": 3, "b": 0.5}, block_docs=4), plain.columns)
    assert laid.columns == plain.columns and laid.count() == len(rows)


def test_ranges_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "RANKED_TOGETHER", 50)
    df = spark.createDataFrame([(i, "hot" if i % 4 else "b") for i in range(2000)], "doc_id long, source string")
    check(source_mix.mixed(df, {"hot": 0.7, "b": 0.3}, block_docs=8).collect(), {"hot": 0.7, "b": 0.3})


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "MAX_SOURCES", 3)
    with pytest.raises(ValueError):
        source_mix.mixed(spark.range(8).selectExpr("id as doc_id", "cast(id as string) as source"))


def test_weights_of_zero_come_last_and_empty_table(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(64)], "doc_id long, source string")
    got = source_mix.mixed(df, {"a": 0}, block_docs=4).collect()
    assert max(r["slot"] for r in got if r["source"] == "b") < min(r["slot"] for r in got if r["source"] == "a")
    assert source_mix.mixed(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = op5_source_mix(spark, sf).collect()
    weights = {r["source"]: target_weight(r["source"]) for r in rows}
    assert len(set(weights.values())) > 3
    check(rows, weights)
