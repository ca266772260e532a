"""Renames against a walk of each path."""

import random

from tessera.operators import history


def walk(path, seq, renames):
    moves = {}
    for at, old, new in renames:
        if None not in (at, old, new):
            moves[old, at] = max(new, moves.get((old, at), ""))
    while path is not None and seq is not None:
        before = [at for old, at in moves if old == path and at < seq]
        if not before:
            break
        seq = max(before)
        path = moves[path, seq]
    return path


def run(spark, paths, renames, blocks):
    df = history.resolve_renames(spark.createDataFrame(paths, "seq long, path string"), spark.createDataFrame(renames, "seq long, old string, new string"), blocks)
    return sorted(map(repr, map(tuple, df.collect())))


def test_random_renames_with_a_hot_path(spark):
    r = random.Random(4)
    name = lambda: "hot" if r.random() < 0.4 else f"p{r.randrange(6)}"
    renames = [(r.randrange(60), name(), name()) for _ in range(120)] + [(None, "hot", "x"), (3, None, "y"), (4, "z", None)]
    paths = [(r.randrange(70), name()) for _ in range(60)] + [(None, "hot"), (5, None), (9, "other"), (9, "other")]
    want = sorted(repr((s, p, walk(p, s, renames))) for s, p in paths)
    for blocks in (1, 7, 64):
        assert run(spark, paths, renames, blocks) == want


def test_a_long_chain(spark):
    n = 300
    renames = [(n - i, f"p{i}", f"p{i + 1}") for i in range(n)]
    assert run(spark, [(n + 1, "p0"), (n // 2 + 1, f"p{n // 2}"), (0, "p0")], renames, 8) == sorted(map(repr, [(n + 1, "p0", f"p{n}"), (n // 2 + 1, f"p{n // 2}", f"p{n}"), (0, "p0", "p0")]))
    assert run(spark, [(1, "a")], [], 8) == [repr((1, "a", "a"))]


def test_settled_renames_take_no_part_in_rounds(spark, monkeypatch):
    rows, kept = [], history.cut

    def counted(df, label="step"):
        out = kept(df, label)
        if label == "hops":
            rows.append(out.count())
        return out

    monkeypatch.setattr(history, "cut", counted)
    renames = [(i, f"p{i}", f"q{i}") for i in range(90)] + [(9 - i, f"c{i}", f"c{i + 1}") for i in range(9)]
    assert run(spark, [(100, "c0"), (100, "p5")], renames, 4) == sorted(map(repr, [(100, "c0", "c9"), (100, "p5", "q5")]))
    assert rows[0] == 99 and len(rows) > 2 and max(rows[1:]) <= 8
