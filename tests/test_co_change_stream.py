import random
from collections import Counter
from itertools import combinations

import pytest

from tessera.operators import history
from tessera.streaming import co_change

COMMIT = "seq long, hash string, date string, message string, files array<string>, body string"


def published(spark, folder, number, rows):
    spark.createDataFrame([(i, h, "2026-01-01", "m", f, "") for i, (h, f) in enumerate(rows)], COMMIT).coalesce(1).write.parquet(f"{folder}/in/batch={number}")


def run(spark, folder, **how):
    stream = spark.readStream.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = co_change.start(stream, f"{folder}/out", f"{folder}/state", **how)
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None


def by_hand(rows, max_files=100, least=3):
    """Pairs of all distinct commits, counted in memory."""
    seen, totals, together = set(), Counter(), Counter()
    for h, files in rows:
        if h is None or h in seen or files is None or len(files) > max_files:
            continue
        seen.add(h)
        kept = sorted({f for f in files if f and f.lower().endswith((".cs", ".ts"))})
        totals.update(kept)
        together.update(combinations(kept, 2))
    return sorted((a, b, n, totals[a], totals[b]) for (a, b), n in together.items() if n >= least)


def result(spark, folder):
    return sorted((r["fileA"], r["fileB"], r["together"], r["totalA"], r["totalB"]) for r in co_change.co_change(spark, f"{folder}/out").collect())


def test_equals_the_batch_after_every_batch(spark, tmp_path):
    rng, all_rows = random.Random(7), []
    for number in range(4):
        rows = [(f"h{number}-{i}", rng.sample([f"f{k}.cs" for k in range(6)] + ["x.TS", "n.md"], rng.randint(0, 4))) for i in range(30)]
        rows += rng.sample(all_rows, min(10, len(all_rows)))  # published again in a later batch
        rows += rows[:5]  # and twice in one
        rows += [(None, ["f0.cs", "f1.cs"]), (f"noise{number}", [f"y{k}.cs" for k in range(101)]), (f"none{number}", None)]
        published(spark, tmp_path, number, rows)
        all_rows += rows
        run(spark, tmp_path, fold_after=2)
        got = result(spark, tmp_path)
        assert got == by_hand(all_rows) and got
    known = spark.createDataFrame([(0, h, "", "", f, "") for h, f in all_rows if h], COMMIT).dropDuplicates(["hash"])
    batch = sorted(map(tuple, history.co_change(known).collect()))
    assert sorted(map(tuple, co_change.co_change(spark, f"{tmp_path}/out").collect())) == batch
    before = result(spark, tmp_path)
    assert co_change.expire(spark, f"{tmp_path}/out") > 0 and result(spark, tmp_path) == before


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    published(spark, tmp_path, 0, [(f"h{i}", ["a.cs", "b.cs"]) for i in range(3)])
    run(spark, tmp_path)
    delta = co_change.written(spark, f"{tmp_path}/out", "delta")[0]
    again = spark.read.parquet(f"{tmp_path}/out/delta/epoch={delta}").collect()
    spark.createDataFrame(again, co_change.SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/out/delta/epoch={delta}")
    run(spark, tmp_path)  # nothing new
    assert result(spark, tmp_path) == [("a.cs", "b.cs", 3, 3, 3)]


@pytest.mark.parametrize("rows", [[], [("h", [])], [("h", None)], [(None, ["a.cs", "b.cs"])]])
def test_nothing_to_count(spark, tmp_path, rows):
    published(spark, tmp_path, 0, rows)
    run(spark, tmp_path)
    assert result(spark, tmp_path) == []
    assert co_change.counts(spark, f"{tmp_path}/none").columns == ["fileA", "fileB", "together"]


def test_half_written_deltas_are_not_read(spark, tmp_path):
    published(spark, tmp_path, 0, [(f"h{i}", ["a.cs", "b.cs"]) for i in range(3)])
    run(spark, tmp_path)
    broken = tmp_path / "out" / "delta" / "epoch=9"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert result(spark, tmp_path) == [("a.cs", "b.cs", 3, 3, 3)]
