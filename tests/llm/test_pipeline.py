import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import quality, source_mix  # noqa: E402
from tessera.llm.queries import target_weight  # noqa: E402
from tests.llm.test_dedup import brute, brute_lines  # noqa: E402
from tests.llm.test_source_mix import check  # noqa: E402


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "source_mix", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    one = stage["quality"](spark, docs, sf)
    assert one.columns == docs.columns and one.dtypes == docs.dtypes
    first = sorted(one.collect(), key=lambda r: r["doc_id"])
    kept = {r["doc_id"] for r in quality.resampled(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert [r["doc_id"] for r in first] == sorted(kept) and all(r == rows[r["doc_id"]] for r in first)

    two = stage["line_dedup"](spark, one, sf)
    assert two.columns == docs.columns and two.dtypes == docs.dtypes
    second = {r["doc_id"]: r for r in two.collect()}
    want = brute_lines([(r["doc_id"], r["text"]) for r in first])
    assert {i: (r["text"], r["n_chars"]) for i, r in second.items()} == {i: (t, len(t)) for i, _, _, t in want}

    three = stage["near_dedup"](spark, two, sf)
    assert three.columns == docs.columns
    third = {r["doc_id"]: r for r in three.collect()}
    groups = brute([(i, r["text"]) for i, r in second.items()])
    assert third == {i: r for i, r in second.items() if groups[i][1] == i}

    four = stage["source_mix"](spark, three, sf)
    assert four.columns == docs.columns
    order = [r["doc_id"] for r in four.collect()]
    mixed = source_mix.mixed(three, target_weight).collect()
    check(mixed, {r["source"]: target_weight(r["source"]) for r in mixed})
    mix = {r["doc_id"]: r["position"] for r in mixed}
    assert sorted(order) == sorted(third) and order == sorted(order, key=mix.__getitem__)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stage["bpe"](spark, four, sf).collect():
        ids = library.encode(third[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_what_the_stages_leave(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert 0 < got.count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_run_tells_the_place_in_the_mix(spark, sf):
    got = corpus_pipeline.run(spark, sf).select("doc_id", "source", "slot", "position").collect()
    check(got, {r["source"]: target_weight(r["source"]) for r in got})


def test_stages_on_odd_rows(spark, sf):
    line = "a line that is long enough to count and that six documents hold"
    texts = [None, "", "  ", "x" * 20_000, "word " * 9_000] + [f"{line}\nown words of document number {i} here" for i in range(6)]
    rows = [(i, t, "en", None if i % 3 else "s", None, "extra", "k") for i, t in enumerate(texts)]
    rows += [rows[6], (6, "another text under an id that repeats", "en", "s", 1, "extra", "k"), (None, line, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, kept string")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality":  # its labels are of other documents
            docs = stage(spark, docs, sf)
            seen[name] = docs.collect()
            if name != "bpe":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "kept"]
    assert len(seen["line_dedup"]) == len(rows)
    kept = sorted((r["doc_id"], r["text"]) for r in seen["line_dedup"] if r["doc_id"] is not None and r["doc_id"] >= 5)
    assert [t for i, t in kept if i == 10] == [texts[10]] and all(line not in t for i, t in kept if i < 10)
    assert len(seen["near_dedup"]) == len(rows) - 1
    assert sorted(map(repr, seen["source_mix"])) == sorted(map(repr, seen["near_dedup"]))
    assert len(seen["bpe"]) == len(rows) - 1 and len({r["position"] for r in seen["bpe"]}) == len(rows) - 1
    assert {r["n_tokens"] for r in seen["bpe"] if r["doc_id"] in (0, 1, 2)} == {0}
    quality_kept = corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, kept string"), sf)
    assert quality_kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "kept"] and quality_kept.count() <= len(rows)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
