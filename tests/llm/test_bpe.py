import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.queries import op9_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "Hello, WORLD!! it's don't", "<|endoftext|>a <|startoftext|>", "éÉ é naïve ñandú straße", "日本語 テスト", "İΣΣ Σa", "a" * 5000, "x\x00y", "😀👩‍👩 ok", "12 3½", "a\x1cb c\x1d d", "x\x85y\xa0z\u3000w", "a'll re've x's", "ab" * 400, "AΣ ΑΣ", "<|endoftext", "hello, world!! it's don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        ids, text = expected(library, r["text"])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == text


def test_cuts_are_certain():
    model = bpe.WordBpe(open(PATH, encoding="utf-8").read())
    for word in ("qzx", "日本", "wvvq"):
        parts = model.fragments(word)
        assert all((a[-1], b[0]) not in model.inside for a, b in zip(parts, parts[1:]))
        whole = [p for f in parts for p in f]
        ids = lambda x: model._merge(list(x), [model.ranks.get(p, model.never) for p in zip(x, x[1:])])
        assert b"".join(map(ids, parts)) == ids(whole)


def test_memos_are_bounded_in_bytes():
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k.encode(), 64 * bpe.ENTRY_BYTES)
    for i in range(500):
        assert memo[f"{i:04d}"] == f"{i:04d}".encode()
        assert memo.held <= memo.limit and len(memo) <= 64
    assert memo["x" * 10_000] == b"x" * 10_000 and "x" * 10_000 not in memo


def test_round_trip_is_encode_then_decode(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, t, _ in rows:
        ids, text = expected(library, t)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["decoded"] == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0


def test_query_against_the_library(spark, sf, library):
    rows = {r["doc_id"]: r for r in op9_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, text = expected(library, d["text"])
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
