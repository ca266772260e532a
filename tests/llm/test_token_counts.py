import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import fragments
from tessera.llm.queries import op11_token_counts
from tessera.llm.token_counts import token_counts

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n  b", "a\n b", "\ta b\t c", "don't we'll  've 's", "x y 　 z", "a\x1c b \x85 c",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext| >", "日本語 テスト　です", "😀👩‍👩 ok", "12 3½ 4", "é é", "x\x00 y", "▁a ▁ b", "a ▁ b▁ c", "<s> </s> <unk> <0x41>",
    "word " * 3000, "a" * 5000, " " * 300, "1 2 " * 500 + "  ",
]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_libraries(spark, libraries):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(3, "again", None, None), (None, "no id", "y", 1)], "doc_id long, text string, n_tokens string, other int")
    for path, count in ((JSON, lambda t: len(libraries[0].encode(t, add_special_tokens=False).ids)), (MODEL, lambda t: len(libraries[1].encode(t)))):
        got = token_counts(df, path)
        assert got.columns == ["doc_id", "other", "n_bytes", "n_tokens"]
        rows = got.collect()
        want = [(i, 7, len((t or "").encode()), count(t or "")) for i, t in enumerate(TEXTS)] + [(3, None, 5, count("again")), (None, 1, 5, count("no id"))]
        assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))


COUNTERS = [fragments.Counter(p, open(p, "rb").read()) for p in (JSON, MODEL)]
ODD = st.lists(st.sampled_from(list("ab'sre1.\n\t \x85\x1c▁é<|>") + [" "] * 8 + ["<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_cuts_are_certain(libraries, texts):
    for counter, count in zip(COUNTERS, (lambda t: len(libraries[0].encode(t, add_special_tokens=False).ids), lambda t: len(libraries[1].encode(t)))):
        assert counter.count(texts) == [count(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=30) | ODD, max_size=4))
def test_texts_encoded_as_one_have_their_own_ids(libraries, texts):
    for counter, ids in zip(COUNTERS, (lambda t: libraries[0].encode(" " + t, add_special_tokens=False).ids, libraries[1].encode)):
        found, edges = fragments.split_ids(counter.vocabulary, texts)
        assert [found[a:b].tolist() for a, b in zip(edges, edges[1:])] == [ids(t) for t in texts]


def test_ranks_and_library_agree_on_all_settled_characters(libraries):
    every = [chr(i) for i in range(0x250)]
    texts = ["".join(x + y for y in every[::7]) for x in every] + [f"a{x}b 1{x}2 {x}s'{x} {x}{x}" for x in every]
    assert COUNTERS[0].vocabulary.quick is not None
    assert [COUNTERS[0].vocabulary.quick(t, disallowed_special=()).tolist() for t in texts] == [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]


def test_windows_put_together_are_the_text():
    text = "one two  three\n four five six seven " * 50
    parts = list(fragments.windows(text, 40))
    assert " ".join(parts) == text and len(parts) > 20 and max(map(len, parts)) < 60
    assert list(fragments.windows("x" * 100, 10)) == ["x" * 100] and list(fragments.windows("", 10)) == [""]


def test_batches_are_balanced():
    texts = ["x" * (1 + i % 7) for i in range(1000)]
    batches = list(fragments.balanced(texts, 500))
    assert [t for b in batches for t in b] == texts
    sizes = [sum(map(len, b)) for b in batches]
    assert len(sizes) == -(-sum(sizes) // 500) and max(sizes) <= 507 and min(sizes[:-1]) > 400
    assert list(fragments.balanced([], 5)) == [] and list(fragments.balanced(["", ""], 5)) in ([["", ""]], [[""], [""]])


def test_memo_is_bounded():
    made = []
    known = fragments.Known(lambda x: made.append(len(x)) or list(map(len, x)), 100 * (fragments.ENTRY_BYTES + 3))
    for i in range(0, 900, 30):
        wanted = {f"{j:03d}" for j in range(i, i + 60)}
        known.learn(wanted)
        assert all(known[w] == 3 for w in wanted) and len(known) <= 100 and known.held <= known.limit


def test_small_slices_and_memo_change_nothing(spark, libraries, monkeypatch):
    vocabulary = fragments.Counter(JSON, open(JSON, "rb").read(), 2000)
    texts = [t or "" for t in TEXTS]
    monkeypatch.setattr(fragments, "WINDOW_CHARS", 50)
    assert vocabulary.count(texts) == [len(libraries[0].encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), JSON).collect() == []


def test_query_against_the_library(spark, sf, libraries):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(libraries[0].encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert tuple(r) == (r["doc_id"], len((docs[r["doc_id"]] or "").encode()), n, n > 512)
