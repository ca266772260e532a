import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment, fragments
from tessera.llm.bpe import byte_symbols
from tessera.llm.queries import op12_alignment

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a", "\n", "a", "a ", "the cat  sat\n on the mat", "a \n b", "don't we'll", "<|endoftext|> <s> </s> <unk>", "日本語 テスト　です", "😀👩‍👩 ok", "12 3½ 4",
    "é naïve", "x\x00 y", "▁a b", "a ▁ b", "the cat  sat\n on the mat", "unbelievable internationalization", "word " * 300, "a" * 3000,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute(texts, libraries):
    """Rows by a scan of each document's tokens, one by one."""
    one, two = libraries
    back = {s: b for b, s in enumerate(byte_symbols())}
    docs = []
    for t in texts:
        a = [(i, bytes(back[c] for c in one.id_to_token(i))) for i in one.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = []
        for i in two.encode(t or ""):
            p = two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + (t or "")).encode()
        if not t or any(b"".join(x for _, x in side) != want for side in (a, b)):
            docs.append(([], [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for i, x in side:
                at += len(x)
                found[at] = i
            ends.append(found)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for at, i in f.items() if low < at <= e) for f in ends))
            low = e
        docs.append((a, b, groups, [(ends[0][e], ends[1][e]) for e in both]))
    counts = Counter(p for d in docs for p in d[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for a, b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def test_against_brute_force(spark, libraries, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = alignment.alignments(df, JSON, MODEL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *x) for i, x in enumerate(brute(TEXTS, libraries))]
    assert sorted(map(tuple, got.collect())) == want


def test_ids_that_repeat_or_are_missing(spark, libraries):
    texts = ["the cat", "the dog sat", None, "the cat"]
    df = spark.createDataFrame(list(zip([1, 1, None, None], texts)), "doc_id int, text string")
    want = [(i, *x) for i, x in zip([1, 1, None, None], brute(texts, libraries))]
    assert sorted(map(repr, map(tuple, alignment.alignments(df, JSON, MODEL).collect()))) == sorted(map(repr, want))


def test_overlaps_are_all_pairs_that_share_bytes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        length = rng.integers(1, 20, 4)
        cuts = [[np.sort(np.unique(np.concatenate([[0], rng.integers(0, n, 5)]))) for n in length] for _ in (0, 1)]
        base = np.concatenate([[0], np.cumsum(length)])[:-1]
        starts = [np.concatenate([c + b for c, b in zip(side, base)]) for side in cuts]
        doc = [np.repeat(np.arange(4), [len(c) for c in side]) for side in cuts]
        ends = [np.append(s[1:], length.sum()) for s in starts]
        want = {(i, j) for i in range(len(starts[0])) for j in range(len(starts[1])) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])}
        a, b = alignment.overlaps(starts, doc)
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want


def test_small_slices_change_nothing(libraries, monkeypatch):
    texts = [t or "" for t in TEXTS]
    data = [open(p, "rb").read() for p in (JSON, MODEL)]
    aligner = alignment.Aligner(*(fragments.load(p, d, plain_specials=True) for p, d in zip((JSON, MODEL), data)), limit=4000)
    monkeypatch.setattr(alignment, "WINDOW_CHARS", 30)
    x = aligner.aligned(texts)
    want = brute(TEXTS, libraries)
    assert [tuple(r) for r in zip(x["n_a"].tolist(), x["n_b"].tolist(), x["n_groups"].tolist(), x["n_links"].tolist(), x["digests"])] == [(*w[:4], w[6]) for w in want]


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL).collect() == []


def test_query_against_brute_force(spark, sf, libraries):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = [(i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs], libraries))]
    assert sorted(map(tuple, op12_alignment(spark, sf).collect())) == want


def test_a_row_holds_a_document_and_a_group_a_slice(spark, libraries, monkeypatch):
    """Many slices of one task are never held together: their rows are documents and pairs, which meet slice by slice."""
    written, write = {}, alignment.materialise

    def kept(df, label):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(alignment, "materialise", kept)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 60)
    monkeypatch.setattr(alignment, "TOGETHER_BYTES", 20)
    texts = [f"the cat {'sat on ' * (i % 5)}the mat" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = alignment.alignments(docs, JSON, MODEL)
    assert sorted(map(tuple, got.collect())) == [(i, *x) for i, x in enumerate(brute(texts, libraries))]
    rows = written["slices"].where("codes is not null").selectExpr("slice", "n_links", "octet_length(codes) as size").collect()
    assert len(rows) == 60 and len({r["slice"] for r in rows}) > 20 and all(r["size"] == 2 * r["n_links"] for r in rows)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_sums_go_by_code(kind):
    n = np.array([2, 0, 3, 1])
    links = alignment.binaries(np.array([1, 0, 2, 2, 1, 0], kind), n)
    code, value = np.array([2, 0, 1]), np.array([100, 1, 10])
    for at in range(4):
        (got,) = alignment.summed(links.slice(at), n[at:], code, value)
        assert got.tolist() == [11, 0, 210, 1][at:]
    assert alignment.summed(alignment.binaries(np.empty(0, kind), np.array([0, 0])), np.array([0, 0]), code[:0], value[:0])[0].tolist() == [0, 0]
