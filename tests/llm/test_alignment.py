"""Cross-tokenizer alignment against a merge of one document at a time, and odd rows."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabgauge.llm import alignment
from tabgauge.llm.queries import QUERIES

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*FILES)


def plain_tokens(texts):
    """Both sides by the libraries alone: (ids, bytes of each token)."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = {v: k for k, v in alignment.byte_letters().items()}
    out = []
    for t in texts:
        ids = a.encode(" " + t, add_special_tokens=False).ids if t else []
        pieces = b.encode(t) if t else []
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
        right = [
            (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
            for i in pieces
        ]
        body = b" " + (t or "").encode()
        same = b"".join(x for _, x in left) == body == b"".join(x for _, x in right)
        out.append((left, right) if t and same else ([], []))
    return out


def plain_alignment(texts):
    """Links by comparing all token ranges' ends one pair after the other."""
    held, rows = Counter(), []
    for left, right in plain_tokens(texts):
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, (side, es) in enumerate(zip((left, right), ends)):
            for (i, _), e in zip(side, es):
                groups[bisect_left(cuts, e)][k].append(str(i))
        groups = ["|".join(",".join(g) for g in pair) for pair in groups]
        links, j = [], 0
        for (a, x), e in zip(left, ends[0]):
            while j and ends[1][j - 1] > e - len(x):
                j -= 1
            while j < len(right) and ends[1][j] <= e - len(x):
                j += 1
            while j < len(right) and ends[1][j] - len(right[j][1]) < e:
                links.append((a, right[j][0]))
                j += 1
        held.update(set(links))
        rows.append((len(left), len(right), len(cuts), links, ";".join(groups)))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (n_a, n_b, n_g, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, n_g, ls, g in rows
    ], held, most


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_the_query_matches_the_plain_version(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    wanted, _, _ = plain_alignment([r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in QUERIES["op12_alignment"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, wanted)}


@settings(deadline=None, max_examples=60)
@given(
    st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=8),
    st.randoms(use_true_random=False),
    st.integers(1, 9),
)
def test_lockstep_links_are_all_overlaps(docs, rng, lane):
    """Random token lengths on both sides, documents of many lengths, lanes of any length."""
    a, b, doc_a = [], [], []
    for lengths in docs:
        total, right = sum(lengths), []
        while sum(right) < total:
            right.append(min(rng.randint(1, 5), total - sum(right)))
        a += lengths
        b += right
        doc_a.append(len(a))
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    m = alignment.merge(a_end, b_end, np.array(doc_a), lane)
    wanted = [
        (i, j) for i in range(len(a)) for j in range(len(b))
        if a_end[i] - a[i] < b_end[j] and b_end[j] - b[j] < a_end[i]
    ]
    assert list(zip(m.a.tolist(), m.b.tolist())) == wanted
    assert m.cut.tolist() == [bool(a_end[i] == b_end[j]) for i, j in wanted]


def test_ids_are_the_librarys(aligner):
    texts = ["a<|endoftext|>b", "x  y\n\n z", "日本語 naïve ﬁ", "İ ẞ  　 q", "'ll 've 123abc"]
    whole = Tokenizer.from_file(FILES[0])
    whole.encode_special_tokens = True
    assert [aligner.a.encode(t).tolist() for t in texts] == [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_odd_rows(spark):
    long = " ".join(f"word{i} naïve" for i in range(8_000))
    texts = ["one two", "one two", None, "", "has ▁ inside", " \n\t ", long, "日本 <s> <0x41> <|endoftext|>", "one two"]
    ids = [1, 1, 2, 3, 4, 5, 6, 7, None]
    rows = [(i, t, "x") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(3)
    documents, pairs = alignment.align_tokens(df, *FILES, chunk_bytes=1000)
    wanted, held, most = plain_alignment(texts)
    got = sorted((str(r["doc_id"]), *(r[n] for n in NAMES)) for r in documents.collect())
    assert got == sorted((str(i), *w) for i, w in zip(ids, wanted))
    zero = (0, 0, 0, 0, 0, 0, "")
    assert [wanted[k] for k in (2, 3, 4)] == [zero] * 3
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in held.items()}
    documents, pairs = alignment.align_tokens(df.limit(0), *FILES)
    assert documents.count() == 0 and pairs.count() == 0
    nothing, pairs = alignment.align_tokens(df.filter("text is null or text = ''"), *FILES)
    assert sorted(r["n_a"] for r in nothing.collect()) == [0, 0] and pairs.count() == 0


ODD = ["the", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", "\u3000", "naïve", "日本", "▁", "ﬁ", "12", "'ll", "'", "e\u0301", "\x00", "<s>", "<0x41>", ".", "a "]


@settings(deadline=None, max_examples=150)
@given(texts=st.lists(st.lists(st.sampled_from(ODD), max_size=9).map("".join), max_size=6))
def test_words_apart_have_the_tokens_of_the_whole_text(aligner, texts):
    wanted = [tuple([i for i, _ in side] for side in sides) for sides in plain_tokens(texts)]
    assert [(a.tolist(), b.tolist()) for a, b in aligner.tokens(texts)] == wanted


def test_a_batch_tokenizes_each_word_once():
    aligner = alignment.Aligner(*FILES)
    seen = []
    model = aligner.b.model

    class Watched:
        def encode(self, found, **options):
            seen.extend([found] if isinstance(found, str) else found)
            return model.encode(found, **options)

    aligner.b.model = Watched()
    long = "x" * (alignment.LONGEST + 1)
    texts = ["one two one", "two  three", f"one {long} {long}"]
    first = aligner.tokens(texts)
    assert sorted(seen) == sorted(["one", "two", " three", long])
    assert [x.tolist() for pair in aligner.tokens(texts) for x in pair] == [x.tolist() for pair in first for x in pair]
    assert seen[4:] == [long]  # long words are not remembered


def test_little_memory_loses_no_word(monkeypatch):
    monkeypatch.setattr(alignment.Remembered.__init__, "__defaults__", (3,))
    aligner = alignment.Aligner(*FILES)
    texts = [" ".join(f"w{i * k}" for i in range(9)) for k in range(7)]
    for _ in range(2):
        for t in texts:
            [(a, b)] = aligner.tokens([t])
            [(left, right)] = plain_tokens([t])
            assert (a.tolist(), b.tolist()) == ([i for i, _ in left], [i for i, _ in right])
            assert len(aligner.b.words) <= 3 + 9


def test_models_that_may_cross_words_encode_whole_texts(aligner, monkeypatch):
    texts = ["one two", None, "a  b\n c", "has ▁ inside", "日本 語"]
    wanted = [(a.tolist(), b.tolist()) for a, b in aligner.tokens(texts)]
    monkeypatch.setattr(aligner.b, "by_words", False)
    assert [(a.tolist(), b.tolist()) for a, b in aligner.tokens(texts)] == wanted
