"""Ranked search against scores of all documents, the skipping of blocks, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabgauge.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for m in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    """Every document scored for every item."""
    held = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_all = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for i, t in items:
        if t is not None:
            asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in held:
            tf, m, score = Counter(w), 10 + (90 * len(w) * n_docs) // max(n_all, 1), 0
            for t in terms & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def test_terms_are_the_pattern():
    text = "Ünïcode A-Z_a|z 0x9F é,日本語 don't \x00x\x7fy"
    assert [t.decode() for t in search.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables_with_ties_and_repeated_rows(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(900)]
    docs += docs[:40] + [(1000 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (None, docs[9][1]), (5000, None), (5001, " ,; ")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)]
    items += [(3, "w1 w2"), (3, "w1 w2"), (None, "w5 w6"), (77, None), (78, "..."), (79, "nowhere")]
    monkeypatch.setattr(search, "CHUNK_DOCS", 200)  # several chunks in a task
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(search.search(frame, asked)) == plain_search(docs, items)
    if seed == 1:  # several rounds of queries give the same
        assert rows_of(search.search(frame, asked, round_bytes=700, k=3)) == plain_search(docs, items, 3)


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    topics = [rng.choice(400, 25, replace=False) for _ in range(20)]
    vectors = [np.unique(np.r_[rng.choice(topics[i % 20], 12), rng.choice(400, 3), 399]) for i in range(3000)]
    queries = [sorted({*map(int, rng.choice(topics[i % 20], 8)), 399}) for i in range(40)]
    df = np.bincount(np.concatenate(vectors), minlength=400)
    weights = np.floor(1000 * np.log(6002 / (2 * df + 1))).astype(np.int64)
    s = search.Searcher(queries, weights, 3000, 3000 * 14, 10)
    start = np.r_[0, np.cumsum([len(v) for v in vectors])]
    term = np.concatenate(vectors)
    size = np.diff(start)
    value = s.values(size, size, term, np.ones(len(term), np.int32))
    s.search(search.Chunk(np.arange(3000), start, term, value, 400), np.zeros(3000, bool))
    assert s.skipped > 2 * s.scored
    dense = np.zeros((3000, 400), np.int64)
    dense[np.repeat(np.arange(3000), size), term] = value
    for q, ts in enumerate(queries):
        scores = dense[:, ts].sum(axis=1)
        order = np.lexsort((np.arange(3000), -scores))[:10]
        assert s.best.id[q].tolist() == order.tolist() and s.best.score[q].tolist() == scores[order].tolist()


def test_summaries_are_maxima_and_bound_every_score():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 30, 500)
    start = np.r_[0, np.cumsum(size)]
    term = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in size])
    chunk = search.Chunk(np.arange(500), start, term, rng.integers(0, 1000, len(term)), 50)
    wanted = np.arange(50)
    for t in (0, 7, 49):
        docs, block = chunk.blocks(t)
        assert sorted(docs) == sorted(set(chunk.row[term == t])) and len(set(block)) == block.max() + 1
        summary = chunk.summaries(docs, block, wanted, 50)
        for b in range(block.max() + 1):
            dense = np.zeros((0, 50))
            for d in docs[block == b]:
                one = np.zeros((1, 50))
                one[0, term[start[d] : start[d + 1]]] = chunk.value[start[d] : start[d + 1]]
                dense = np.r_[dense, one]
            assert (dense.max(axis=0) == summary[b]).all()


def test_chunks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(search, "CHUNK_ENTRIES", 10)
    lists = [[1] * n for n in (3, 4, 5, 40, 0, 0, 1, 9, 2)]
    batch = pa.RecordBatch.from_pydict({"id": range(9), "n": range(9), "terms": lists, "counts": lists})
    parts = [p.column(0).to_pylist() for p in search._chunks(batch)]
    assert [i for p in parts for i in p] == list(range(9)) and parts == [[0, 1], [2], [3], [4, 5, 6, 7], [8]]


def test_odd_rows(spark):
    long = "filler " * 150_000 + "needle"
    docs = spark.createDataFrame([(1, "Needle", "x"), (1, "Needle", "x"), (2, long, "y"), (3, "", None), (4, None, None)], "doc_id long, text string, score string")
    items = spark.createDataFrame([(9, "NEEDLE!", 1)], "item_id long, text string, rank int")
    assert [(r["rank"], r["doc_id"]) for r in search.search(docs, items).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2)]
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.filter("text is null"), items).count() == 0
