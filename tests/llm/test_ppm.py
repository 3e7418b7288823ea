"""Scoring a chunk: every batch is read once and asks for its distinct grams alone."""

import numpy as np
import pyarrow as pa

from tabgauge.llm import ppm
from tabgauge.llm.text_arrays import U


def test_places_of_grams():
    rng = np.random.default_rng(3)
    for n, high in ((0, 1), (1, 1 << 48), (200_000, 1 << 48), (200_000, 900)):
        grams = rng.integers(0, high, n, dtype=U) | (U(0xFFFFFF) << U(24) if high == 900 else U(0))
        distinct, which = ppm.located(grams)
        assert np.array_equal(distinct, np.unique(grams)) and np.array_equal(distinct[which], grams)


def test_a_chunk_is_read_once(monkeypatch):
    texts = ["One two one", None, "", "two  naïve", "one"]
    docs = pa.table({"id": range(5), "text": texts, "train": [True] * 5, "chunk": [0] * 5})
    counts = ppm._count(3)(docs)
    rows = []
    for kind, shard, keys, n in zip(*(counts.column(c).to_pylist() for c in ("kind", "shard", "keys", "counts"))):
        n = ppm.unpack(n, np.uint32)
        value = -n.astype(np.float64) if kind == ppm.GRAM else n.astype(np.uint64)
        rows.append({"kind": kind, "shard": shard, "chunk": 0, "values": ppm.pack(value), "tokens": 0, "types": 0})
    batches = []
    plain = ppm.Batch

    def batch(*args):
        batches.append(plain(*args))
        return batches[-1]

    monkeypatch.setattr(ppm, "Batch", batch)
    monkeypatch.setattr(ppm, "BATCH_BYTES", 8)
    got = ppm._score(3)(docs, pa.Table.from_pylist(rows, ppm.VALUES)).to_pydict()
    assert len(batches) == len(list(ppm.batches_of(docs))) > 1
    every = [g for b in batches for g in b.grams.tolist()]
    asked = [0, *np.cumsum(np.concatenate([b.symbols for b in batches]))]
    assert got["score"] == [-sum(every.count(g) for g in every[a:b]) for a, b in zip(asked, asked[1:])]
    assert got["n_tokens"] == [4, 1, 1, 3, 2] == got["n_known"]
    words = {"one": 3, "two": 2, "naïve": 1, None: 5}
    wanted = [["one", "two", "one", None], [None], [None], ["two", "naïve", None], ["one", None]]
    assert np.allclose(got["log_counts"], [sum(np.log10(words[w] + 1) for w in ws) for ws in wanted])
