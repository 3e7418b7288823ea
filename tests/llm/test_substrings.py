"""The work of substring deduplication: what is searched, and what a blob costs."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tabgauge.llm import substrings


def _texts(rng):
    """Lines that many documents copy, parts of them after other words, and words that no document repeats."""
    words = [f"v{i}" for i in range(300)]
    lines = [" ".join(rng.choices(words, k=30)) for _ in range(20)]
    rows = []
    for i in range(400):
        line, cut = rng.choice(lines), rng.randrange(15)
        rows.append((i // 2, " ".join([*rng.choices(words, k=40), *line.split()[cut:], *rng.choices(words, k=20)])))
        rows.append((i, line if i % 3 else "  \t".join(line.split())))
    return rows


def _blobs(rows, shards):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["id", "text"])
    run = substrings._segments(13, 3, shards, np.zeros(0, np.uint64))
    # a flush for each part of the documents, as from tasks of their own
    return pa.concat_tables(
        [pa.Table.from_batches(list(run(iter([batch.slice(k, 50)])))) for k in range(0, len(rows), 50)]
    )


def _wanted(rows):
    first, spans = {}, set()
    windows = [(i, w, j) for i, t in rows for w in [t.split()] for j in range(len(w) - 12)]
    for i, w, j in windows:
        key = tuple(w[j : j + 13])
        first[key] = min(first.get(key, i), i)
    for i, w, j in windows:
        if first[tuple(w[j : j + 13])] < i:
            spans |= {(i, len(w), p) for p in range(j, j + 13)}
    return spans


def test_equal_text_is_indexed_once_and_few_places_are_searched(monkeypatch):
    rows = _texts(random.Random(5))
    extended, indexed, extend, make = [], [], substrings.FMIndex.extend, substrings.FMIndex.__init__

    def counted(self, symbol, low, high):
        extended.append(len(symbol))
        return extend(self, symbol, low, high)

    def made(self, text):
        indexed.append(len(text))
        make(self, text)

    monkeypatch.setattr(substrings.FMIndex, "extend", counted)
    monkeypatch.setattr(substrings.FMIndex, "__init__", made)
    found = substrings._search(13)(_blobs(rows, 1)).to_pylist()
    lengths = {(i, zlib.crc32(t.encode())): len(t.split()) for i, t in rows}
    got = {(r["id"], lengths[r["id"], r["crc"]], p) for r in found for p in range(r["start"], r["stop"])}
    assert got == _wanted(rows)
    # before: 35,872 words indexed, 108,839 words put before others
    assert sum(indexed) < 28_000 and sum(extended) < 70_000


def test_places_are_ruled_out_soundly():
    """Every place, and every run of places, gets the statistic that a plain count gives, or 0 where it is below n."""
    rng = np.random.default_rng(1)
    for symbols in (2, 5, 40, 3000):
        text = np.r_[rng.integers(1, symbols + 1, 600), 0]
        text = np.r_[text, text[100:300], 0, rng.integers(1, symbols + 1, 50), text[400:430], 0]
        for n in (3, 13, 16):
            places = np.array([p for p in range(len(text) - n) if 0 not in text[p : p + n]])
            statistic, low, high = substrings.FMIndex(text).matching(places, n)
            seen = {}
            for p in places:
                seen.setdefault(text[p : p + n].tobytes(), []).append(p)
            for p, s, lo, hi in zip(places, statistic, low, high):
                count = len(seen[text[p : p + n].tobytes()])
                assert (s == n) == (count > 1) and (s < n or hi - lo == count)


def test_a_small_blob_is_mostly_text():
    """At many shards a blob has few segments; what it has besides them must stay small."""
    blobs = _blobs(_texts(random.Random(6)), 100_000).column("blob")
    held = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]
    assert all(t.num_rows < 100 for t in held)
    rest = [len(b.as_py()) - t.nbytes for b, t in zip(blobs, held)]
    assert sum(rest) / len(rest) < 600  # before: 942 bytes
