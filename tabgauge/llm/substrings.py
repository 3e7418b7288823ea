"""Substring deduplication over FM-index shards.

A window is ``n`` consecutive words. A word is removed when a window over it also starts in a document with a smaller
id. Equal windows are found by backward search over a compressed FM-index (a wavelet matrix of the Burrows-Wheeler
transform, one bit vector for each bit of a word number) that gives, for every window of the streamed documents, how
many of its words still match at least twice: its matching statistic, cut at ``n``. Windows that reach ``n`` are
reported with the smallest id in their suffix interval.

Searching every document in the index of every shard would cost the square of the corpus. So shards are cut by content:
every window is filed under the smallest hash among its ``anchor`` -word runs. Equal windows have the same anchor, meet
in the same shard, and are searched there alone. Consecutive windows with one anchor travel as one segment of text.
An anchor with too much different text for a shard (a short line with other surroundings in very many documents) is
hot: its windows travel one by one and are filed by the hash of all their words, so that equal ones still meet.

How it scales: work and shuffle are proportional to the text; the number of shards follows its size, so that a shard's
index has a bounded size. Equal segments within a map task leave it once, with their smallest id: a passage that a third of
all documents hold reaches its shard once for each map task, and the others are settled where they are; what is settled
is joined to long runs and dealt to shards by id. Hot anchors are found in one of ``SAMPLE`` documents, by text that is
counted once where it is equal; which ones are found changes the filing and no result. Only their hashes are collected:
each stands for a part of a shard, so there are at most a few for each shard. Segments whose anchor no second document
has are dropped before the index is built, and of equal segments in a shard only those with the smallest id are indexed;
the others are settled. Where a search fails, its statistic rules out the windows that hold the same words, unsearched.
A task sends a shard one blob for every ``FLUSH_BYTES`` of text, so a blob's own bytes are kept few.

Cases: null or blank text has no words; text shorter than a window loses nothing; a repeat inside one document stays;
rows that share an id do not remove each other's words; a null id keeps its row whole and removes nothing elsewhere; an
empty table gives an empty result; other columns do not take part, so names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabgauge.llm.common import table
from tabgauge.llm.text_arrays import Sequences, U, mix

#: text hashed at once, text gathered before segments leave a task, windows in a segment at most
HASH_BYTES, FLUSH_BYTES, SEGMENT_WINDOWS = 1 << 20, 32 << 20, 64
#: segments whose text is gathered at once for their blobs, bytes of blobs handed on at once
PACK_ROWS, OUT_BYTES = 1 << 15, 4 << 20
#: one document of so many is searched for hot anchors, which have more than this part of a shard's text
SAMPLE, HOT_PART = 16, 4
#: places searched first: every so many of a run, then of what is left, then all that is left
STRIDES = (8, 4, 1)


class Cutter:
    """Cuts texts into segments of windows that share an anchor; a window with a hot anchor is a segment of its own."""

    def __init__(self, n: int, anchor: int, hot: np.ndarray | None = None) -> None:
        self.n, self.anchor = n, anchor
        self.hot = np.zeros(0, U) if hot is None else hot
        self.sequences = Sequences()

    def cut(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Segments of ``texts``, white space after each: owner (place in texts), first word, windows, anchor, hash of
        its words, and bytes [begin, end) in the joined texts."""
        joined = b"\n".join([*texts, b""])
        begin, end, word = self.sequences.words(joined)
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        owner = np.searchsorted(offsets, begin, "right") - 1
        n, m = self.n, self.anchor
        count = len(word) - n + 1
        empty = {k: np.zeros(0, np.int64) for k in ("owner", "first", "windows", "begin", "end")}
        empty |= {k: np.zeros(0, U) for k in ("anchor", "hash")} | {"joined": joined}
        if count <= 0:
            return empty
        run = np.zeros(len(word) - m + 1, U)
        for j in range(m):
            run = mix(run * U(3) + word[j : j + len(run)])
        width, low = 1, run
        while width * 2 <= n - m + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if (more := n - m + 1 - width) > 0:
            low = np.minimum(low[:-more], low[more:])
        low = low[:count]
        valid = owner[:count] == owner[n - 1 :]
        places = np.flatnonzero(valid)
        if not len(places):
            return empty
        new = np.r_[True, (np.diff(places) != 1) | (low[places[1:]] != low[places[:-1]]) | (owner[places[1:]] != owner[places[:-1]])]
        run_start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        new |= (np.arange(len(places)) - run_start) % SEGMENT_WINDOWS == 0
        hot = np.isin(low[places], self.hot)
        new |= hot
        starts = np.flatnonzero(new)
        windows = np.diff(np.r_[starts, len(places)])
        first = places[starts]
        last_word = first + windows + n - 2
        sequence = self.sequences.hashes(word, first, last_word + 1)
        first_of = np.searchsorted(owner, np.arange(len(texts)))
        return {
            "owner": owner[first],
            "first": first - first_of[owner[first]],
            "windows": windows,
            "anchor": np.where(hot[starts], mix(sequence), low[first]),
            "hash": sequence,
            "begin": begin[first],
            "end": end[last_word],
            "joined": joined,
        }


#: A segment without its text. One column of such records, since a blob's size and time grow with its columns where a
#: large corpus leaves little text to each
RECORD = np.dtype([("id", "<i8"), ("crc", "<u4"), ("first", "<i4"), ("windows", "<i4"), ("anchor", "<u4")])
SEGMENTS = pa.schema([("record", pa.binary(RECORD.itemsize)), ("text", pa.binary())])

#: segments are most of what is shuffled
PACKING = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))


def _batch(records: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    column = pa.Array.from_buffers(SEGMENTS.field("record").type, len(records), [None, pa.py_buffer(records)])
    return pa.RecordBatch.from_arrays([column, pa.array(texts, pa.binary())], schema=SEGMENTS)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SEGMENTS, options=PACKING) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blobs: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The records and texts of a shard's segments."""
    held = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs])
    record, text = (pa.concat_arrays(held.column(c).chunks) for c in SEGMENTS.names)
    return np.frombuffer(record.buffers()[1], RECORD, len(record), record.offset * RECORD.itemsize), text


def _joined_runs(ids: np.ndarray, crcs: np.ndarray, first: np.ndarray, windows: np.ndarray):
    """Runs of windows of one text, with runs that follow on each other joined and repeated ones left out."""
    order = np.lexsort((first, crcs, ids))
    i, c, f = ids[order], crcs[order], first[order]
    end = f + windows[order]
    follows = (i[1:] == i[:-1]) & (c[1:] == c[:-1]) & ((f[1:] == end[:-1]) | ((f[1:] == f[:-1]) & (end[1:] == end[:-1])))
    start = np.flatnonzero(np.r_[True, ~follows]) if len(order) else np.zeros(0, np.int64)
    stop = np.r_[start[1:], len(order)][: len(start)] - 1
    return i[start], c[start], f[start], end[stop] - f[start]


def _anchor_texts(n: int, anchor: int):
    """Texts to (anchor, hash, bytes) of their segments, the bytes as if each window went alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(n, anchor)
        for batch in batches:
            texts, size = [], 0
            pieces = [t.as_buffer().to_pybytes() for t in batch.column(0) if t.is_valid]
            for k, t in enumerate(pieces):
                texts.append(t)
                size += len(t)
                if size >= HASH_BYTES or k == len(pieces) - 1:
                    found = cutter.cut(texts)
                    _, one = np.unique(found["hash"], return_index=True)
                    sizes = (found["end"] - found["begin"]) * found["windows"] * n // (found["windows"] + n - 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found["anchor"][one].view(np.int64)),
                            pa.array(found["hash"][one].view(np.int64)),
                            pa.array(sizes[one].astype(np.int64)),
                        ],
                        names=["anchor", "hash", "bytes"],
                    )
                    texts, size = [], 0

    return run


def hot_anchors(plain: DataFrame, n: int, anchor: int, shard_bytes: int) -> tuple[np.ndarray, int]:
    """Anchors whose different segments are too much text for a shard, and the text of their windows, both estimated."""
    some = plain.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).select("text")
    texts = some.mapInArrow(_anchor_texts(n, anchor), "anchor long, hash long, bytes long")
    rows = (
        texts.groupBy("anchor", "hash")
        .agg(F.max("bytes").alias("bytes"))
        .groupBy("anchor")
        .agg(F.sum("bytes").alias("bytes"))
        .filter(F.col("bytes") * (SAMPLE * HOT_PART) > shard_bytes)
        .collect()
    )
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(U)), SAMPLE * sum(r["bytes"] for r in rows)


def _segments(n: int, anchor: int, shards: int, hot: np.ndarray):
    """Texts to (shard, blob of segments). A segment without text has been settled: all its windows are repeats."""

    def flush(parts: list[dict]) -> Iterator[tuple[int, bytes]]:
        ids, crcs, first, windows, anchors, hashes, begin, end, part = (
            np.concatenate([p[k] for p in parts])
            for k in ("id", "crc", "first", "windows", "anchor", "hash", "begin", "end", "part")
        )
        for p in parts:
            del p["id"], p["hash"], p["begin"], p["end"]
        order = np.lexsort((ids, windows, hashes, anchors))
        a, h, w, i = anchors[order], hashes[order], windows[order], ids[order]
        same = np.r_[False, (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (w[1:] == w[:-1])]
        group = np.flatnonzero(~same)
        smallest = np.repeat(i[group], np.diff(np.r_[group, len(i)]))
        settled = i > smallest
        done = order[settled]
        run_id, run_crc, run_first, run_windows = _joined_runs(ids[done], crcs[done], first[done], windows[done])
        order = order[~settled]
        blank = np.zeros(len(run_id), np.int64)
        shard = np.concatenate([anchors[order] % U(shards), mix(run_id.astype(U)) % U(shards)]).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        records = np.empty(len(shard), RECORD)
        records["id"] = np.concatenate([ids[order], run_id])[by_shard]
        records["crc"] = np.concatenate([crcs[order], run_crc])[by_shard]
        records["first"] = np.concatenate([first[order], run_first])[by_shard]
        records["windows"] = np.concatenate([windows[order], run_windows])[by_shard]
        records["anchor"] = np.concatenate([anchors[order] >> U(32), blank.astype(U)])[by_shard]
        part, begin, end = (np.concatenate([x[order], blank])[by_shard] for x in (part, begin, end))
        shard = shard[by_shard]
        bounds = np.append(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)) if len(shard) else [0]
        at = 0
        while at < len(bounds) - 1:
            # the shards whose text is held at once
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PACK_ROWS, "right")) - 1)
            lo, hi = bounds[at], bounds[stop]
            texts = [
                parts[p]["joined"][b:e]
                for p, b, e in zip(part[lo:hi].tolist(), begin[lo:hi].tolist(), end[lo:hi].tolist())
            ]
            batch = _batch(records[lo:hi], texts)
            for a, b in zip(bounds[at:stop].tolist(), bounds[at + 1 : stop + 1].tolist()):
                yield int(shard[a]), _pack(batch.slice(a - lo, b - a))
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(n, anchor, hot)
        parts: list[dict] = []
        held = 0

        def cut(ids: list[int], texts: list[bytes]) -> None:
            found = cutter.cut(texts)
            if len(found["owner"]):
                own = found["owner"]
                found["id"] = np.array(ids, np.int64)[own]
                found["crc"] = np.array([zlib.crc32(t) for t in texts], np.uint32)[own]
                found["part"] = np.full(len(own), len(parts), np.int32)
                found |= {k: found[k].astype(np.int32) for k in ("first", "windows")}
                del found["owner"]
                parts.append(found)

        def out() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in flush(parts):
                rows.append(row)
                size += len(row[1])
                if size >= OUT_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["shard", "blob"],
            )

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not t.is_valid:
                    continue
                ids.append(i)
                texts.append(t.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= HASH_BYTES:
                    cut(ids, texts)
                    held += size
                    ids, texts, size = [], [], 0
                if held >= FLUSH_BYTES:
                    yield from out()
                    parts.clear()
                    held = 0
            cut(ids, texts)
            held += size
        if parts:
            yield from out()

    return run


class BitVector:
    """Bits with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """FM-index of a sequence of small integers; 0 parts the texts. Sound for patterns of up to 16 symbols."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        self.suffixes = self._suffixes(text)
        self.starts = np.r_[0, np.cumsum(np.bincount(text))]
        symbols = text[self.suffixes - 1]  # the transform; the first suffix wraps around
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, BitVector(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        every = np.arange(len(self.starts) - 1)
        self.base = self._down(every, np.zeros(len(every), np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffixes in the order of their first 16 symbols or more, by doubling from as many as one number holds."""
        bits = max(1, int(text.max()).bit_length())
        width = min(16, 62 // bits)
        key = text.astype(np.int64)
        for j in range(1, width):
            key <<= bits
            key[:-j] |= text[j:]
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty_like(key)
            rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
            if width >= 16 or len(rank) <= width or rank[order[-1]] == len(rank) - 1:
                return order
            key = rank * (int(rank[order[-1]]) + 2)
            key[:-width] += rank[width:] + 1
            width *= 2

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.rank(i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Suffix intervals after putting ``symbol`` before what they match: one step of backward search."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.starts[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def matching(self, places: np.ndarray, n: int):
        """For the ``n`` symbols from each place on: how many of them, from the right, occur twice or more in a row,
        and the interval of those; 0 where an earlier place rules the whole out. ``places`` ascend.

        Where only ``k`` symbols before ``place + n`` occur twice, the ``k + 1`` there stand nowhere else, and no place
        up to ``place + n - 1 - k`` needs a search. So one in ``STRIDES`` places of a run is searched first.
        """
        statistic, low, high = (np.zeros(len(places), np.int64) for _ in range(3))
        left = np.arange(len(places))
        for stride in STRIDES:
            if not len(left):
                break
            at = places[left]
            starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            inside = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            chosen = inside % stride == 0
            now = left[chosen]
            statistic[now], low[now], high[now] = self._matching(places[now], n)
            reach = np.zeros(len(at), np.int64)
            reach[chosen] = np.where(statistic[now] < n, places[now] + n - 1 - statistic[now], 0)
            left = left[~chosen & (at > np.maximum.accumulate(reach))]
        return statistic, low, high

    def _matching(self, places: np.ndarray, n: int):
        statistic = np.zeros(len(places), np.int64)
        last = self.text[places + n - 1]
        low, high = self.starts[last], self.starts[last + 1]
        active = np.flatnonzero(high - low >= 2)
        statistic[active] = 1
        l, h = low[active], high[active]
        for step in range(n - 2, -1, -1):
            if not len(active):
                break
            l, h = self.extend(self.text[places[active] + step], l, h)
            more = h - l >= 2
            active, l, h = active[more], l[more], h[more]
            low[active], high[active] = l, h
            statistic[active] += 1
        return statistic, low, high


def repeats(ids: np.ndarray, windows: np.ndarray, texts: list[bytes], n: int):
    """(segment, first window, last window) of runs of windows that also stand in a segment with a smaller id."""
    words = pa.array(b"\n".join(texts).split(), pa.binary()).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64) + 1
    lengths = windows + n - 1
    offset = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    filled = np.ones(len(text), bool)
    filled[offset + lengths] = False
    text[filled] = codes
    owner = np.repeat(np.arange(len(ids)), lengths + 1)
    index = FMIndex(text)
    segment = np.repeat(np.arange(len(ids)), windows)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    statistic, low, high = index.matching(offset[segment] + inside, n)
    found = np.flatnonzero(statistic == n)
    if not len(found):
        return np.zeros((3, 0), np.int64)
    bounds, which = np.unique(low[found], return_inverse=True)
    ends = np.zeros(len(bounds), np.int64)
    ends[which] = high[found]
    by_suffix = np.append(ids[owner[index.suffixes]], np.iinfo(np.int64).max)
    smallest = np.minimum.reduceat(by_suffix, np.stack([bounds, ends], 1).ravel())[::2]
    found = found[smallest[which] < ids[segment[found]]]
    if not len(found):
        return np.zeros((3, 0), np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(found) != 1) | (np.diff(segment[found]) != 0)])
    stop = np.r_[new[1:], len(found)] - 1
    return np.stack([segment[found[new]], inside[found[new]], inside[found[stop]]])


def _shared(anchors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which anchors two documents have."""
    shared = np.zeros(len(anchors), bool)
    if len(anchors):
        order = np.argsort(anchors, kind="stable")
        groups = np.flatnonzero(np.r_[True, anchors[order][1:] != anchors[order][:-1]])
        low, high = np.minimum.reduceat(ids[order], groups), np.maximum.reduceat(ids[order], groups)
        shared[order] = np.repeat(low < high, np.diff(np.r_[groups, len(order)]))
    return shared


def _search(n: int):
    def run(shard: pa.Table) -> pa.Table:
        records, text = _unpack(shard.column("blob"))
        ids, crc, anchor = (np.ascontiguousarray(records[c]) for c in ("id", "crc", "anchor"))
        first, windows = records["first"].astype(np.int64), records["windows"].astype(np.int64)
        blank = pc.binary_length(text).to_numpy(zero_copy_only=False) == 0
        keep = np.flatnonzero(~blank)
        keep = keep[_shared(anchor[keep], ids[keep])]
        # a segment that a smaller id also has is settled as a whole; the others are searched in each other
        same = text.take(pa.array(keep)).dictionary_encode().indices.to_numpy()
        smallest = np.full(len(keep), np.iinfo(np.int64).max)
        np.minimum.at(smallest, same, ids[keep])
        settled = np.concatenate([np.flatnonzero(blank), keep[ids[keep] > smallest[same]]])
        keep = keep[ids[keep] == smallest[same]]
        keep = keep[_shared(anchor[keep], ids[keep])]
        out = [(settled, np.zeros(len(settled), np.int64), windows[settled] - 1)]
        if len(keep):
            segment, a, b = repeats(ids[keep], windows[keep], text.take(pa.array(keep)).to_pylist(), n)
            out.append((keep[segment], a, b))
        which, a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table(
            {
                "id": ids[which],
                "crc": crc[which].astype(np.int64),
                "start": (first[which] + a).astype(np.int32),
                "stop": (first[which] + b + n).astype(np.int32),
            }
        )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "spans": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            merged: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            kept, at = [], 0
            for start, stop in merged:
                kept += words[at:start]
                at = stop
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode())
            out["spans"].append([{"start": a, "stop": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()),
                pa.array(out["kept_text"], pa.string()),
                pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ],
            names=["id", "n_words", "n_removed", "kept_text", "spans"],
        )


def drop_repeats(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 13,
    anchor: int = 3,
    shard_bytes: int = 4 << 20,
) -> DataFrame:
    """For every row its ``key`` (a whole number), n_words, n_removed (long), kept_text (kept words joined by blanks)
    and the removed spans of words. ``shard_bytes`` is the text for each shard; ``n`` is at most 16."""
    if not anchor <= n <= 16:
        raise ValueError("a window has at least as many words as an anchor, and at most 16")
    plain = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot, more = hot_anchors(plain, n, anchor, shard_bytes)
    shards = 1 + (size + more) // shard_bytes
    spans = (
        plain.mapInArrow(_segments(n, anchor, shards, hot), "shard int, blob binary")
        .groupBy("shard")
        .applyInArrow(_search(n), "id long, crc long, start int, stop int")
        .groupBy("id", "crc")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )
    rows = plain.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    joined = rows.join(spans, ["id", "crc"], "left").select("id", "text", "spans")
    return joined.mapInArrow(
        _remove,
        "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,stop:int>>",
    ).withColumnRenamed("id", key)


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), g as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as gram
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)
), hit as (select doc_id, i from g qualify min(doc_id) over (partition by gram) < doc_id
), gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from hit
), words as (select doc_id, list_extract(w, p) as word, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)
), kept as (
  select words.doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n
  from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id
)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""
