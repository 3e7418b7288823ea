"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` long, with counts from the training texts. A symbol is coded in the
longest context that is known; where that context has not seen it, an escape (method D: half a count for each kind of
symbol) leads to the next shorter one, in which the symbols of the longer one are excluded; below the empty context all
256 symbols that are left are alike. A text is its lower-cased (A-Z) bytes and an end, byte 255, which no text holds; it
starts after ``ORDER`` of those. Its score is the log10 of its probability.

Beside it stands the base score: an add-one unigram model over words and an end token.

How it scales: documents are dealt to chunks of about ``chunk_bytes`` of text by their id. A chunk counts its distinct
(``ORDER`` + 1)-grams and words, and sends them to shards: grams by the last two bytes of the context, so that a shard
holds every context that its grams can fall back to; words by hash. Contexts of one byte and none have at most 65,536
counts and are broadcast. A shard sums the counts of all chunks, works out one value for each distinct gram, and answers
each chunk in the order of its question. So a frequent gram or word crosses the network once for each chunk, nothing
whole passes through the driver or one task, and all that is gathered grows with the corpus.

Cases: null text is empty and has the end alone; a null id counts as the empty text when the training part is chosen;
repeated rows are trained on and scored each; without training texts all symbols are alike; an empty table gives an
empty result; other columns do not take part, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.llm.common import table, written
from tabgauge.llm.text_arrays import Sequences, U

ORDER = 5
END = 255
GRAM, WORD = 0, 1
#: the end token's key; words have odd keys
END_WORD = 0
#: text whose grams are in memory at once
BATCH_BYTES = 3 << 19


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, like places of all numbers together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n)


class Batch:
    """The grams and words of some texts. ``sequences`` may serve many batches."""

    def __init__(self, texts: list[bytes | None], sequences: Sequences) -> None:
        pad = bytes([END]) * ORDER
        lowered = [(t or b"").lower() for t in texts]
        joined = b"".join([piece for t in lowered for piece in (pad, t, pad[:1])])
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(t) + ORDER + 1 for t in lowered], np.int64)
        ends = np.cumsum(sizes)
        self.symbols = sizes - ORDER  # of each text, its end included
        coded = np.ones(len(raw), bool)
        for j in range(ORDER):
            coded[ends - sizes + j] = False
        gram = np.zeros(len(raw), U)
        for j in range(ORDER, -1, -1):
            gram[ORDER:] = (gram[ORDER:] << U(8)) | raw[ORDER - j : len(raw) - j]
        self.grams = gram[coded]
        text = b"\n".join([*lowered, b""])
        begin, _, word = sequences.words(text)
        owner = np.searchsorted(np.cumsum([0, *[len(t) + 1 for t in lowered]]), begin, "right") - 1
        self.word_counts = np.bincount(owner, minlength=len(texts))
        self.words = word | U(1)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys under 2**63, sorted, and how often each is among the training ones."""
    both, n = np.unique((keys << U(1)) | train.astype(U), return_counts=True)
    key = both >> U(1)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.where(both & U(1) == 1, n, 0)
    return key[first], np.add.reduceat(n, first) if len(first) else n[:0]


def sharded(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    part = (keys >> U(8)) & U(0xFFFF) if kind == GRAM else keys >> U(1)
    return ((part * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.int64) % shards


def by_shard(kind: int, keys: np.ndarray, shards: int):
    """(shard, places of its keys) for each shard that has keys; ``keys`` are sorted and stay so."""
    shard = sharded(kind, keys, shards)
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def batch_keys(batch: Batch, train: np.ndarray):
    """For grams and words: distinct keys and their training counts. Word keys lose their lowest bit for room."""
    yield GRAM, *counted(batch.grams, np.repeat(train, batch.symbols))
    ends = np.full(len(train), END_WORD, U)
    words = np.concatenate([batch.words >> U(1), ends])
    yield WORD, *counted(words, np.concatenate([np.repeat(train, batch.word_counts), train]))


def batches_of(docs: pa.Table):
    """(first row, texts) of a chunk's documents, about ``BATCH_BYTES`` at a time."""
    start, texts, size = 0, [], 0
    for piece in docs.column("text").chunks:
        for t in piece:
            texts.append(t.as_buffer().to_pybytes() if t.is_valid else None)
            size += len(texts[-1] or b"")
            if size >= BATCH_BYTES:
                yield start, texts
                start, texts, size = start + len(texts), [], 0
    if texts:
        yield start, texts


def chunk_keys(docs: pa.Table, train: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of a whole chunk, sorted, with their training counts."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros(0, U), np.zeros(0, np.int64)) for k in (GRAM, WORD)}
    sequences = Sequences()
    for start, texts in batches_of(docs):
        for kind, keys, n in batch_keys(Batch(texts, sequences), train[start : start + len(texts)]):
            merged, where = np.unique(np.concatenate([found[kind][0], keys]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([found[kind][1], n]), len(merged)).astype(np.int64)
            found[kind] = merged, counts
    return found


def _count(shards: int):
    def run(docs: pa.Table) -> pa.Table:
        train = docs.column("train").to_numpy().astype(bool)
        rows = {"kind": [], "shard": [], "keys": [], "counts": []}
        for kind, (keys, n) in chunk_keys(docs, train).items():
            for shard, places in by_shard(kind, keys, shards):
                rows["kind"].append(kind)
                rows["shard"].append(shard)
                rows["keys"].append(pack(np.diff(keys[places], prepend=U(0))))
                rows["counts"].append(pack(n[places].astype(np.uint32)))
        rows["chunk"] = [docs.column("chunk")[0].as_py()] * len(rows["kind"])
        return pa.table(rows, schema=COUNTS)

    return run


COUNTS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
VALUES = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("values", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _pairs(batches):
    """Training counts of (byte, next byte), summed over a partition."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for keys, n in zip(batch.column(0), batch.column(1)):
            key = np.cumsum(unpack(keys.as_py(), U))
            total += np.bincount((key & U(0xFFFF)).astype(np.int64), unpack(n.as_py(), np.uint32), 1 << 16).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])


class Contexts:
    """One order of the trie: grams with their counts, and per context the total, the kinds of symbols, and what the
    next shorter context has of those symbols."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = grams, counts
        context = grams >> U(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(grams) else np.zeros(0, np.int64)
        self.first, self.contexts = first, context[first]
        self.total = np.add.reduceat(counts, first) if len(first) else counts
        self.kinds = np.diff(np.r_[first, len(grams)])
        self.below = np.zeros(len(first), np.int64)

    @staticmethod
    def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
        return at, (known[at] == wanted) if len(known) else np.zeros(len(wanted), bool)

    def count(self, grams: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.grams, grams)
        return np.where(hit, self.counts[at], 0) if len(self.grams) else np.zeros(len(grams), np.int64)

    def shorter(self, order: int) -> "Contexts":
        """The contexts one byte shorter, from these counts."""
        grams, where = np.unique(self.grams & U((1 << (8 * order)) - 1), return_inverse=True)
        return Contexts(grams, np.bincount(where, self.counts, len(grams)).astype(np.int64))

    def look_below(self, order: int, lower: "Contexts") -> None:
        if len(self.grams):
            self.below = np.add.reduceat(lower.count(self.grams & U((1 << (8 * order)) - 1)), self.first)

    def facts(self, contexts: np.ndarray):
        """(total, kinds, below) of each context; zeros for an unknown one."""
        at, hit = self._find(self.contexts, contexts)
        if not len(self.contexts):
            return (np.zeros(len(contexts), np.int64),) * 3
        return tuple(np.where(hit, x[at], 0) for x in (self.total, self.kinds, self.below))


def gram_scores(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of every gram in ``keys`` after the others.

    ``keys`` are sorted, ``counts`` their training counts; all grams of the same two last context bytes are here.
    ``pairs`` has the training count of every (byte, next byte).
    """
    seen = counts > 0
    orders = {ORDER: Contexts(keys[seen], counts[seen])}
    for k in range(ORDER - 1, 1, -1):
        orders[k] = orders[k + 1].shorter(k + 1)
    some = np.flatnonzero(pairs)
    orders[1] = Contexts(some.astype(U), pairs[some])
    single = pairs.reshape(256, 256).sum(axis=0)
    orders[0] = Contexts(np.flatnonzero(single).astype(U), single[single > 0])
    for k in range(ORDER, 0, -1):
        orders[k].look_below(k, orders[k - 1])
    score = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    excluded, excluded_kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for k in range(ORDER, -1, -1):
        gram = keys & U((1 << (8 * (k + 1))) - 1)
        total, kinds, below = orders[k].facts(gram >> U(8))
        n = orders[k].count(gram)
        left, left_kinds = total - excluded, kinds - excluded_kinds
        works = open_ & (left_kinds > 0)
        hit = works & (n > 0)
        miss = works & ~hit
        score[hit] += np.log10((2 * n[hit] - 1) / (2 * left[hit]))
        score[miss] += np.log10(left_kinds[miss] / (2 * left[miss]))
        open_ &= ~hit
        excluded, excluded_kinds = below, kinds
    score[open_] -= np.log10(256 - excluded_kinds[open_])
    return score


def _answer(pairs):
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        questions = [np.cumsum(unpack(k.as_py(), U)) for k in asked.column("keys")]
        n = np.concatenate([unpack(c.as_py(), np.uint32) for c in asked.column("counts")]).astype(np.int64)
        keys, where = np.unique(np.concatenate(questions), return_inverse=True)
        counts = np.bincount(where, n, len(keys)).astype(np.int64)
        values = gram_scores(keys, counts, pairs.value) if kind == GRAM else counts.astype(np.uint64)
        answers = np.split(values[where], np.cumsum([len(q) for q in questions])[:-1])
        chunks = asked.column("chunk").to_pylist()
        rows = [{"kind": kind, "shard": shard, "chunk": c, "values": pack(a), "tokens": 0, "types": 0} for c, a in zip(chunks, answers)]
        if kind == WORD:
            rows[0] |= {"tokens": int(counts.sum()), "types": int((counts > 0).sum())}
        return pa.Table.from_pylist(rows, VALUES)

    return run


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def located(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and for every place which of them it has.

    A gram has 48 bits, so the 16 below take its place in a block; plain sorting is then much faster than by places.
    """
    distinct, which = distinct_keys(grams), np.empty(len(grams), np.uint32)
    for start in range(0, len(grams), 1 << 16):
        block = grams[start : start + (1 << 16)]
        block = np.sort((block << U(16)) | np.arange(len(block), dtype=U))
        place, gram = (block & U(0xFFFF)).astype(np.int64), block >> U(16)
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        which[start + place] = np.repeat(np.searchsorted(distinct, gram[first]), np.diff(np.r_[first, len(gram)]))
    return distinct, which


class Located:
    """Keys of all batches of a chunk: the distinct ones of each batch, and for every place which of them it has.

    Values are looked up for distinct keys in their order, and then dealt to the places.
    """

    def __init__(self) -> None:
        self.distinct: list[np.ndarray] = []
        self.which: list[np.ndarray] = []

    def add(self, distinct: np.ndarray, which: np.ndarray) -> None:
        self.distinct.append(distinct)
        self.which.append(which.astype(np.uint32, copy=False))

    def answered(self, kind: int, shards: int, given: dict, value: type):
        """For each batch the values of its places, from the shards' answers to the chunk's distinct keys."""
        keys = distinct_keys(np.concatenate(self.distinct))
        values = np.zeros(len(keys), value)
        for shard, places in by_shard(kind, keys, shards):
            values[places] = unpack(given[kind, shard], value)
        for distinct, which in zip(self.distinct, self.which):
            yield values[np.searchsorted(keys, distinct)][which]


def _score(shards: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        given = {(k, s): v for k, s, v in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "values")))}
        grams, words, sizes, sequences = Located(), Located(), [], Sequences()
        for _, texts in batches_of(docs):
            batch = Batch(texts, sequences)
            grams.add(*located(batch.grams))
            words.add(*np.unique(np.r_[batch.words >> U(1), U(END_WORD)], return_inverse=True))
            sizes.append((batch.symbols, batch.word_counts))
            del batch, texts
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "log_counts": [], "score": []}
        for (symbols, _), by_place in zip(sizes, grams.answered(GRAM, shards, given, np.float64)):
            out["score"].append(np.add.reduceat(by_place, np.cumsum(symbols) - symbols))
        for (_, word_counts), counts in zip(sizes, words.answered(WORD, shards, given, np.uint64)):
            c, end = counts[:-1].astype(np.float64), float(counts[-1])
            owner = np.repeat(np.arange(len(word_counts)), word_counts)
            out["log_counts"].append(np.bincount(owner, np.log10(c + 1), len(word_counts)) + np.log10(end + 1))
            out["n_known"].append(np.bincount(owner, c > 0, len(word_counts)).astype(np.int64) + (end > 0))
            out["n_tokens"].append(word_counts + 1)
        return pa.table(
            {
                "id": docs.column("id"),
                "held_out": pc.invert(docs.column("train")),
                **{name: np.concatenate(parts) for name, parts in out.items()},
            }
        )

    return run


def score_texts(
    df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = 24 << 20, shard_chunks: int = 2
) -> DataFrame:
    """For every row its ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``train`` says which rows the model learns from. ``chunk_bytes`` bounds what a task works on at once, ``shard_chunks``
    how many chunks' worth of distinct grams a shard has.
    """
    id_type = df.schema[key].dataType.simpleString()
    plain = df.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // chunk_bytes
    shards = 8 + chunks // shard_chunks
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    counts = written(
        dealt.groupBy("chunk").applyInArrow(
            _count(shards), "kind int, shard int, chunk long, keys binary, counts binary"
        ),
        "ppm-counts",
    )
    summed = counts.filter(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(_pairs, "pair int, n long")
    pairs = np.zeros(1 << 16, np.int64)
    for row in summed.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[row["pair"]] = row["n"]
    shared = df.sparkSession.sparkContext.broadcast(pairs)
    values = written(
        counts.groupBy("kind", "shard").applyInArrow(
            _answer(shared), "kind int, shard int, chunk long, values binary, tokens long, types long"
        ),
        "ppm-values",
    )
    totals = values.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    scored = (
        dealt.groupBy("chunk")
        .cogroup(values.select("kind", "shard", "chunk", "values").groupBy("chunk"))
        .applyInArrow(
            _score(shards),
            f"id {id_type}, held_out boolean, n_tokens long, n_known long, log_counts double, score double",
        )
    )
    return scored.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
    )


def op9_ppm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score_texts(docs, number % 7 != 2)
