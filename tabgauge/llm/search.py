"""Ranked lexical search with per-term geometric blocking.

Every document has a vector over the terms asked for: what the term adds to the document's score. For each term the
documents that hold it, its posting list, are clustered by the similarity of those vectors into blocks, so that a block
holds documents that look alike in all terms, not only in this one. A block's summary is the coordinatewise maximum of
its vectors. For a query that has the term, the sum of the summary over the query's terms is an upper bound of every
score in the block, exactly, in whole numbers; terms are taken from the rarest on, and since a document that holds an
earlier term was dealt with among that term's blocks, the sum is over the terms from this one on. A block is skipped
only when that bound is below the query's tenth best score so far. All other blocks are scored document by document
from the vectors. A document with a score above 0
holds a term of the query, so it stands in a block of one of its terms: nothing is missed.

Similarity is measured between vectors folded to ``FOLDED`` signed numbers; it decides only which documents share a
block, never a result.

Scores are whole numbers below 2**53, so sums in doubles are exact.

How it scales: documents are read once and written as forward rows (id, length, terms asked for, frequencies), from
which Spark sums N, L and the document frequencies, with partial sums in every task. Queries go to the documents, not
documents to the queries: each task builds blocks for bounded chunks of its documents, keeps the best ``k`` of each
query over its chunks, and hands only these on; a window takes the best of them. No posting list crosses the network
and none is ever whole in one place, however frequent its term. Queries are a stated set: they go out in rounds of at
most ``round_bytes`` of text by the hash of their id, one round after the other over all documents, so what is
broadcast is bounded.

Cases: null texts and texts without a term match nothing and count for nothing; rows that repeat an id are documents of
their own; a null document id is larger than every other; items with the same id (null too) are one item with the terms
of all of them; very long texts are ranked whole; empty tables give an empty result; no other column takes part.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabgauge.llm.common import table, written

# Terms are runs of ASCII letters, digits and all bytes beyond ASCII, with A-Z lower-cased.
_TERM = frozenset((string.ascii_letters + string.digits).encode()) | frozenset(range(128, 256))
TERMS = bytes(ord(chr(b).lower()) if b in _TERM and b < 128 else b if b in _TERM else 32 for b in range(256))

#: numbers that a document's vector is folded to before documents are compared
FOLDED = 16
#: documents of a block, on average
BLOCK = 32
#: bounds of a chunk that is blocked and searched at once: documents, and entries of their vectors
CHUNK_DOCS, CHUNK_ENTRIES = 4096, 400_000
LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


def _forward(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, counts = [], [], []
            for t in batch.column(1).to_pylist():
                words = terms(t)
                known = np.fromiter((i for i in map(vocabulary.get, words) if i is not None), np.int32)
                ids, n = np.unique(known, return_counts=True)
                sizes.append(len(words))
                found.append(ids)
                counts.append(n.astype(np.int32))
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32)))
                for x in (found, counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "counts"]
            )

    return run


class Chunk:
    """Documents as sparse vectors: ids, and for each its terms and what they add to a score."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> None:
        self.ids, self.start, self.term, self.value, self.n_terms = ids, start, term, value, n_terms
        size = np.diff(start)
        self.row = np.repeat(np.arange(len(ids)), size)
        signs = np.random.default_rng(7).choice([-1.0, 1.0], (n_terms, FOLDED))
        self.folded = np.zeros((len(ids), FOLDED))
        some = np.flatnonzero(size)
        if len(some):
            self.folded[some] = np.add.reduceat(value[:, None] * signs[term], start[some])
        self.folded /= np.maximum(np.linalg.norm(self.folded, axis=1, keepdims=True), 1e-9)
        order = np.argsort(term, kind="stable")
        self.by_term = self.row[order]
        self.edges = np.searchsorted(term[order], np.arange(n_terms + 1))

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``docs``, place of the entry) for all entries of the documents."""
        size = self.start[docs + 1] - self.start[docs]
        which = np.repeat(np.arange(len(docs)), size)
        return which, np.arange(len(which)) + np.repeat(self.start[docs] - np.r_[0, np.cumsum(size)[:-1]], size)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's posting list clustered: (documents, block of each), blocks numbered from 0."""
        docs = self.by_term[self.edges[term] : self.edges[term + 1]]
        n = -(-len(docs) // BLOCK)
        if n <= 1:
            return docs, np.zeros(len(docs), np.int64)
        centres = self.folded[docs[:: max(1, len(docs) // n)][:n]]
        near = np.argmax(self.folded[docs] @ centres.T, axis=1)
        return docs, np.unique(near, return_inverse=True)[1]

    def summaries(self, docs: np.ndarray, block: np.ndarray, wanted: np.ndarray, n_wanted: int) -> np.ndarray:
        """Coordinatewise maximum over the vectors of each block, on the terms that ``wanted`` numbers from 0."""
        which, place = self.entries(docs)
        column = wanted[self.term[place]]
        keep = column >= 0
        cell = block[which[keep]] * n_wanted + column[keep]
        out = np.zeros((int(block.max()) + 1) * n_wanted)
        np.maximum.at(out, cell, self.value[place[keep]])
        return out.reshape(-1, n_wanted)


class Best:
    """The best ``k`` (score, id) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.full((queries, k), LAST, np.int64)
        self.null = np.zeros((queries, k), bool)

    def least(self) -> np.ndarray:
        """What a score must reach to be among the best; 1 while there are fewer than ``k``."""
        return np.maximum(self.score[:, -1], 1)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = (np.concatenate(x) for x in ((self.score[query], score), (self.id[query], ids), (self.null[query], null)))
        order = np.lexsort((i, n, -s))[: self.k]
        self.score[query], self.id[query], self.null[query] = s[order], i[order], n[order]


class Searcher:
    """Blocks chunks and searches them for all queries."""

    def __init__(self, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_all: int, k: int) -> None:
        self.weights, self.n_docs, self.n_all = weights, n_docs, n_all
        self.queries = [np.array(q, np.int64) for q in queries]
        self.best = Best(len(queries), k)
        self.asking: list[list[int]] = [[] for _ in weights]
        for q, ts in enumerate(queries):
            for t in ts:
                self.asking[t].append(q)
        # rare terms first: their blocks raise the bounds that the frequent terms' blocks must pass
        self.order = np.argsort(-weights, kind="stable")
        self.turn = np.argsort(self.order)
        self.scored = self.skipped = 0

    def values(self, n: np.ndarray, size: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        m = 10 + (90 * n * self.n_docs) // self.n_all
        tf = count.astype(np.int64)
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))

    def search(self, chunk: Chunk, null: np.ndarray) -> None:
        """Term by term over all queries that have it.

        A document that also holds a query's earlier term was in a block of that term, and was scored or ruled out
        there. What is left to find in a term's blocks holds none of the earlier terms, so the bound sums the summary
        over the query's terms from this one on.
        """
        seen = np.zeros((len(self.queries), len(chunk.ids)), bool)
        wanted = np.full(chunk.n_terms, -1, np.int64)
        for t in self.order:
            asking = self.asking[t]
            if not asking or chunk.edges[t] == chunk.edges[t + 1]:
                continue
            docs, block = chunk.blocks(t)
            columns = np.unique(np.concatenate([self.queries[q] for q in asking]))
            columns = columns[np.argsort(self.turn[columns])]
            late = np.searchsorted(self.turn[columns], self.turn[t])  # columns from here on have not had their turn
            chosen = np.zeros((len(columns), len(asking)))
            wanted[columns] = np.arange(len(columns))
            for j, q in enumerate(asking):
                chosen[wanted[self.queries[q]], j] = 1
            wanted[columns] -= late
            bound = chunk.summaries(docs, block, wanted, len(columns) - late) @ chosen[late:]
            wanted[columns] += late
            least = self.best.least()[asking]
            open_ = bound >= least
            self.scored += int(open_.sum())
            self.skipped += int((~open_).sum())
            if open_.any():
                self._score(chunk, docs, block, open_, asking, wanted, chosen, seen, null)
            wanted[columns] = -1

    def _score(self, chunk, docs, block, open_, asking, wanted, chosen, seen, null) -> None:
        """Score the documents of open blocks, and keep what reaches a query's least."""
        docs_open = open_.any(axis=1)[block]
        here, of = docs[docs_open], block[docs_open]
        which, place = chunk.entries(here)
        column = wanted[chunk.term[place]]
        keep = column >= 0
        vectors = np.zeros((len(here), len(chosen)))
        vectors[which[keep], column[keep]] = chunk.value[place[keep]]
        scores = (vectors @ chosen).astype(np.int64)
        hit = open_[of] & (scores >= self.best.least()[asking]) & ~seen[np.ix_(asking, here)].T
        for j in np.flatnonzero(hit.any(axis=0)):
            rows = np.flatnonzero(hit[:, j])
            seen[asking[j], here[rows]] = True
            self.best.add(asking[j], scores[rows, j], chunk.ids[here[rows]], null[here[rows]])


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_all = shared.value
        searcher = Searcher(queries, weights, n_docs, n_all, k)
        for batch in batches:
            for part in _chunks(batch):
                ids = part.column(0)
                lists = part.column(2)
                start = lists.offsets.to_numpy().astype(np.int64)
                start -= start[0]
                term = lists.flatten().to_numpy().astype(np.int64)
                value = searcher.values(part.column(1).to_numpy(), np.diff(start), term, part.column(3).flatten().to_numpy())
                null = np.asarray(ids.is_null())
                numbers = ids.fill_null(LAST).to_numpy()
                searcher.search(Chunk(numbers, start, term, value, len(weights)), null)
        b = searcher.best
        query, rank = np.nonzero(b.score)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query.astype(np.int32)),
                pa.array(b.id[query, rank], pa.int64(), mask=b.null[query, rank]),
                pa.array(b.score[query, rank]),
            ],
            names=["query", "id", "score"],
        )

    return run


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows within the bounds of a chunk; a row beyond them is a chunk of its own."""
    entries = np.diff(batch.column(2).offsets.to_numpy())
    begin = held = 0
    for i, n in enumerate(entries.tolist()):
        if i > begin and (i - begin >= CHUNK_DOCS or held + n > CHUNK_ENTRIES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    round_bytes: int = 16 << 20,
) -> DataFrame:
    """(item, rank, key, score) of the ``k`` best documents of every item; keys of documents are long."""
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    rounds = -(-size // round_bytes) or 1
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    out = None
    for r in range(rounds):
        found = _one_round(plain, asked.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r), k)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def _one_round(plain: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = plain.sparkSession
    rows = asked.groupBy("item").agg(F.array_sort(F.collect_set("text")).alias("texts")).orderBy("item").collect()
    vocabulary: dict[bytes, int] = {}
    queries = []
    for row in rows:  # one round of queries, bounded by round_bytes
        found = {vocabulary.setdefault(t, len(vocabulary)) for x in row["texts"] for t in terms(x)}
        queries.append(sorted(found))
    forward = written(plain.mapInArrow(_forward(vocabulary), "id long, n long, terms array<int>, counts array<int>"), "forward")
    n_docs, n_all = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row for a term asked for
    df = np.zeros(len(vocabulary), np.int64)
    for row in held:
        df[row["t"]] = row["count"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((queries, weights, n_docs, max(n_all, 1)))
    local = forward.filter(F.size("terms") > 0).mapInArrow(_searched(shared, k), "query int, id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(rows)], f"query int, item {asked.schema['item'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "query").select("item", "rank", "id", "score")  # at most round_bytes


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), size as (select count(*) filter (len(w) > 0) as nn, sum(len(w))::bigint as ll from d
), p as (
  select doc_id, len(w)::bigint as n, term, count(*) as tf
  from (select doc_id, w, unnest(w) as term from d) where term in (select term from b) group by doc_id, len(w), term
), df as (
  select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
  from p, size group by term, nn
), parts as (
  select doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) as part
  from p join df using (term), size
), scores as (
  select item_id, doc_id, sum(part)::bigint as score from parts join b using (term) group by item_id, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scores where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
