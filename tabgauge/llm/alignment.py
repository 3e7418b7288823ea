"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, merged in lockstep.

Both token sequences of a document spell the same bytes. A pair of tokens whose byte ranges overlap is a link; a byte
offset at which a token of each side ends is a cut, and cuts part the tokens into groups that translate into each other.

All documents of a batch are merged at once. Every document is a lane (a long one is several, parted at common token
ends), and one pair of numpy arrays holds each lane's place on side A and side B. A step emits one link for every lane,
compares the two byte ends, emits a cut where they are equal, and advances the side that ends first, or both. Lanes
that have reached their end are compacted away, so a step costs as much as there are lanes left, and a batch takes as
many steps as its longest lane has links.

Tokens of either side never reach over a blank that follows anything but white space, so a batch is cut there into
words, each distinct word is tokenized once, and frequent ones are remembered from batch to batch.

How it scales: texts are tokenized and merged once; the result is written as a table, a row for each document, in
chunks of about ``chunk_bytes`` of text. A chunk names its distinct linked id pairs once, with the number of its
documents that hold each, so what is shuffled for the corpus-wide counts grows with distinct pairs per chunk, not with
tokens. Counts go back to the chunks by a join on the pair, and each chunk's documents meet them in one bounded group.
The best count of every A id is one number for each id of the vocabulary, and is broadcast: its size is bounded by it.

Cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an
empty digest. Repeated rows are documents of their own, also in the counts; a null id is an id like others. A very long
text is one document, a chunk of its own at most. An empty table gives an empty result. No other column takes part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from tabgauge.llm.common import table, written
from tabgauge.llm.token_counts import Counting, byte_letters

#: a lane of a long document has about so many A tokens, so a batch takes few steps with wide arrays
LANE = 512
#: how many words or pre-tokens a worker remembers, and how long they may be
REMEMBERED = 200_000
LONGEST = 64
#: a blank behind anything but white space; the first of two blanks at the start of a text is one too
CUT = re.compile(r" (?<!\s )")


def words(text: str) -> list[str]:
    """The words of a blank and ``text``, each without the blank that it starts with."""
    return CUT.split(" " + text)[1:]


class Remembered(dict):
    """Short strings and the bytes of their 32-bit ids, in a bounded memory; what was asked for last stays."""

    def __init__(self, encode, most: int = REMEMBERED) -> None:
        self.encode, self.most = encode, most

    def ask(self, strings: list[str]) -> list[bytes]:
        """The ids of each of ``strings``, which are distinct; the new ones are encoded together."""
        if len(self) > self.most:
            kept = {s: self[s] for s in strings if s in self}
            self.clear()
            self.update(kept)
        missing = [s for s in strings if s not in self]
        self.update(zip(missing, self.encode(missing)))
        found = list(map(self.__getitem__, strings))
        for s in missing:
            if len(s) > LONGEST:
                del self[s]
        return found


def dealt(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the strings at all places in ``at``, joined, and the bounds between places."""
    size = np.array(list(map(len, ids)), np.int64) // 4
    start, n = (np.cumsum(size) - size)[at], size[at]
    bounds = np.r_[0, np.cumsum(n)]
    places = np.repeat(start - bounds[:-1], n) + np.arange(bounds[-1])
    return np.frombuffer(b"".join(ids), np.uint32)[places], bounds


def slices(ids: np.ndarray, lengths: np.ndarray, sizes: list[int]) -> list[bytes]:
    """The bytes of the ids that spell each of some bodies of ``sizes`` bytes, from the ids that spell all of them."""
    ends = np.r_[0, np.cumsum(lengths[ids])]
    at = (4 * np.searchsorted(ends, np.cumsum([0, *sizes]))).tolist()
    data = ids.tobytes()
    return [data[a:b] for a, b in zip(at, at[1:])]


def ids_of(parts: list[list[int]], spelled: list[bytes], lengths: np.ndarray, bodies: list[bytes]) -> list[bytes]:
    """The bytes of each part's ids; none where they do not spell its body."""
    flat = list(chain.from_iterable(parts))
    sizes = list(map(len, bodies))
    if b"".join(map(spelled.__getitem__, flat)) == b"".join(bodies):
        ids = np.array(flat, np.uint32)
        ends = np.r_[0, np.cumsum(lengths[ids])]
        if np.array_equal(ends[np.cumsum([0, *map(len, parts)])], np.cumsum([0, *sizes])):
            return slices(ids, lengths, sizes)
    return [
        np.array(part, np.uint32).tobytes() if b"".join(map(spelled.__getitem__, part)) == body else b""
        for part, body in zip(parts, bodies)
    ]


class ByteLevel:
    """Side A: a byte-level BPE of a ``tokenizers`` file, over a blank and the text. Special strings are plain text.

    Merging never crosses a pre-token, and no pre-token has white space behind anything else.
    """

    by_words = True

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.cutter = Counting(f.read(), proven=frozenset())
        self.model = self.cutter.tokenizer.model
        back = {letter: b for b, letter in byte_letters().items()}
        vocabulary = self.cutter.tokenizer.get_vocab(with_added_tokens=False)
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            known = all(c in back for c in entry)
            self.spelled[i] = bytes(back[c] for c in entry) if known else entry.encode()
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.words, self.pre_tokens = Remembered(self._words), Remembered(self._merged)

    def _merged(self, pre_tokens: list[str]) -> list[bytes]:
        bodies = [p.encode() for p in pre_tokens]
        letters = b"".join(bodies).decode("latin-1").translate(self.cutter.letters)  # one for each byte
        ends = np.cumsum([0, *map(len, bodies)]).tolist()
        parts = [[t.id for t in self.model.tokenize(letters[a:b])] for a, b in zip(ends, ends[1:])]
        return ids_of(parts, self.spelled, self.lengths, bodies)

    @staticmethod
    def _joined(pre_tokens: list[str], known: dict[str, bytes]) -> bytes:
        parts = list(map(known.__getitem__, pre_tokens))
        return b"".join(parts) if all(parts) else b""

    def _words(self, found: list[str]) -> list[bytes]:
        is_plain = [bool(m) for m in map(self.cutter.plain.fullmatch, found)]
        plain = list(compress(found, is_plain))
        # plain words are cut as one text; where the library cuts, the text it would scan again and again stays short
        cut = [self.cutter.pre_tokens(" " + " ".join(plain))] if plain else []
        cut += [self.cutter.pre_tokens(" " + w) for w, is_p in zip(found, is_plain) if not is_p]
        distinct = list(set(chain.from_iterable(cut)))
        known = dict(zip(distinct, self.pre_tokens.ask(distinct)))
        merged = [self._joined(c, known) for c in cut]
        sizes = [len(w.encode()) + 1 for w in plain]
        if plain:
            ids = np.frombuffer(merged[0], np.uint32)
            if len(ids):
                merged[:1] = slices(ids, self.lengths, sizes)
            else:  # some are not spelled
                merged[:1] = [self._joined(self.cutter.pre_tokens(" " + w), known) for w in plain]
        done, others = iter(merged[: len(plain)]), iter(merged[len(plain) :])
        return [next(done if p else others) for p in is_plain]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a blank and ``text``; none where they do not spell it."""
        cut = words(text)
        distinct = list(set(cut))
        known = dict(zip(distinct, self.words.ask(distinct)))
        return np.frombuffer(self._joined(cut, known), np.uint32)


class Pieces:
    """Side B: a ``sentencepiece`` model with byte fallback, which puts the blank in front by itself.

    Where no piece has a blank behind anything else, merging never crosses one there. Other models encode whole texts.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.spelled = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.by_words = self._merges_as_it_stands() and not any(re.search("[^▁]▁", piece) for piece in pieces)
        self.words = Remembered(self._words)
        self.blank = self.model.encode("a ")[len(self.model.encode("a")) :]

    def _merges_as_it_stands(self) -> bool:
        """Whether the model merges pairs in texts that it changes in nothing but their blanks."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # it needs protobuf
            return False
        model = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        normalizer, piece = model.normalizer_spec, model.SentencePiece
        return (
            model.trainer_spec.model_type == model.trainer_spec.BPE
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not normalizer.precompiled_charsmap
            and normalizer.add_dummy_prefix
            and not normalizer.remove_extra_whitespaces
            and normalizer.escape_whitespaces
            and not any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces)
        )

    def _words(self, found: list[str]) -> list[bytes]:
        """The ids of each word after the blank that the model adds; none where they do not spell it."""
        parts = self.model.encode(found, num_threads=1) if found else []
        parts = [part if w else self.blank for w, part in zip(found, parts)]  # no text gets no blank in front
        return ids_of(parts, self.spelled, self.lengths, [b" " + w.encode() for w in found])

    def whole(self, text: str) -> bytes:
        return ids_of([self.model.encode(text)], self.spelled, self.lengths, [b" " + text.encode()])[0]


class Merged(NamedTuple):
    """Links of a batch in reading order, as places in the joined token arrays, and which of them end in a cut."""

    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray


def lanes(a_end: np.ndarray, b_end: np.ndarray, doc_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places on side A and B at which lanes end (exclusive): all document ends, and common ends about ``lane`` apart.

    ``a_end`` and ``b_end`` are byte ends of all tokens, counted over the whole batch; ``doc_a`` is the place after
    each document's last A token.
    """
    tries = np.arange(lane - 1, len(a_end), lane)
    found = [doc_a]
    for _ in range(lane):  # a place is moved on until both sides end there; the next place stops it
        at = np.searchsorted(b_end, a_end[tries])
        common = b_end[np.minimum(at, len(b_end) - 1)] == a_end[tries]
        found.append(tries[common] + 1)
        tries = tries[~common] + 1
        tries = tries[tries < len(a_end)]
        if not len(tries):
            break
    stop_a = np.unique(np.concatenate(found))
    return stop_a, np.searchsorted(b_end, a_end[stop_a - 1]) + 1


def merge(a_end: np.ndarray, b_end: np.ndarray, doc_a: np.ndarray, lane: int = LANE) -> Merged:
    """Advance the A and B pointers of all lanes together until every lane has ended."""
    stop_a, stop_b = lanes(a_end, b_end, doc_a, lane)
    a, b = np.r_[0, stop_a[:-1]], np.r_[0, stop_b[:-1]]
    # a link's place in reading order is a + b: each step raises it, so links need no sort afterwards
    n = len(a_end) + len(b_end)
    link_a, cuts = np.full(n, -1, np.int64), np.zeros(n, bool)
    while len(a):
        ea, eb = a_end[a], b_end[b]
        at, cut = a + b, ea == eb
        link_a[at] = a
        cuts[at] = cut
        a = a + (ea <= eb)
        b = b + (eb <= ea)
        left = a < stop_a  # a lane ends on both sides at once
        if not left.all():
            a, b, stop_a = a[left], b[left], stop_a[left]
    at = np.flatnonzero(link_a >= 0)
    return Merged(link_a[at], at - link_a[at], cuts[at])


class Aligner:
    """Tokenizes and aligns batches of texts."""

    def __init__(self, file_a: str, file_b: str) -> None:
        self.a, self.b = ByteLevel(file_a), Pieces(file_b)
        self.n_a, self.n_b = len(self.a.spelled), len(self.b.spelled)
        # every id with what may follow it: a comma, a bar after a group's last A token, a semicolon after its last
        # B token, nothing at the end of a document
        sides = ((self.n_a, ",|"), (self.n_b, (",", ";", "")))
        self.written = [f"{i}{sign}" for n, signs in sides for sign in signs for i in range(n)]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of every text, and none of either for texts that a side does not spell."""
        cut = [words(t) if t else [] for t in texts]
        ends = np.cumsum([0, *map(len, cut)])
        coded = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        del cut
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        (a, a_at), (b, b_at) = (
            dealt(side.words.ask(distinct) if side.by_words else [b""] * len(distinct), at) for side in (self.a, self.b)
        )
        # words that are not spelled have no ids
        lost = np.diff(a_at) == 0
        if self.b.by_words:
            lost |= np.diff(b_at) == 0
        lost = np.diff(np.r_[0, np.cumsum(lost)][ends]) > 0
        a_at, b_at = a_at[ends], b_at[ends]
        out = []
        none = np.zeros(0, np.uint32)
        for i, t in enumerate(texts):
            left = none if lost[i] else a[a_at[i] : a_at[i + 1]]
            right = b[b_at[i] : b_at[i + 1]] if self.b.by_words or not t else np.frombuffer(self.b.whole(t), np.uint32)
            out.append((left, right) if len(left) and len(right) else (none, none))
        return out

    def align(self, texts: list[str | None], lane: int = LANE) -> dict[str, list]:
        """For each text its counts, digest, and distinct linked pairs (a * n_b + b) with how often they are linked."""
        found = self.tokens(texts)
        size_a, size_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
        a_at, b_at = np.r_[0, np.cumsum(size_a)], np.r_[0, np.cumsum(size_b)]
        none = np.zeros(0, np.int64)
        a_tok, b_tok = (np.concatenate([none, *(x[k] for x in found)]) for k in (0, 1))
        del found
        m = Merged(none, none, np.zeros(0, bool))
        if len(a_tok):
            a_end, b_end = np.cumsum(self.a.lengths[a_tok]), np.cumsum(self.b.lengths[b_tok])
            m = merge(a_end, b_end, a_at[1:][size_a > 0], lane)
            del a_end, b_end
        # the last tokens of every group, and for each token how many groups end before it
        cut_a, cut_b = m.a[m.cut], m.b[m.cut]
        last_a, last_b = np.zeros(len(a_tok), np.int64), np.zeros(len(b_tok), np.int64)
        last_a[cut_a] = last_b[cut_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        last_b[b_at[1:][size_b > 0] - 1] = 2
        # the order of "a1,a2|b1;a3|b2,b3": an A token stands behind the B tokens of earlier groups, and so on
        codes = np.empty(len(a_tok) + len(b_tok), np.int64)
        codes[np.arange(len(a_tok)) + np.r_[0, cut_b + 1][group_a]] = last_a * self.n_a + a_tok
        codes[np.arange(len(b_tok)) + (cut_a + 1)[group_b]] = 2 * self.n_a + last_b * self.n_b + b_tok
        del group_a, group_b, last_a, last_b
        link_at = np.searchsorted(m.a, a_at)
        group_at = np.searchsorted(cut_a, a_at)
        pair = a_tok[m.a] * self.n_b + b_tok[m.b]
        spelling = self.written.__getitem__
        out = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
        for i in range(len(texts)):
            spelled = "".join(map(spelling, codes[a_at[i] + b_at[i] : a_at[i + 1] + b_at[i + 1]].tolist()))
            pairs, times = np.unique(pair[link_at[i] : link_at[i + 1]], return_counts=True)
            out["n_a"].append(int(size_a[i]))
            out["n_b"].append(int(size_b[i]))
            out["n_groups"].append(int(group_at[i + 1] - group_at[i]))
            out["n_links"].append(int(link_at[i + 1] - link_at[i]))
            out["groups_sha256"].append(hashlib.sha256(spelled.encode()).hexdigest() if spelled else "")
            out["pairs"].append(pairs)
            out["times"].append(times.astype(np.int32))
        return out


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ALIGNED = f"chunk string, id {{id}}, {_COUNTS}, place array<int>, times array<int>, pairs array<long>, docs array<int>"


def _aligned(files: tuple[str, str], chunk_bytes: int, id_type: pa.DataType):
    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
        flat = np.concatenate(values) if values else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype())))

    def rows(aligner: Aligner, ids: list, texts: list) -> pa.RecordBatch:
        out = aligner.align(texts)
        pairs, docs = np.unique(np.concatenate(out["pairs"]), return_counts=True)
        places = [np.searchsorted(pairs, p) for p in out["pairs"]]
        n, none = len(ids), np.zeros(0, np.int64)
        # the chunk's own row comes last: its distinct pairs, and how many of its documents hold each
        name = uuid.uuid4().hex
        columns = {
            "chunk": pa.array([name] * (n + 1)),
            "id": pa.array([*ids, None], id_type),
            **{k: pa.array([*out[k], None], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")},
            "groups_sha256": pa.array([*out["groups_sha256"], None], pa.string()),
            "place": lists([*places, none], pa.int32()),
            "times": lists([*out["times"], none], pa.int32()),
            "pairs": lists([none] * n + [pairs], pa.int64()),
            "docs": lists([none] * n + [docs], pa.int32()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files)
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 64
                if size >= chunk_bytes:
                    yield rows(aligner, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield rows(aligner, ids, texts)

    return run


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk, and (place, n, best) of its pairs: for each document the sums over its links."""
    size = right.num_rows
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = right.column("place").to_numpy()
    n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
    places = left.column("place").combine_chunks()
    times = left.column("times").combine_chunks()
    at = places.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    flat, t = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = [np.r_[0, np.cumsum(t * x[flat])] if size else np.zeros(len(flat) + 1, np.int64) for x in (best, n)]
    out = left.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    for name, s in zip(("n_best", "count_sum"), sums):
        out = out.append_column(name, pa.array(s[at[1:]] - s[at[:-1]], pa.int64()))
    return out


def align_tokens(
    df: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = 2 << 20
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    Documents: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: (a, b, n, best), the
    linked id pairs, how many documents hold each, and whether that is the most that any pair of the A id has: a
    dictionary from one vocabulary into the other.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = df.schema[key].dataType
    n_b = sentencepiece.SentencePieceProcessor(model_file=file_b).get_piece_size()
    plain = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = _ALIGNED.format(id=id_type.simpleString())
    aligned = written(
        plain.mapInArrow(_aligned((file_a, file_b), chunk_bytes, to_arrow_type(id_type)), schema), "aligned"
    )
    held = aligned.filter(F.size("pairs") > 0).select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    counts = held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.docs").cast("bigint")).alias("n"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("most"))
    marked = counts.select("pair", F.expr(f"pair div {n_b}").alias("a"), "n").join(F.broadcast(most), "a")  # one per A id
    marked = marked.select("pair", "a", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    answers = held.select("chunk", "place", F.col("x.pairs").alias("pair")).join(marked.select("pair", "n", "best"), "pair")
    documents = aligned.filter(F.col("n_a").isNotNull()).select("chunk", "id", *_names(_COUNTS), "place", "times")
    out = (
        documents.groupBy("chunk")
        .cogroup(answers.select(F.col("chunk").alias("asked"), "place", "n", "best").groupBy("asked"))
        .applyInArrow(_counted, f"id {id_type.simpleString()}, {_COUNTS}, n_best long, count_sum long")
    )
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    pairs = marked.select("a", F.expr(f"pair % {n_b}").alias("b"), "n", (F.col("best") == 1).alias("best"))
    return out.select(F.col("id").alias(key), *names), pairs


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    documents, _ = align_tokens(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return documents
