"""Token counts by the whole-token shortcut.

Byte-pair merging never crosses a pre-token, so a pre-token's count depends on its text alone. Once, offline, every
string of the vocabulary is encoded alone: those that give exactly one token are proven whole. Counting a document then
cuts it into pre-tokens, counts the proven ones as one token each by a set look-up, and merges only the rest, whose
counts are remembered in a bounded memory.

The cut is made by the tokenizer's own pattern on texts of letters and signs that every version of Unicode classes
alike; texts with other characters are cut by the library itself. Strings of added tokens inside a text are one token
each, as is the library's default.

How it scales: one pass over the texts and no shuffle. What goes to the executors is the vocabulary file and the proven
strings, both bounded by the vocabulary.

Cases: null and empty text have no bytes and no tokens; repeated rows are counted each on its own; very long texts are
counted whole; an empty table gives an empty result; no other column takes part, so names cannot clash.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tabgauge.llm.common import table

# The pattern that cuts text into pre-tokens, with the white space of the plain characters written out.
WHITE = r"\t-\r \x85\xa0"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+"
    r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)
#: characters that the fast cut is for: Latin, Greek and Cyrillic blocks and common punctuation
PLAIN = r"[\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac]*+"
#: how many counts of merged pre-tokens a worker remembers
REMEMBERED = 500_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable bytes of Latin-1 stand for themselves; the others are numbered from 256 on.
    """
    letters, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class Counting:
    """Counts tokens of texts for one tokenizer file with a byte-level BPE model."""

    def __init__(self, definition: str, proven: frozenset[str] | None = None) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(definition)
        pre = parsed.get("pre_tokenizer") or {}
        added = parsed.get("added_tokens") or []
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or parsed.get("normalizer"):
            raise ValueError("the shortcut is for byte-level BPE without a normalizer or a prefix space")
        if pre.get("use_regex", True) is False:
            raise ValueError("the shortcut is for tokenizers that cut by the byte-level pattern")
        self.whole_text = not plain  # added tokens with side conditions: leave the text to the library
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.letters = str.maketrans(byte_letters())
        self.cut = regex.compile(PRE_TOKEN)
        self.plain = regex.compile(PLAIN)
        self.remembered: dict[str, int] = {}
        self.proven = self.prove() if proven is None else proven

    def merged(self, pre_token: str) -> int:
        """Tokens of one pre-token by the model's own merging."""
        return len(self.tokenizer.model.tokenize(pre_token.encode().decode("latin-1").translate(self.letters)))

    def prove(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        back = {v: k for k, v in byte_letters().items()}
        found = set()
        for entry in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(back[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a character, never a pre-token
            if text and self.pre_tokens(text) == [text] and self.merged(text) == 1:
                found.add(text)
        return frozenset(found)

    def pre_tokens(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.cut.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.whole_text:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, total = [text], 0
        if self.added is not None and self.added.search(text):
            total = sum(1 for _ in self.added.finditer(text))
            parts = self.added.split(text)
        for part in parts:
            rest = Counter(self.pre_tokens(part))
            for pre_token, n in rest.items():
                if pre_token in self.proven:
                    total += n
                    continue
                one = self.remembered.get(pre_token)
                if one is None:
                    if len(self.remembered) >= REMEMBERED:
                        self.remembered.clear()
                    one = self.remembered[pre_token] = self.merged(pre_token)
                total += n * one
        return total


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array([len(t.encode()) for t in texts], np.int64)),
                    pa.array(np.array([counting.count(t) for t in texts], np.int64)),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(df: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", limit: int = 512):
    """For every row its ``key``, n_bytes, n_tokens (long) and over_limit."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    shared = df.sparkSession.sparkContext.broadcast((definition, Counting(definition).proven))
    schema = f"id {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long"
    plain = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    counted = plain.mapInArrow(_counts(shared), schema)
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
