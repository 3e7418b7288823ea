"""Every registered training-data query: against its SQL, or against a plain version, on whole tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from compare import connect, difference, duck_bag, plan_text, spark_bag

from tabgauge.llm import ppm, token_counts
from tabgauge.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text"]).to_pylist()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert "CartesianProduct" not in plan_text(df)
    assert difference(spark_bag(df), duck_bag(connect(sf_dir), ORACLES[name])) is None


@pytest.mark.parametrize("name", ["op4_line_templates", "op6_decontaminate", "op7_quality_rules"])
def test_native_plans_run_no_python(spark, sf_dir, name):
    plan = plan_text(QUERIES[name](spark, sf_dir))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_token_counts_match_the_library(spark, sf_dir, documents):
    tokenizer = token_counts.Tokenizer.from_file(token_counts.public_tokenizers.path("byte_bpe_50k.json"))
    encoded = tokenizer.encode_batch([d["text"] or "" for d in documents], add_special_tokens=False)
    wanted = {
        d["doc_id"]: (len((d["text"] or "").encode()), len(e.ids), len(e.ids) > 512) for d, e in zip(documents, encoded)
    }
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    assert got == wanted


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=3):
    """Smallest id reachable over pairs within the radius, by comparing all."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= radius):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_all_pairs(spark, sf_dir, documents):
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in documents}
    named = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", named[i]) for i in prints}
    assert any(named[i] != i for i in named)


class PlainModel:
    """Prediction by partial matching, symbol by symbol over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.trie = [defaultdict(Counter) for _ in range(order + 1)]
        for b in texts:
            for j in range(order, len(b)):
                for o in range(order + 1):
                    self.trie[o][b[j - o : j]][b[j]] += 1

    def log10(self, context, symbol):
        excluded, out = set(), 0.0
        for o in range(self.order, -1, -1):
            seen = self.trie[o].get(context[len(context) - o :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if left:
                total = sum(left.values())
                if symbol in left:
                    return out + math.log10((2 * left[symbol] - 1) / (2 * total))
                out += math.log10(len(left) / (2 * total))
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))


def test_scores_match_the_plain_model(spark, sf_dir, documents):
    pad = bytes([ppm.END])
    train = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2 for d in documents}
    text = {d["doc_id"]: pad * ppm.ORDER + (d["text"] or "").encode().lower() + pad for d in documents}
    tokens = {d["doc_id"]: [*(d["text"] or "").encode().lower().split(), None] for d in documents}
    counts = Counter(t for i in text if train[i] for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    model = PlainModel([text[i] for i in text if train[i]], ppm.ORDER)
    got = {r["doc_id"]: r for r in QUERIES["op9_ppm"](spark, sf_dir).collect()}
    assert set(got) == set(text)
    for i, b in text.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (not train[i], len(tokens[i]), n)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens[i]))
        if i % 4 == 0:
            o = ppm.ORDER
            assert r["score"] == pytest.approx(sum(model.log10(b[j - o : j], b[j]) for j in range(o, len(b))))


def test_the_model_is_a_distribution_and_learns(spark, sf_dir, documents):
    pad = bytes([ppm.END])
    model = PlainModel([pad * 5 + (d["text"] or "").encode().lower() + pad for d in documents[:60]], 5)
    for context in (pad * 5, b" then", b"zzqxx", b"e the"):
        assert sum(10 ** model.log10(context, s) for s in range(256)) == pytest.approx(1.0)
    rows = [r for r in QUERIES["op9_ppm"](spark, sf_dir).collect() if r["held_out"]]
    uniform = sum(-math.log10(256) * (len((d["text"] or "").encode()) + 1) for d in documents if d["doc_id"] in {r["doc_id"] for r in rows})
    assert sum(r["score"] for r in rows) > 0.6 * uniform
