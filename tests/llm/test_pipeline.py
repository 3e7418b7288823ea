"""The corpus pipeline against a plain version of every stage."""

import re

import pyarrow.parquet as pq
from test_llm_queries import plain_components, plain_fingerprint

import corpus_pipeline
from compare import connect
from tabgauge.llm import line_templates, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_pass_on_documents(spark, sf_dir, tmp_path):
    """Each stage on the rows before it, checked by SQL or by brute force on those same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    con = connect(sf_dir)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == COLUMNS
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "quality_rules":
            kept = {r[0] for r in con.execute(f"select doc_id from ({quality.SQL}) where kept").fetchall()}
            assert set(after) == kept
        elif name == "line_dedup":
            con.register("before", docs_table(before))
            sql = line_templates.SQL.replace("from documents", "from before")
            dropped = {r[0]: r[1] for r in con.execute(f"select doc_id, n_dropped from ({sql})").fetchall()}
            for i, r in before.items():
                if not dropped[i]:
                    assert after[i]["text"] == r["text"]
                elif i in after:
                    assert len(r["text"].split("\n")) - dropped[i] <= len(after[i]["text"].split("\n"))
            assert set(before) - set(after) <= {i for i in dropped if dropped[i]}
        elif name == "near_dedup":
            named = plain_components({i: plain_fingerprint(r["text"]) for i, r in before.items()})
            assert set(after) == {i for i, c in named.items() if i == c}
        elif name == "decontamination":
            def norm(t):
                return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
            grams = set()
            for item in benchmark:
                w = norm(item["text"])
                k = min(10, len(w))
                grams |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1) if w}
            sizes = {len(g) for g in grams}
            hit = lambda w: any(tuple(w[j : j + k]) in grams for k in sizes for j in range(len(w) - k + 1))
            assert set(after) == {i for i, r in before.items() if not hit(norm(r["text"]))}
        else:
            con.register("before", docs_table(before))
            sql = mixing.SQL.replace("from documents", "from before")
            wanted = {r[0]: r[1] for r in con.execute(f"select doc_id, copies from ({sql})").fetchall()}
            assert {i: r["copies"] for i, r in after.items()} == wanted


def docs_table(rows):
    import pyarrow as pa

    return pa.Table.from_pylist([r.asDict() for r in rows.values()], pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    ))


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["copies"] >= 1 for r in rows)
