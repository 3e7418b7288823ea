"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabgauge.llm import (
    decontaminate,
    line_templates,
    mixing,
    ppm,
    quality,
    quotes,
    simhash,
    substrings,
    token_counts,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "\n".join(f"Line {chr(97 + i)} tells a calm and simple story about river number {chr(97 + i)} again." for i in range(12))
LONG = " ".join(f"w{i}" for i in range(30_000)) + "."
ROWS = [
    (1, PROSE, "en", "src1", 1),
    (2, PROSE, "en", "src1", 1),
    (2, PROSE, "en", "src1", 1),  # a repeated row
    (2, "another text under the same id", "en", None, None),
    (3, PROSE + " And one more word.", None, "src2", 5),
    (4, "", "de", "src1", 0),
    (5, None, None, None, None),
    (6, " \t\n ", "de", "src1", 4),
    (None, PROSE, "en", "src1", 1),
    (None, None, None, None, None),
    (7, LONG, "fr", "srcX", 9),
    (8, "é" * 50 + "\r\n日本語 <|endoftext|> #$% x y", "ja", "src2", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, "tells a calm and simple story about river number a again"), (2, "W7 w8"), (2, None), (None, "w9 w10"), (3, "")],
        "item_id long, text string",
    )


def test_quality_cases(docs, none):
    got = quality.clean_lines(docs.withColumn("kept", F.lit("taken")).withColumn("Row", F.lit(1)))
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns.count("kept") == 1 and "Row" in got.columns
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[5]["n_words"] == 0 and by[5]["base_failed"] and not by[5]["kept"] and by[5]["clean_text"] == ""
    assert by[1]["base_failed"] and by[1]["n_repeat_words"] > 0 and by[1]["clean_text"] == PROSE
    assert by[7]["kept"] and by[7]["n_words"] == 30_000 and by[7]["clean_text"] == LONG
    assert quality.clean_lines(none).count() == 0


def test_quality_rules_by_line(spark):
    good = "This is a plain sentence that ends as it should."
    bad = ["no end mark here", "Home | About | News.", "We value your privacy policy.", "Buy### now%%% all&&& day.", "READ THIS NOW."]
    df = spark.createDataFrame([(1, "\n".join([good] * 2 + bad + [""] + [good]))], "doc_id long, text string")
    assert quality.clean_lines(df).first()["clean_text"] == "\n".join([good, good, "", good])


def test_line_template_cases(docs, none):
    clash = docs.withColumn("n_lines", F.lit("x")).withColumn("dropped", F.lit("y")).withColumn("_row", F.lit("z"))
    rows = line_templates.drop_templates(clash).collect()
    assert len(rows) == len(ROWS) and rows[0]["dropped"] == "y" and rows[0]["_row"] == "z"
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_dropped"] == 0 and by[1][0]["clean_text"] == PROSE  # the smallest id keeps its lines
    assert sorted(r["n_dropped"] for r in by[2]) == [0, 12, 12]
    assert sorted(r["n_dropped"] for r in by[None]) == [0, 12]  # a null id is larger than every other
    assert by[5][0]["clean_text"] is None and by[4][0]["n_lines"] == 1
    assert line_templates.drop_templates(none).count() == 0


def test_variable_fields_meet_in_one_template(spark):
    rows = [(i, f"keep {chr(97 + i)} apart\nPage {i} of {i + 7}\tdone") for i in range(4)]
    out = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in out} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_fields_without_digits_are_found(spark):
    """A leaf's common form drops lines that differ in names, and leaves lines that share too little with it."""
    names = "Anna Ben Cleo Dan Eve Finn Gia Hal Ida Jon Kim Leo".split()
    news = "News Sport Arts".split()
    prose = "It was Q that W of E did R for T".split()
    rows = [
        (i, f"Posted by {name} in {news[i % 3]}\n" + " ".join(w + name if len(w) == 1 else w for w in prose) + f"\nSaid by {name} of {name} {name}")
        for i, name in enumerate(names)
    ] + [(20, "Posted by the crew yesterday\nnobody knows"), (21, "Posted by us this morning")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_templates.drop_templates(df).collect()}
    assert {i: r["n_dropped"] for i, r in out.items()} == {0: 0, **{i: 1 for i in range(1, 12)}, 20: 0, 21: 0}
    assert out[3]["clean_text"] == rows[3][1].split("\n", 1)[1]
    # the depth decides: with three leading tokens every name is a leaf of its own
    assert all(r["n_dropped"] == 0 for r in line_templates.drop_templates(df, depth=3).collect())
    assert all(r["n_dropped"] == 0 for r in line_templates.drop_templates(df.filter("doc_id < 9")).collect())


def test_line_templates_of_any_lines(spark):
    """Random lines of few words against the SQL, with common forms, number rows and repeated lines among them."""
    import random

    import duckdb
    import pandas as pd

    rng = random.Random(5)
    word = lambda: rng.choice("a b c dd e5 7 <*> é".split())
    line = lambda: " ".join(word() for _ in range(rng.randint(0, 5)))
    form = lambda: f"so it {rng.randint(1, 40)} {chr(97 + rng.randint(0, 20))}x went on"
    rows = [(i, "\n".join(rng.choice([line, line, form])() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841 - read by name
    wanted = sorted(duckdb.sql(line_templates.SQL).fetchall())
    out = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("s")).collect()
    assert sorted(map(tuple, got)) == wanted


def test_rows_of_numbers_are_no_template(spark):
    """Tables of unlike numbers in unrelated documents stay; a row that is the same everywhere goes."""
    rows = [(i, "\n".join(["0 0 0", *(f"{i}{j} 1.{j}\t-{i}  x{j}{i}" for j in range(3)), f"Page {i} of 9"])) for i in range(1, 4)]
    out = {r["doc_id"]: r for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_dropped"] for i, r in out.items()} == {1: 0, 2: 2, 3: 2}
    assert out[3]["clean_text"] == "\n".join(rows[2][1].split("\n")[1:4])


def test_decontamination_cases(docs, none, bench):
    clash = docs.withColumn("items", F.lit("x")).withColumn("hits", F.lit(1)).withColumn("w", F.lit(2))
    rows = decontaminate.mark_hits(clash, bench).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 2)}
    assert by[1]["items"] == ["1"] and by[1]["n_hit"] == 11 and by[7]["items"] == ["2"] and by[7]["n_hit"] == 4
    assert by[7]["clean_text"].startswith("w0 w1 w2 w3 w4 w5 w6 w11 ")
    assert by[5]["n_words"] == 0 and not by[5]["contaminated"] and by[5]["clean_text"] is None
    assert sorted(r["n_hit"] for r in rows if r["doc_id"] == 2) == [0, 11, 11]
    assert decontaminate.mark_hits(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.mark_hits(docs, bench.limit(0)).collect())
    # beyond the broadcast bound the same answer comes by a shuffle
    other = decontaminate.mark_hits(clash, bench, max_broadcast=0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, other))


def test_simhash_cases(docs, none):
    rows = simhash.near_duplicates(docs.withColumn("print", F.lit(1))).collect()
    assert len(rows) == len(ROWS)
    first = {r["fingerprint"]: r["component_id"] for r in rows}
    assert first["0" * 16] == 4  # empty, blank and null texts
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {1, 4} <= set(ids) and 5 not in ids and 6 not in ids


def test_bk_tree_finds_what_a_scan_finds():
    import random

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(12)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(values[i] for i in tree.within(v, 3)) == sorted(x for x in values if (x ^ v).bit_count() <= 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 200)]
    nodes = spark.createDataFrame([(i,) for i in {x for e in edges for x in e} | {999}], "node long")
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()
    root = {r["node"]: r["root"] for r in got}
    assert len({root[i] for i in [*range(41), 200]}) == 1 and len({root[i] for i in range(100, 130)}) == 1
    assert len(set(root.values())) == 3


def test_substring_cases(docs, none):
    rows = substrings.drop_repeats(docs.withColumn("spans", F.lit(1))).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    n = len(PROSE.split())
    assert by[1][0]["n_removed"] == 0 and sorted(r["n_removed"] for r in by[2]) == [0, n, n]
    assert by[3][0]["n_removed"] == n and by[3][0]["kept_text"] == "And one more word."
    assert all(r["n_removed"] == 0 for r in by[None] + by[7]) and by[5][0]["n_words"] == 0 and by[5][0]["kept_text"] == ""
    assert substrings.drop_repeats(none).count() == 0


def test_a_hot_anchor_loads_no_single_shard(spark, tmp_path, monkeypatch):
    """One short line with ever different surroundings in every document, some of them repeated."""
    import os
    import random
    import uuid

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    runs = substrings.Cutter(3, 3).cut([" ".join(word() for _ in range(20_000)).encode()])
    k = int(runs["anchor"].argmin())  # three words whose hash is smaller than nearly every other
    line = runs["joined"][runs["begin"][k] : runs["end"][k]].decode()
    rows = [(i, " ".join([*(word() for _ in range(12)), line, *(word() for _ in range(12))])) for i in range(3000)]
    rows += [(3000 + i, rows[i][1].split(" ", 4)[4] + " " + word()) for i in range(0, 3000, 100)]
    search, size = substrings._search(13), 1 << 16
    folder = str(tmp_path)

    def measured(shard):
        import pyarrow as pa

        texts = sum(pa.ipc.open_stream(b.as_buffer()).read_all().column("text").nbytes for b in shard.column("blob"))
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(str(texts))
        return search(shard)

    monkeypatch.setattr(substrings, "_search", lambda n: measured)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeats(df, shard_bytes=size).collect()}
    first, wanted = {}, {}
    for i, text in rows:
        w = text.split()
        windows = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {p for j, x in enumerate(windows) if first.setdefault(x, i) < i for p in range(j, j + 13)}
        wanted[i] = len(gone)
    assert got == wanted and sum(n > 0 for n in wanted.values()) == 30
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 4 * size


def test_token_count_cases(docs, none):
    path = token_counts.public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(docs.withColumn("id", F.lit(1)), path).collect()
    library = token_counts.Tokenizer.from_file(path)
    wanted = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in ROWS)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == wanted
    assert token_counts.count_tokens(none, path).count() == 0


def test_mixing_cases(docs, none):
    rows = mixing.mix_documents(docs.withColumn("copies", F.lit("x")).withColumn("_level0", F.lit(1))).collect()
    assert rows and all(r["copies"] >= 1 for r in rows)
    spent, longest, budget = {}, {}, {}
    for r in rows:
        leaf = (r["domain"], r["lang"], r["source"])
        spent[leaf] = spent.get(leaf, 0) + r["copies"] * r["n_tokens"]
        longest[leaf], budget[leaf] = longest.get(leaf, 0) + r["n_tokens"], r["leaf_budget"]
    assert all(budget[leaf] <= spent[leaf] <= budget[leaf] + longest[leaf] for leaf in spent)
    assert mixing.mix_documents(none).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)]
    df = spark.createDataFrame(leaves, "top string, low string, tokens long")
    got = mixing.budgets(df, ["top", "low"], {}, 400, 1).collect()
    assert {(r["top"], r["low"]): r["budget"] for r in got} == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}


def test_budgets_are_spent_to_the_last_document(spark):
    """Every leaf serves its budget, and less than one document more."""
    rows = [(i, "a" if i % 3 else "b", 1 + i * 7 % 40) for i in range(200)] + [(200, "c", 5000), (201, "d", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, {"source": F.col("source")}, F.col("size"), share=0.4).collect()
    longest = {s: max(r[2] for r in rows if r[1] == s) for s in "abc"}
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        budget, spent = mine[0]["leaf_budget"], sum(r["copies"] * r["size"] for r in mine)
        assert budget > 0 and budget <= spent < budget + longest[s]


def test_weight_zero_gives_its_share_to_its_siblings(spark):
    leaves = [("a", "x", 100), ("a", "y", 1000), ("b", "x", 1000), ("c", "x", 0)]
    df = spark.createDataFrame(leaves, "top string, low string, tokens long")
    got = mixing.budgets(df, ["top", "low"], {"low": {"x": 0}}, 400, 1).collect()
    assert {(r["top"], r["low"]): r["budget"] for r in got} == {("a", "x"): 0, ("a", "y"): 400, ("b", "x"): 0, ("c", "x"): 0}
    with pytest.raises(ValueError, match="negative"):
        mixing.budgets(df, ["top"], {"top": {"a": -1}}, 400, 1)


def test_score_cases(docs, none):
    for train in (F.col("doc_id") == 1, F.lit(False)):
        rows = ppm.score_texts(docs.withColumn("chunk", F.lit(1)), train).collect()
        assert len(rows) == len(ROWS) and all(r["score"] < 0 for r in rows)
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}
    empty = [r for r in ppm.score_texts(docs, F.lit(False)).collect() if r["doc_id"] == 4]
    assert empty[0]["score"] == pytest.approx(-2.408239965)  # one of 256 symbols
    assert ppm.score_texts(none, F.lit(True)).count() == 0


def test_quote_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"),
        (1, 1, "assistant", "> How are you?\nFine, thanks.\nAnd you?"),
        (1, 2, "user", "> > How are you?\n>> Hello there\n> Fine, thanks.\n>   AND you?\nGood"),
        (1, 2, "user", "> > How are you?\n>> Hello there\n> Fine, thanks.\n>   AND you?\nGood"),
        (1, 3, "user", "> something else\nHm"),
        (2, 0, "user", "> Hello there"),
        (2, 1, None, None),
        (None, 0, "user", "x1"),
        (None, 1, "user", " > x1\ny"),
        (None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("depth", F.lit("clash")).withColumn("conv", F.lit(1))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert got[1, 2]["parent_turn"] == 1 and got[1, 2]["root_turn"] == 0 and got[1, 2]["depth"] == 2
    assert got[1, 2]["clean_text"] == "Good" and got[1, 3]["n_unlinked"] == 1 and got[1, 3]["parent_turn"] is None
    assert got[2, 0]["clean_text"] == "" and got[2, 1]["clean_text"] is None and got[None, 1]["parent_turn"] == 0
    assert quotes.link_quotes(spark.createDataFrame([], schema)).count() == 0


def test_warc_round_trip_and_push_down(spark, tmp_path):
    warc.register(spark)
    body = b"x" * 5000
    rows = [
        ("response", "<urn:page:1>", "http://a/ b\r\nc", None, None, None, None, None, body),
        ("revisit", "<urn:page:0>", None, "2024-01-01T00:00:00Z", None, None, "<urn:page:1>", 5000, None),
        ("response", "<urn:page:2>", "http://z/", None, "text/plain", None, None, None, None),
        ("response", "<urn:page:2>", "http://z/", None, "text/plain", None, None, None, b"\r\n\r\n tail"),
    ]
    columns = warc.SCHEMA.rsplit(", file", 1)[0]
    path = str(tmp_path / "w")
    spark.createDataFrame(rows, columns).repartition(3).write.format("warc").mode("append").option("max_file_bytes", 100).save(path)
    back = spark.read.format("warc").load(path)
    got = sorted((r["record_id"], r["warc_type"], r["payload_length"], bytes(r["payload"]) if r["payload"] is not None else None) for r in back.collect())
    assert got == [
        ("<urn:page:0>", "revisit", 5000, None),
        ("<urn:page:1>", "response", 5000, body),
        ("<urn:page:2>", "response", 0, b""),
        ("<urn:page:2>", "response", 9, b"\r\n\r\n tail"),
    ]
    some = back.filter((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://z"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and ") Filter" not in plan and some.count() == 2
    heads = spark.read.format("warc").schema("record_id string, warc_type string").load(path)
    assert heads.filter(F.col("warc_type").isin("revisit")).collect() == [("<urn:page:0>", "revisit")]
    assert back.filter("target_uri is not null and content_type = 'text/plain'").count() == 2
    none = str(tmp_path / "none")
    spark.createDataFrame([], columns).write.format("warc").mode("append").save(none)
    assert spark.read.format("warc").load(none).count() == 0


def test_plain_and_foreign_archives(spark, tmp_path):
    import gzip

    warc.register(spark)
    one = warc.record({"warc_type": "response", "record_id": "<a>", "payload": b"abc" * 3000})
    two = warc.record({"warc_type": "response", "record_id": "<b>", "payload": b"d"})
    (tmp_path / "x.warc").write_bytes(one + two)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    back = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r["record_id"], len(r["payload"])) for r in back.collect()) == [("<a>", 9000), ("<a>", 9000), ("<b>", 1), ("<b>", 1)]
    assert back.filter("record_id = '<b>'").count() == 2


def test_appends_add_up_and_overwriting_replaces(spark, tmp_path):
    warc.register(spark)
    path = tmp_path / "w"
    page = lambda i: spark.createDataFrame([("response", f"<{i}>", b"x" * i)], "warc_type string, record_id string, payload binary")
    ids = lambda: sorted(r["record_id"] for r in spark.read.format("warc").load(str(path)).collect())
    page(1).write.format("warc").mode("append").save(str(path))
    page(2).write.format("warc").mode("append").save(str(path))
    assert ids() == ["<1>", "<2>"]
    (path / "other.warc").write_bytes(warc.record({"warc_type": "response", "record_id": "<3>", "payload": b"abc"}))
    # a file that a lost task left is still not read
    lost = warc.member(warc.record({"warc_type": "response", "record_id": "<4>", "payload": b"abc"}))
    (path / f"part-{'0' * 32}.warc.gz").write_bytes(lost)
    assert ids() == ["<1>", "<2>", "<3>"]
    page(5).write.format("warc").mode("overwrite").save(str(path))
    assert ids() == ["<5>"]


def test_stages_take_odd_rows(spark, docs, none, tmp_path, bench):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, str(tmp_path))
            assert out.count() <= len(ROWS)
            if name != "mix":
                assert out.columns == docs.columns
