"""Loading, cleaning, splitting and encoding on small tables."""

from collections import Counter

import pytest
from compare import plan_text
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabgauge.operators import clean, encode, profile, split
from tabgauge.schema import ColumnRoles, Dataset, without_nan
from tabgauge.sources import datasets


def _dataset(spark, rows, schema, categorical, numerical):
    return Dataset(spark.createDataFrame(rows, schema), ColumnRoles("k", "y", categorical, numerical))


def test_nan_becomes_null(spark):
    df = without_nan(spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "k int, v double"))
    assert [r["v"] for r in df.orderBy("k").collect()] == [None, None, 1.5]


def test_load_dataset_roles_and_target(spark, tmp_path):
    rows = [(1, "a", 1.0, True, "no"), (2, None, float("nan"), False, "yes"), (3, "b", 2.0, True, "no")]
    spark.createDataFrame(rows, "k int, s string, v double, b boolean, y string").write.parquet(str(tmp_path / "t"))
    d = datasets.load_dataset(spark, str(tmp_path / "t"), "k", "y")
    assert d.roles.categorical == ("s", "b") and d.roles.numerical == ("v",)
    assert [r["y"] for r in d.df.orderBy("k").collect()] == [0, 1, 0]
    assert d.df.filter("isnan(v)").count() == 0
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "x", "k", "y", format="unknown")


def test_user_loader(spark):
    @datasets.loader("numbers")
    def _(session, path, n=3):
        return session.range(n).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), F.col("id").alias("v"))

    assert datasets.load_dataset(spark, "", "k", "y", format="numbers", n=5).df.count() == 5


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x,\n2,y,3.5\n")
    df = datasets.read_headerless_csv(spark, str(tmp_path), ["id", "name", "v"], {"id": "int", "name": "string"})
    assert {(r["id"], r["name"], r["v"]) for r in df.collect()} == {(1, "x", 0.0), (2, "y", 3.5)}
    assert datasets.read_headerless_csv(spark, str(tmp_path), ["id", "name", "v"], {"name": "string"}, rows=1).count() == 1


def test_bibliography_ids(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Paper Key,Dataset ID,Year\np1,12.0,1999\np2,,\np3,x,2001\n")
    df = datasets.read_bibliography(spark, str(tmp_path), ["dataset_id"])
    assert [(r["paper_key"], r["dataset_id"]) for r in df.orderBy("paper_key").collect()] == [("p1", 12), ("p2", None), ("p3", None)]


def test_indicator_overrides_types(spark):
    df = spark.createDataFrame([(1, "a", 2, 0)], "k int, s string, n int, y int")
    roles = profile.infer_roles(df, "k", "y", indicator={"s": False, "n": True})
    assert roles.categorical == ("n",) and roles.numerical == ("s",)


def test_target_kinds(spark):
    kind = lambda values, t: profile.target_profile(spark.createDataFrame([(v,) for v in values], f"y {t}"), "y").first()["output_type"]
    assert kind([0, 1, 1], "int") == "binary"
    assert kind([0, 1, 2], "int") == "multiclass"
    assert kind([0.5, 1.0], "double") == "continuous"
    assert kind([0.0, 1.0], "double") == "binary"


def test_densify(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(3, {1: 2.0}))], ["k", "v"])
    assert profile.densify(df).first()["v"] == [0.0, 2.0, 0.0]


def test_manipulator_arguments_and_info(spark):
    rows = [(i, f"c{i}", i % 3, float(i) if i % 4 else None, i % 2) for i in range(40)]
    d = _dataset(spark, rows, "k int, s string, few int, v double, y int", ("s",), ("few", "v"))
    out = clean.manipulate(
        d, ["remove_high_cardinality", "remove_pseudo_categorical", "remove_missing_values"],
        remove_high_cardinality__threshold=39, remove_pseudo_categorical__threshold=4,
    )
    assert out.info == {"n_high_cardinality": 1, "num_pseudo_categorical_cols": 1, "num_missing_cols": 0, "num_missing_rows": 10}
    assert out.df.columns == ["k", "v", "y"] and out.df.count() == 30


def test_threshold_is_strict(spark):
    rows = [(i, f"c{i % 20}", i % 10, i % 2) for i in range(40)]
    d = _dataset(spark, rows, "k int, s string, n int, y int", ("s",), ("n",))
    assert clean.remove_high_cardinality(d, 20).roles.categorical == ("s",)
    assert clean.remove_pseudo_categorical(d, 10).roles.numerical == ("n",)


def test_user_manipulator(spark):
    @clean.manipulator
    def keep_even(dataset):
        return dataset.with_df(dataset.df.filter("k % 2 = 0"), kept="even")

    d = _dataset(spark, [(1, 1.0, 0), (2, 2.0, 1)], "k int, v double, y int", (), ("v",))
    out = clean.manipulate(d, ["keep_even"])
    assert out.df.count() == 1 and out.info == {"kept": "even"}
    del clean.MANIPULATORS["keep_even"]


def test_balance_binarize(spark):
    rows = [(i, 1.0, "a" if i < 50 else "b" if i < 70 else "c") for i in range(75)]
    d = _dataset(spark, rows, "k int, v double, y string", (), ("v",))
    got = {r["y"]: r["count"] for r in clean.balance_binarize(d).df.groupBy("y").count().collect()}
    assert got == {0: 20, 1: 20}
    one = _dataset(spark, [(1, 1.0, "a"), (2, 1.0, "a")], "k int, v double, y string", (), ("v",))
    with pytest.raises(ValueError):
        clean.balance_binarize(one)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_sample_is_the_same_for_any_partitioning(spark, partitions):
    df = spark.range(3000, numPartitions=partitions).select(F.col("id").alias("k"), F.lit(1.0).alias("v"), F.lit(0).alias("y"))
    d = Dataset(df, ColumnRoles("k", "y", (), ("v",)))
    got = sorted(r["k"] for r in clean.subsample_rows(d, 25).df.collect())
    assert SEEN.setdefault("sample", got) == got and len(set(got)) == 25
    assert clean.subsample_rows(d, 3000).df.count() == 3000


SEEN: dict = {}


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_splits_are_stratified_and_cover(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(2003).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("y"))
        s = split.stratified_splits(df, "k", "y", F.col("k") % 4, n_folds=4, n_splits=5)
        assert split.uncovered_rows(df, "k", s).count() == 0
        per = s.filter("split is not null").join(df.withColumnRenamed("k", "row_key"), "row_key").groupBy("fold", "y", "split").count()
        assert per.groupBy("fold", "y").agg((F.max("count") - F.min("count")).alias("d")).filter("d > 1").count() == 0
        got = s.agg(F.sum(F.hash("row_key", "fold", "split").cast("bigint"))).first()[0]
        assert SEEN.setdefault("splits", got) == got
        parts = {r["part"]: r["count"] for r in split.split_parts(s, 0, 1).groupBy("part").count().collect()}
        assert sum(parts.values()) == 2003 and set(parts) == {"train", "valid", "test"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    test = spark.createDataFrame([("b",), ("c",), (None,)], "c string")
    codes = lambda e: [r["c"] for r in e.fit(train).transform(test).collect()]
    assert codes(encode.OrdinalEncoder(("c",))) == [1, -1, -2]
    assert codes(encode.OrdinalEncoder(("c",), missing=None)) == [1, -1, None]
    assert codes(encode.OrdinalEncoder(("c",), missing=-1, shift=1)) == [2, 0, 0]
    hot = encode.OneHotEncoder(("c",)).fit(train).transform(test).collect()
    assert [(r["c_a"], r["c_b"]) for r in hot] == [(0, 1), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        encode.OneHotEncoder(("c",), max_categories=1).fit(train)


@pytest.mark.parametrize("limit", [1000, 0])
def test_encode_then_decode(spark, monkeypatch, limit):
    """Short dictionaries are literals, long ones joins; both decode to the input."""
    monkeypatch.setattr(encode, "LITERAL_DICTIONARY", limit)
    monkeypatch.setattr(encode.short_levels, "__defaults__", (limit,))
    df = spark.range(300).select("id", F.concat(F.lit("v"), F.col("id") % 37).alias("c"))
    e = encode.OrdinalEncoder(("c",)).fit(df)
    assert bool(e.short) == bool(limit)
    coded = e.transform(df)
    assert coded.agg(F.max("c")).first()[0] == 36
    assert e.decode(coded).join(df.withColumnRenamed("c", "was"), "id").filter("c <> was").count() == 0


def test_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    other = spark.createDataFrame([(100.0,), (None,)], "v double")
    assert [r["v"] for r in encode.MedianImputer(("v",)).fit(train).transform(other).collect()] == [100.0, 2.0]
    assert [r["v"] for r in encode.StandardScaler(("v",)).fit(train).transform(other).collect()] == [98.0, None]
    assert encode.StandardScaler(("v",)).fit(spark.createDataFrame([(2.0,), (2.0,)], "v double")).moments["v"] == (2.0, 1.0)


@pytest.mark.parametrize("buffer_rows", [1_000_000, 0])
def test_quantile_transform(spark, monkeypatch, buffer_rows):
    import numpy as np

    monkeypatch.setattr(encode, "BUFFER_ROWS", buffer_rows)
    values = [0.0, 0.0, 0.0, 1.0, 2.0, 5.0, 5.0, 9.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values + [-3.0, 0.5, 7.0, 99.0]], "v double")
    train = spark.createDataFrame([(v,) for v in values], "v double")
    fitted = encode.QuantileTransformer(("v",), n_quantiles=9, output="uniform").fit(train)
    grid = np.quantile(values, np.linspace(0, 1, 9))
    assert np.allclose(fitted.quantiles["v"], grid)
    refs = np.linspace(0, 1, 9)
    for x, r in zip(values + [-3.0, 0.5, 7.0, 99.0], fitted.transform(df).collect()):
        both = 0.5 * (np.interp(x, grid, refs) - np.interp(-x, -grid[::-1], -refs[::-1]))
        want = 0.0 if x <= grid[0] else 1.0 if x >= grid[-1] else both
        assert r["v"] == pytest.approx(want)
    normal = encode.QuantileTransformer(("v",), n_quantiles=9).fit(train).transform(df).collect()
    assert min(r["v"] for r in normal) == pytest.approx(-5.199337, abs=1e-5)


def test_rare_categories_fold(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id") % 5).otherwise(F.col("id")).cast("string").alias("c"))
    folded = encode.InfrequentFolder(("c",), max_bins=6).fit(df).transform(df)
    counts = {r["c"]: r["count"] for r in folded.groupBy("c").count().collect()}
    assert counts == {**{str(i): 180 for i in range(5)}, "infrequent": 100}


def test_merge_rare_classes(spark):
    df = spark.range(200).select(F.when(F.col("id") < 199, "common").otherwise("rare").alias("y"))
    got = {r["y"]: r["count"] for r in clean.merge_rare_classes(df, "y").groupBy("y").count().collect()}
    assert got == {"common": 199, "others": 1}


def test_unseen_categories_stay_unseen(spark):
    train = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id") % 5).otherwise(F.col("id")).cast("string").alias("c"))
    df = spark.createDataFrame([("0",), ("950",), ("never",), (None,)], "c string")
    folder = encode.InfrequentFolder(("c",), max_bins=6).fit(train)
    out = folder.transform(df)
    assert sorted(r["c"] or "" for r in out.collect()) == ["", "0", "infrequent", "never"]
    coded = encode.OrdinalEncoder(("c",), missing=-1).fit(folder.transform(train)).transform(out)
    assert sorted(int(r["c"]) for r in coded.collect()) == [-1, -1, 0, 5]
    assert encode.InfrequentFolder(("c",), max_bins=6, widths={"c": 6}).fit(train).transform(df).count() == 4


def test_sparse_one_hot_has_no_column_for_a_category(spark):
    rows = spark.range(6000).select(
        "id", F.concat(F.lit("v"), F.col("id")).alias("wide"), F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("few"), F.lit(2.5).alias("x")
    )
    encoder = encode.SparseOneHotEncoder(("wide", "few")).fit(rows.filter("id < 5000"))
    assert encoder.width == 5002 and encoder.dictionary().agg(F.count_distinct("index")).first()[0] == 5002
    out = encoder.transform(rows)
    assert out.columns == ["id", "x", "one_hot"] and len(plan_text(out)) < 60_000
    cells = encoder.cells(rows, "id").groupBy("id").agg(F.array_sort(F.collect_list("index")).alias("places"))
    for r in out.join(cells, "id", "left").filter("id % 499 = 0").collect():
        assert r["one_hot"].size == 5002 and list(r["one_hot"].indices) == (r["places"] or [])
    nothing = encode.SparseOneHotEncoder(("few",)).fit(rows.filter("few is null")).transform(rows.limit(2))
    assert [r["one_hot"].size for r in nothing.collect()] == [0, 0]


def test_folding_many_columns_reads_the_input_once(spark, tmp_path):
    names = [f"c{i}" for i in range(8)]
    rows = spark.range(3000).select("id", *[F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40 * (i + 1)))).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("c7", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, "hot").otherwise(F.col("c7")))
    rows.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    folder = encode.InfrequentFolder(tuple(names), max_bins=10).fit(df.filter("id % 4 > 0"))
    out = folder.transform(df)
    assert plan_text(out).split("\n\n")[0].count("Scan parquet") == 1
    got = {r["id"]: r for r in out.collect()}
    table = {r["id"]: r for r in df.collect()}
    assert len(got) == 3000
    for n in names:
        train = Counter(r[n] for i, r in table.items() if i % 4 and r[n] is not None)
        top = set(sorted(train, key=lambda v: (-train[v], v))[:9])
        assert all(got[i][n] == ("infrequent" if r[n] in train and r[n] not in top else r[n]) for i, r in table.items())
