"""Metrics on tables small enough to work out by hand, and properties that must hold on any table."""

import math

import pytest
from pyspark.sql import functions as F

from tabgauge.functions import scalars as X
from tabgauge.functions.digest import uniform
from tabgauge.operators import scoring as S


def _scores(df, groups=(), **kw):
    return {r["metric"]: r["score"] for r in S.score_table(df, list(groups), **kw).collect()}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.4), (0, 0.4), (0, 0.1)]
    return spark.createDataFrame([(y, [1 - p, p]) for y, p in rows], "y int, probs array<double>")


def test_binary_by_hand(small):
    s = _scores(small)
    # labels at 0.5: 1 1 1 0 0 0 -> tp 2, fp 1, fn 1, tn 2
    assert s["accuracy"] == pytest.approx(4 / 6)
    assert s["precision"] == pytest.approx(2 / 3) and s["recall"] == pytest.approx(2 / 3)
    assert s["f1"] == pytest.approx(2 / 3) and s["jaccard"] == pytest.approx(2 / 4)
    assert s["zero_one_loss"] == pytest.approx(-2 / 6)
    # pairs: 0.9 beats 3; 0.7 beats 2; 0.4 beats 1 and ties 1 -> 6.5 of 9
    assert s["roc_auc"] == pytest.approx(6.5 / 9) and s["roc_auc_ovr"] == pytest.approx(6.5 / 9)
    # recall steps at 0.9 (1/1), 0.7 (2/3), 0.4 (3/5)
    assert s["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert s["brier_score"] == pytest.approx(-(0.01 + 0.64 + 0.09 + 0.36 + 0.16 + 0.01) / 6)
    assert s["log_loss"] == pytest.approx(sum(map(math.log, (0.9, 0.2, 0.7, 0.4, 0.6, 0.9))) / 6)
    assert "f1_samples" not in s and "jaccard_samples" not in s


def test_one_column_probability_is_the_same(small):
    single = small.withColumn("probs", F.array(F.col("probs")[1]))
    a, b = _scores(small), _scores(single)
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_weights_equal_repetition(spark, small):
    weighted = small.withColumn("w", 1 + F.col("y") * 2)
    repeated = weighted.withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    a, b = _scores(weighted, weight="w"), _scores(repeated)
    assert all(a[k] == pytest.approx(b[k]) for k in b)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8]), (1, [0.6, 0.4])], "y int, probs array<double>")
    s = _scores(df)
    assert "roc_auc" not in s and s["accuracy"] == 0.5


def test_auc_of_reversed_scores(spark):
    df = spark.range(3000).select(
        (uniform(1, "id") < 0.3).cast("int").alias("y"), F.array(F.round(uniform(2, "id"), 2)).alias("probs"), F.lit("a").alias("g")
    )
    up = S.rank_scores(df, ["g"]).first()["roc_auc"]
    down = S.rank_scores(df.withColumn("probs", F.array(1 - F.col("probs")[0])), ["g"]).first()["roc_auc"]
    assert up == pytest.approx(1 - down)
    assert S.rank_scores(df, ["g"], bounded=True).first()["roc_auc"] == pytest.approx(up)


SEEN: dict = {}


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_scores_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(4000, numPartitions=partitions).select(
            (F.col("id") % 4).cast("int").alias("y"),
            F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: uniform(2, "id", k) + (k == F.col("id") % 4).cast("double") / 3).alias("probs"),
        )
        s = _scores(df.withColumn("probs", X.softmax("probs")), metrics=["roc_auc", "roc_auc_ovr", "f1_macro", "f1_micro", "accuracy"])
        assert s["f1_micro"] == pytest.approx(s["accuracy"])
        seen = (round(s["roc_auc"], 9), round(s["roc_auc_ovr"], 9), round(s["f1_macro"], 9))
        assert SEEN.setdefault("scores", seen) == seen
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_multilabel(spark):
    df = spark.createDataFrame([([0, 1], [1]), ([2], [2]), ([], [])], "y array<int>, pred array<int>")
    r = S.multilabel_scores(df, []).first()
    assert r["f1_samples"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert r["jaccard_samples"] == pytest.approx((1 / 2 + 1 + 0) / 3)


def test_user_metric_and_flag_conflict(small):
    spec = S.register_scorer(S.make_scorer("miss_mass", lambda y, p, w: F.sum(F.abs(y - p) * w) / F.sum(w), optimum=0, greater_is_better=False))
    try:
        rows = S.with_losses(S.score_table(small, [], metrics=["miss_mass"])).collect()
        assert rows[0]["score"] == pytest.approx(-2 / 6) and rows[0]["loss"] == pytest.approx(2 / 6)
    finally:
        del S.SCORERS[spec.name]
    with pytest.raises(ValueError):
        S.make_scorer("x", needs_proba=True, needs_threshold=True)
    with pytest.raises(ValueError):
        S.get_scorer("nothing")


def test_class_report_has_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "y int, pred int").withColumn("g", F.lit(1))
    rows = {r["label"]: r for r in S.class_report(S.confusion_cells(df, ["g"]), ["g"]).collect()}
    assert rows["1"]["support"] == 0 and rows["1"]["precision"] == 0 and rows["1"]["recall"] == 0
    assert rows["accuracy"]["f1"] == pytest.approx(2 / 3)


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-7, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.99, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", X.normal_quantile("p").alias("z")).collect()
    for r in got:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-6)


def test_text_helpers(spark):
    df = spark.createDataFrame([("some_long-name",), ("iclr22a_b",), ("they're",)], "s string")
    got = {r["s"]: r["c"] for r in df.select("s", X.camel_case("s").alias("c")).collect()}
    assert got == {"some_long-name": "SomeLongName", "iclr22a_b": "Iclr22AB", "they're": "They'Re"}
    keys = spark.createDataFrame([("some-author-venuedbt22a",), ("ab",)], "s string")
    assert [r[0] for r in keys.select(X.citation_style("s")).collect()] == ["Some et al. 22", "Ab et al. a"]
    nested = spark.createDataFrame([({"a": "None", "b": "True", "c": "x"},)], "m map<string,string>")
    assert nested.select(X.keyword_map("m").alias("m")).first()["m"] == {"a": None, "b": "true", "c": "x"}
    chunks = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>").select(X.array_chunks("a", 2).alias("c")).collect()
    assert [r["c"] for r in chunks] == [[[1, 2], [3, 4], [5]], []]
