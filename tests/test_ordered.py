"""Sliced order statistics against plain windows and numpy, for several partition counts."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from tabgauge.functions import ordered
from tabgauge.functions.digest import child_seed, child_seed_value, order_key, uniform


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, many ties."""
    n = 5000
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.floor(F.pow(uniform(3, "id"), 2) * 40).cast("double").alias("v"),
        order_key(1, "id").alias("d"),
    )


@pytest.mark.parametrize("partitions", [1, 7, 64])
@pytest.mark.parametrize("digits", [1, 3])
def test_digest_positions_equal_row_number(spark, skewed, partitions, digits):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = ordered.digest_positions(skewed.repartition(partitions), ["g"], "d", digits=digits)
        want = skewed.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("d")))
        assert got.join(want.select("id", "w"), "id").filter("position <> w").count() == 0
        assert got.count() == skewed.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("n", [0, 1, 17, 4999, 6000])
def test_first_by_digest_beyond_the_heap(skewed, n):
    got = {r["id"] for r in ordered.first_by_digest(skewed, n, "d", heap_limit=-1).collect()}
    want = {r["id"] for r in skewed.orderBy("d").limit(n).collect()}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_running_before_and_ranks(spark, skewed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        counts = skewed.groupBy("g", "v").agg(F.count("*").alias("n"))
        got = ordered.running_before(counts, ["g"], [F.col("v").desc()], {"b": "n"})
        window = W.partitionBy("g").orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, -1)
        want = counts.select("g", "v", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("w"))
        assert got.join(want, ["g", "v"]).filter("b <> w").count() == 0
        a = ordered.tie_ranks(skewed, ["g"], "v").groupBy("g").agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
        assert a.filter("abs(r - n * (n + 1) / 2) > 1e-6").count() == 0
        plain = ordered.tie_ranks(skewed, ["g"], "v", "plain", bounded=True)
        assert ordered.tie_ranks(plain, ["g"], "v").filter("abs(rank - plain) > 1e-9").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_ties_and_nulls_in_ranks(spark):
    df = spark.createDataFrame([("t", 3.0), ("t", 3.0), ("t", 1.0), ("t", None)], "g string, v double")
    for bounded in (True, False):
        got = [(r["v"], r["rank"]) for r in ordered.tie_ranks(df, ["g"], "v", bounded=bounded).collect()]
        assert sorted(got, key=str) == sorted([(3.0, 1.5), (3.0, 1.5), (1.0, 3.0), (None, None)], key=str)


@pytest.mark.parametrize("buffer_rows", [1_000_000, 0])
@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_quantiles(skewed, buffer_rows, accuracy):
    df = skewed.withColumn("u", uniform(9, "id")).withColumn("none", F.lit(None).cast("double"))
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = ordered.exact_quantiles(df, ["v", "u", "none"], probabilities, accuracy, buffer_rows)
    rows = df.select("v", "u").toPandas()
    for c in ("v", "u"):
        assert np.allclose(got[c], np.quantile(rows[c], probabilities), atol=1e-12)
    assert got["none"] == [None] * 6


def test_grouped_quantiles(skewed):
    rows = skewed.toPandas()
    for r in ordered.grouped_quantiles(skewed, ["g"], ["v"], [0.25, 0.5, 0.75]).collect():
        assert r["value"] == pytest.approx(np.quantile(rows[rows["g"] == r["g"]]["v"], r["p"]))
    grid = sorted((r["p"], r["value"]) for r in ordered.grouped_quantiles(skewed, [], ["v"], grid=101).collect())
    assert len(grid) == 101
    assert np.allclose([v for _, v in grid], np.quantile(rows["v"], np.linspace(0, 1, 101)))


def test_sorted_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    assert {r["v"]: r["code"] for r in ordered.sorted_codes(df, [], "v").collect()} == {"a": 0, "b": 1, "c": 2}


def test_seeds_agree_between_driver_and_columns(spark):
    got = spark.createDataFrame([("x",), ("y",)], "n string").select("n", child_seed(5, "n").alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: child_seed_value(5, n) for n in "xy"}


def test_a_null_group_keeps_its_rows(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), order_key(1, "id").alias("d"), (F.col("id") % 4).alias("v"))
    assert sorted(r[0] for r in ordered.digest_positions(df, ["g"], "d").filter("g is null").select("position").collect()) == list(range(1, 21))
    assert ordered.tie_ranks(df, ["g"], "v").filter("rank is null").count() == 0
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    assert ordered.running_before(counts, ["g"], ["v"], {"b": "n"}).count() == counts.count()
    assert ordered.grouped_quantiles(df, ["g"], ["v"], [0.5]).count() == 3
