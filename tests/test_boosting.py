"""Histogram boosting against one split at a time in numpy, and its parameters one by one."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabgauge.operators import boosting, models

B = boosting.HistogramBooster
BASE = B(1, learning_rate=1.0, max_leaves=6, min_rows=5, l2=0.5, max_bins=16)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 3)), 1)
    x[::13, 1] = np.nan
    y = ((x[:, 0] > 0.3) ^ (np.nan_to_num(x[:, 1], nan=-1) > 0)).astype(float)
    rows = [(x[i].tolist(), float(y[i]), float(i % 3 + 1), float(int(x[i, 0] > 0) + int(x[i, 2] > 0.4)), i % 4 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "features array<double>, label double, w double, y3 double, watched boolean").repartition(3).cache()
    return df, x, y


def plain_tree(booster, bins, g, h):
    """The best leaf first, one split at a time; the score that every row gets."""

    def score(a, b):
        return a * a / (b + booster.l2)

    def best(rows):
        found = (0.0, None)
        for f in range(bins.shape[1]):
            for b in range(booster.max_bins + 1):
                for missing_left in (True, False):
                    left = (bins[rows, f] <= b) & (missing_left | (bins[rows, f] > 0))
                    n = left.sum()
                    if n < booster.min_rows or len(rows) - n < booster.min_rows:
                        continue
                    sides = [(g[rows[m]].sum(), h[rows[m]].sum()) for m in (left, ~left)]
                    gain = 0.5 * (sum(score(*s) for s in sides) - score(g[rows].sum(), h[rows].sum()))
                    if gain > found[0] + 1e-9:
                        found = (gain, left)
        return found

    leaves = [(np.arange(len(g)), best(np.arange(len(g))))]
    while len(leaves) < booster.max_leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
        rows, (gain, left) = leaves[k]
        if left is None:
            break
        leaves[k : k + 1] = [(r, best(r)) for r in (rows[left], rows[~left])]
    out = np.zeros(len(g))
    for rows, _ in leaves:
        out[rows] = -booster.learning_rate * g[rows].sum() / (h[rows].sum() + booster.l2)
    return out, len(leaves)


def probability(model, df):
    return [float(r["probability"].toArray()[1]) for r in model.transform(df).select("probability").collect()]


def test_a_tree_is_the_one_that_single_splits_give(spark, table):
    df, x, y = table
    model = BASE.fit(df)
    bins = boosting.to_bins(x, model.edges)
    p = y.mean()
    score, n_leaves = plain_tree(BASE, bins, p - y, np.full(len(y), p * (1 - p)))
    tree = model.rounds[0][0]
    assert sum(f < 0 and v != 0 for f, v in zip(tree.feature, tree.value)) == n_leaves
    assert tree.values(bins) == pytest.approx(score, abs=1e-9)
    assert model.base == [pytest.approx(np.log(p / (1 - p)))]


def test_gradients_are_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    for scores in (1, 4):
        raw, y, w = rng.normal(size=(50, scores)), rng.integers(0, max(2, scores), 50), rng.random(50)
        loss = lambda r: -w * np.log(boosting.probabilities(r)[np.arange(50), y])
        g, h = boosting.gradients(raw, y, w)
        for k in range(scores):
            step = np.zeros_like(raw)
            step[:, k] = 1e-4
            assert g[:, k] == pytest.approx((loss(raw + step) - loss(raw - step)) / 2e-4, abs=1e-6)
            assert h[:, k] == pytest.approx((loss(raw + step) + loss(raw - step) - 2 * loss(raw)) / 1e-8, abs=1e-5)


@pytest.mark.parametrize(
    "changed",
    [
        {"max_leaves": 2}, {"max_depth": 1}, {"min_rows": 150}, {"min_hessian": 60.0}, {"l1": 20.0}, {"l2": 50.0},
        {"min_gain": 30.0}, {"row_share": 0.5}, {"column_share": 0.34}, {"learning_rate": 0.1}, {"weight": "w"},
    ],
)
def test_every_parameter_changes_the_model(table, changed, plain_values):
    assert values(table, replace(BASE, **changed)) != plain_values


def values(table, booster):
    model = booster.fit(table[0])
    bins = boosting.to_bins(table[1], model.edges)
    return [t.values(bins).round(9).tolist() for trees in model.rounds for t in trees]


@pytest.fixture(scope="module")
def plain_values(table):
    return values(table, BASE)


def test_symmetric_trees_share_the_split_of_a_level(table):
    tree = replace(BASE, symmetric=True, max_leaves=None, max_depth=3).fit(table[0]).rounds[0][0]
    for depth in range(2):  # two levels part the rows, nothing is left for a third
        splits = {(tree.feature[i], tree.bin[i]) for i in range(len(tree.feature)) if tree.depth[i] == depth}
        assert len(splits) == 1 and min(splits)[0] >= 0


def test_classes_stop_on_the_watched_rows(table):
    df, _, _ = table
    booster = B(8, learning_rate=3.0, max_leaves=4, min_rows=5, label="y3", watched="watched", patience=2, max_bins=16)
    model = booster.fit(df)
    assert len(model.losses) < 8 and len(model.rounds) == int(np.argmin(model.losses))
    rows = replace(booster, learning_rate=0.5, rounds=2, max_leaves=5).fit(df).transform(df).collect()
    assert np.mean([int(np.argmax(r["probability"].toArray())) == r["y3"] for r in rows]) > 0.9
    assert {len(r["probability"].toArray()) for r in rows} == {3}
    assert [sum(r["probability"].toArray()) for r in rows] == [pytest.approx(1.0)] * 600


def test_methods_differ_by_their_own_parameters():
    found = {m: boosting.booster_of(m, {"n_estimators": 1}) for m in models.BOOSTED}
    assert len({repr(replace(b, seed=0)) for b in found.values()}) == 3  # hgbt and lgbm have the same defaults
    named = {
        "hgbt": {"max_leaf_nodes": 5, "max_depth": "None", "min_samples_leaf": 7, "learning_rate": 0.2},
        "xgb": {"gamma": 2.0, "min_child_weight": 3, "subsample": 0.7, "colsample_bytree": 0.6, "colsample_bylevel": 0.5, "reg_alpha": 1, "reg_lambda": 2, "max_depth": 3},
        "lgbm": {"num_leaves": 9, "lambda_l1": 1, "lambda_l2": 2},
        "catboost": {"max_depth": 3, "reg_lambda": 9},
    }
    for method, config in named.items():
        for name, value in config.items():
            if value != "None":
                assert boosting.booster_of(method, {name: value}) != boosting.booster_of(method, {}), (method, name)


def test_odd_tables(spark):
    one = spark.createDataFrame([([1.0], 1.0), ([2.0], None), ([None], 1.0), ([float("nan")], 1.0)], "features array<double>, label double")
    assert all(p > 0.99 for p in probability(B(3).fit(one), one))
    with pytest.raises(ValueError):
        B(1).fit(one.limit(0))
    blank = spark.range(60).select(F.array(F.lit(None).cast("double")).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    assert probability(B(2).fit(blank), blank) == [pytest.approx(0.5)] * 60
