"""Trees of any depth: against a plain tree, on their own training rows, and parameter by parameter."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabgauge.operators import models, trees

SMALL = trees.Forest(handoff=60, max_bins=8)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)).round(3)
    x[:, 1] = np.where(rng.random(500) < 0.97, 1.0, x[:, 1])  # nearly all rows share a value
    x[::17, 2] = np.nan
    y = rng.integers(0, 3, 500)
    rows = [(i, x[i].tolist(), float(y[i]), float(1 + i % 3)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, features array<double>, label double, w double").repartition(3).cache(), x, y


def probs(model, df):
    rows = models.predict_proba(model, df, 3).select("id", "probs").collect()
    return np.array([r["probs"] for r in sorted(rows, key=lambda r: r["id"])])


def plain(x, y, w, depth, criterion, min_leaf):
    """Class shares of every row by trying all splits of all nodes."""

    def impurity(rows):
        c = np.bincount(y[rows], w[rows], 3)
        p = c / c.sum()
        return c.sum() * (1 - (p * p).sum() if criterion == "gini" else -(p[p > 0] * np.log2(p[p > 0])).sum())

    out = np.zeros((len(y), 3))

    def split(rows, depth):
        found = None
        if depth and impurity(rows) > 1e-9:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= cut
                    if min(left.sum(), (~left).sum()) >= min_leaf:
                        gain = impurity(rows) - impurity(rows[left]) - impurity(rows[~left])
                        if found is None or gain > found[0] + 1e-8:
                            found = gain, left
        if found is None:
            out[rows] = np.bincount(y[rows], w[rows], 3) / w[rows].sum()
        else:
            split(rows[found[1]], depth - 1)
            split(rows[~found[1]], depth - 1)

    split(np.arange(len(y)), depth)
    return out


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_a_handed_tree_is_the_plain_one(table, criterion):
    df, x, y = table
    got = probs(trees.Forest(max_depth=4, min_leaf=5, criterion=criterion, weight="w").fit(df), df)
    weights = 1.0 + np.arange(500) % 3
    assert got == pytest.approx(plain(np.where(np.isnan(x), -np.inf, x), y, weights, 4, criterion, 5), abs=1e-9)


def test_a_tree_without_limits_fits_its_rows(table, monkeypatch):
    """Large nodes by histogram, small ones handed on; labels are noise, so only full depth gets all of them."""
    df, x, y = table
    model = SMALL.fit(df)
    assert len(model.tops[0].feature) > 9 and model.subtrees.count() > 5
    got = probs(model, df)
    assert (got.argmax(axis=1) == y).all() and (got.max(axis=1) == 1).all()
    monkeypatch.setattr(trees, "SHIPPED_NODES", 0)
    joined = model.transform(df.withColumn("_row", F.lit("x")))
    assert joined.columns == [*df.columns, "_row", "probability"]
    assert (probs(model, df) == got).all()


def test_a_node_within_one_bin_gets_bins_of_its_own(spark):
    """99 of 100 rows lie in one bin of the first bins; they differ there."""
    rows = [(i, [1.0 if i % 100 else float(i)], float(i % 100 == 0), 1.0) for i in range(2000)]
    rows += [(2000 + i, [1.0 - 1e-6 * (i % 7)], float(i % 7 > 3), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, w double")
    got = probs(replace(SMALL, max_bins=4).fit(df), df)
    truth = np.array([r[2] for r in rows])
    wrong = got.argmax(axis=1) != truth
    assert all(rows[i][1][0] == 1.0 for i in np.flatnonzero(wrong))  # equal rows with other labels alone


def test_parameters_reach_the_tree(table):
    df, x, y = table
    build = lambda name, config: models.build(name, config, {"n_rows": 500, "n_features": 4, "n_classes": 3, "seed": 1})
    base = probs(build("tree", {}).fit(df), df)
    for config in (
        {"criterion": "entropy", "max_depth": "3"}, {"max_depth": 2}, {"min_samples_split": 40}, {"min_samples_split": 0.2},
        {"min_samples_leaf": 9}, {"min_weight_fraction_leaf": 0.05}, {"min_impurity_decrease": 0.01}, {"max_depth": 3, "splitter": "random"},
    ):
        got = probs(build("tree", config).fit(df), df)
        assert not np.allclose(got, base), config
        assert not np.allclose(got, probs(build("tree", {"max_depth": 3}).fit(df), df)), config
    leaf = build("tree", {"min_samples_leaf": 9}).fit(df).subtrees.first()
    assert len(leaf["feature"]) < 2 * 500 / 9
    with pytest.raises(ValueError, match="criterion"):
        build("tree", {"criterion": "other"})


def test_a_forest_averages_bootstrapped_trees(table):
    df, x, y = table
    build = lambda **c: models.build("rf", {"n_estimators": 20, **c}, {"n_rows": 500, "n_features": 4, "n_classes": 3, "seed": 1})
    got = probs(build().fit(df), df)
    assert got.sum(axis=1) == pytest.approx(np.ones(500)) and 0.8 < (got.argmax(axis=1) == y).mean()
    assert (got.max(axis=1) < 1).mean() > 0.9  # each tree leaves out a third of the rows
    assert (probs(build().fit(df), df) == got).all()
    large = replace(build(), handoff=60, max_bins=16)
    assert 0.8 < (probs(large.fit(df), df).argmax(axis=1) == y).mean()
    assert not np.allclose(probs(build(bootstrap=False).fit(df), df), got)
    assert not np.allclose(probs(build(max_features="None").fit(df), df), got)


def test_odd_tables(spark):
    schema = "id long, features array<double>, label double, w double"
    with pytest.raises(ValueError, match="no rows"):
        SMALL.fit(spark.createDataFrame([(1, [1.0], None, 1.0)], schema))
    df = spark.createDataFrame([(i, [None, 2.0], float(i % 2), float(i > 1)) for i in range(200)], schema)
    got = probs(replace(SMALL, weight="w").fit(df), df)  # equal rows: one leaf, though larger than what is handed on
    assert got[:, :2] == pytest.approx(np.full((200, 2), 0.5))


def test_equal_rows_are_counted_once(spark):
    """Cells of equal rows larger than what is handed on take no histograms; limits are about rows, not about cells."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, (6000, 2)).astype(float), rng.integers(0, 3, 6000)
    x[x == 3] = np.nan
    rows = [(i, x[i].tolist(), float(y[i]), float(1 + i % 3)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, w double").repartition(3)
    known, weights = np.where(np.isnan(x), -np.inf, x), 1.0 + np.arange(6000) % 3
    for limits in ({}, {"min_leaf": 700, "max_depth": 3}):
        model = replace(SMALL, weight="w", **limits).fit(df)
        assert len(model.tops[0].feature) == 1 and model.subtrees.count() == 1
        want = plain(known, y, weights, limits.get("max_depth", 9), "gini", limits.get("min_leaf", 1))
        assert probs(model, df) == pytest.approx(want, abs=1e-9)


def test_large_nodes_of_counted_rows(spark):
    """Cells that are too many for one task: histograms add up the rows they stand for."""
    rows = [(i, [float(i % 180)], float(i % 180 >= 90), 1.0) for i in range(1800)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, w double")
    model = replace(SMALL, max_depth=2, min_leaf=850).fit(df)  # a leaf of 850 rows is one of 85 cells
    top = model.tops[0]
    assert sum(f >= 0 for f in top.feature) == 1 and sorted(w.sum() for w in top.weights) == pytest.approx([850, 950, 1800], abs=50)
    assert probs(model, df)[:, :2].max(axis=1).min() > 0.9


def test_open_nodes_fit_one_job(table, monkeypatch):
    """More rows are handed on where the large nodes of a level would ask for several jobs."""
    df, x, y = table
    monkeypatch.setattr(trees.boosting, "CELLS", 800)  # 4 nodes a job, 200 rows a task
    asked, best = [], trees.Forest._best
    monkeypatch.setattr(trees.Forest, "_best", lambda self, *given: asked.append(1) or best(self, *given))
    model = replace(SMALL, handoff=20).fit(df)
    top = model.tops[0]
    assert len(asked) == len({top.depth[i] for i, f in enumerate(top.feature) if f >= 0})
    assert (probs(model, df).argmax(axis=1) == y).all()
