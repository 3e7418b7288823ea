"""The perceptron: its summed gradient against numpy, and its parameters one by one."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabgauge.operators import models, perceptron

BASE = perceptron.Perceptron((6,), step_size=0.1, steps=4, early_stopping=False)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    rows = [(x[i].tolist(), int(y[i]), float(i % 4 + 1), i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "features array<double>, label int, w double, watched boolean")
    return df.repartition(20).cache(), x, y


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_the_gradient_is_the_slope_of_the_loss(activation):
    rng = np.random.default_rng(1)
    sizes = [3, 5, 4, 3]
    flat = perceptron.start(sizes, activation, 0)
    x, y, w = rng.normal(size=(30, 3)), rng.integers(0, 3, 30), rng.random(30)
    g, _ = perceptron.gradient(x, y, w, flat, sizes, activation)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (perceptron.gradient(x, y, w, flat + s, sizes, activation)[1] for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_tasks_add_up_to_the_whole_table(table):
    df, x, y = table
    rows = replace(BASE, weight="w", watched="watched").prepared(df)
    sizes = [3, 6, 2]
    flat = perceptron.start(sizes, "relu", 3)
    total, (loss, weight, _, watched_weight) = perceptron.summed_gradient(rows, flat, sizes, "relu")
    i = np.arange(400)
    fit = i % 5 != 0
    g, whole = perceptron.gradient(x[fit], y[fit], (i % 4 + 1.0)[fit], flat, sizes, "relu")
    assert total == pytest.approx(g, abs=1e-9) and loss == pytest.approx(whole)
    assert weight == (i % 4 + 1)[fit].sum() and watched_weight == (i % 4 + 1)[~fit].sum()


@pytest.mark.parametrize("changed", [{"activation": "tanh"}, {"alpha": 5.0}, {"step_size": 0.01}, {"schedule": "invscaling"}, {"hidden": (6, 6)}, {"weight": "w"}])
def test_every_parameter_changes_the_model(table, changed):
    fitted = [b.fit(table[0]).flat for b in (replace(BASE, **changed), BASE)]
    assert len(fitted[0]) != len(fitted[1]) or np.abs(fitted[0] - fitted[1]).max() > 1e-6


def test_it_learns_and_stops(table):
    df, _, _ = table
    model = perceptron.Perceptron((16,), step_size=0.05, steps=60, early_stopping=False).fit(df)
    rows = model.transform(df).select("label", "probability").collect()
    assert np.mean([int(np.argmax(r["probability"].toArray())) == r["label"] for r in rows]) > 0.9
    stopped = perceptron.Perceptron((4,), step_size=3.0, steps=60, patience=3, watched="watched").fit(df)
    assert len(stopped.losses) < 60


def test_configuration_and_odd_tables(spark):
    named = {"num_nodes_per_layer": 7, "hidden_layer_depth": 2, "activation": "tanh", "alpha": 0.5, "learning_rate_init": 0.2, "learning_rate": "adaptive", "early_stopping": "False"}
    plain = models.build("sklearn_mlp", {}, {"seed": 1})
    assert all(models.build("sklearn_mlp", {k: v}, {"seed": 1}) != plain for k, v in named.items())
    df = spark.range(30).select(F.array(F.col("id").cast("double")).alias("features"), F.when(F.col("id") > 3, 1).alias("label"))
    assert BASE.fit(df).transform(df).count() == 30
    with pytest.raises(ValueError):
        BASE.fit(df.limit(0))
