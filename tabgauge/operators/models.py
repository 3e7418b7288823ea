"""Model registry: each role is filled by the MLlib estimator that trains distributed.

Scores differ from those of single-machine libraries; what is kept is the role, the
parameters that have a counterpart, and the default of each search space.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabgauge.functions.digest import child_seed_value
from tabgauge.functions.scalars import sigmoid, softmax
from tabgauge.operators import boosting, trees
from tabgauge.operators.perceptron import Perceptron

Builder = Callable[[Mapping[str, Any], dict], Estimator]
MODELS: dict[str, Builder] = {}

def model(name: str):
    """Register an estimator builder ``(config, facts) -> Estimator``.

    ``facts``: n_rows, n_features, n_classes, seed, and optionally weight and valid columns.
    """

    def add(builder: Builder) -> Builder:
        MODELS[name] = builder
        return builder

    return add


def _number(value, default):
    return default if value in (None, "None", "") else float(value)


def _flag(value, default):
    return default if value is None else str(value).lower() == "true"


def _with_weight(estimator, facts):
    return estimator.setWeightCol(facts["weight"]) if facts.get("weight") else estimator


#: MB that the gradients of one step may take together before the rows go to fewer tasks
GRADIENTS_MB = 64
#: tasks of a step for each core, where gradients are short
TASKS_A_CORE = 3
#: largest block of rows, in MB
LARGEST_BLOCK_MB = 128.0


class GatheredLogistic:
    """Logistic regression with a few gradients for each core, in place of one for each partition.

    Each of about a hundred steps is a job. A task returns a gradient as long as the coefficients and adds one of that length
    for each of its blocks of rows: with many features and partitions, these outweigh the rows. So the rows are read by a
    few tasks for each core, one at least, in blocks of a few times the gradient. Rows and steps stay the same.
    """

    def __init__(self, estimator: LogisticRegression, n_numbers: int):
        self.gradient_mb = 8 * max(n_numbers, 1) / 1e6
        self.estimator = estimator.setMaxBlockSizeInMB(min(LARGEST_BLOCK_MB, max(1.0, 4 * self.gradient_mb)))

    def tasks(self, cores: int) -> int:
        return max(cores, min(TASKS_A_CORE * cores, int(GRADIENTS_MB / self.gradient_mb)))

    def fit(self, df: DataFrame):
        return self.estimator.fit(df.coalesce(self.tasks(df.sparkSession.sparkContext.defaultParallelism)))


@model("linear")
def _linear(config, facts):
    penalty = config.get("penalty", "l2")
    strength = _number(config.get("C"), 1.0)
    reg = 0.0 if penalty in (None, "None") else 1.0 / (strength * max(facts["n_rows"], 1))
    est = LogisticRegression(regParam=reg, fitIntercept=_flag(config.get("fit_intercept"), True), maxIter=100)
    n_numbers = facts["n_features"] * (facts["n_classes"] if facts["n_classes"] > 2 else 1)
    return GatheredLogistic(_with_weight(est, facts), n_numbers)


@model("tree")
def _tree(config, facts):
    return trees.tree_of(config, facts["seed"], facts.get("weight"))


@model("rf")
def _rf(config, facts):
    return trees.forest_of(config, facts["seed"], facts.get("weight"))


def _boosted(method: str) -> Builder:
    return lambda config, facts: boosting.with_facts(boosting.booster_of(method, config), facts)


BOOSTED = ("hgbt", "xgb", "lgbm", "catboost")
MODELS.update({name: _boosted(name) for name in BOOSTED})


@model("sklearn_mlp")
def _mlp(config, facts):
    return Perceptron(
        hidden=(int(_number(config.get("num_nodes_per_layer"), 32)),) * int(_number(config.get("hidden_layer_depth"), 1)),
        activation=str(config.get("activation", "relu")),
        alpha=_number(config.get("alpha"), 1e-4),
        step_size=_number(config.get("learning_rate_init"), 1e-3),
        schedule=str(config.get("learning_rate", "constant")),
        early_stopping=_flag(config.get("early_stopping"), True),
        steps=int(_number(config.get("max_iter"), 200)),
        seed=facts["seed"],
        weight=facts.get("weight"),
        watched=facts.get("valid"),
    )


@model("svm")
def _svm(config, facts):
    # C is the inverse of the regularisation, and counts per row
    est = LinearSVC(regParam=1.0 / (_number(config.get("C"), 1.0) * max(facts["n_rows"], 1)), maxIter=50)
    return _with_weight(OneVsRest(classifier=est) if facts["n_classes"] > 2 else est, facts)


@model("linear_regression")
def _linear_regression(config, facts):
    return _with_weight(LinearRegression(regParam=_number(config.get("alpha"), 0.0)), facts)


@model("tree_regression")
def _tree_regression(config, facts):
    return DecisionTreeRegressor(maxDepth=int(_number(config.get("max_depth"), 5)), seed=facts["seed"])


@model("rf_regression")
def _rf_regression(config, facts):
    return RandomForestRegressor(
        numTrees=int(_number(config.get("n_estimators"), 50)), maxDepth=int(_number(config.get("max_depth"), 5)), seed=facts["seed"]
    )


def build(name: str, config: Mapping[str, Any], facts: dict) -> Estimator:
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}")
    return MODELS[name](config, facts)


def balanced_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """``n / (k * n_class)`` per row; class counts are one small table joined by label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, classes = counts.agg(F.sum("_n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(label, (total / (classes * F.col("_n"))).alias(output))
    return df.join(weights, label)


def assemble(df: DataFrame, columns, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def vector_size(df: DataFrame, column: str) -> int:
    """Entries of a vector column, by its metadata, or by a row where it has none."""
    size = df.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
    return size if size is not None else df.select(column).first()[0].size


def predict_proba(fitted, df: DataFrame, n_classes: int, output: str = "probs") -> DataFrame:
    """Add class probabilities as an array.

    Models without probabilities (one-vs-rest, linear SVM) give the softmax of their raw
    scores; a regressor gives its prediction as one entry.
    """
    scored = fitted.transform(df)
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
    elif "rawPrediction" in scored.columns:
        raw = vector_to_array("rawPrediction")
        probs = softmax(raw) if n_classes > 2 else F.array(1 - sigmoid(raw[1]), sigmoid(raw[1]))
    else:
        probs = F.array(F.col("prediction"))
    extra = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(output, probs).drop(*extra)


def model_seed(seed: int, *names) -> int:
    return child_seed_value(seed, ":".join(str(n) for n in names))
