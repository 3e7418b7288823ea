"""Hyperparameter spaces as tables, and seeded random configurations drawn from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabgauge.functions.digest import uniform
from tabgauge.functions.ordered import running_before
from tabgauge.functions.scalars import normal_quantile

SPACE_SCHEMA = (
    "model string, name string, kind string, lower double, upper double, log boolean, "
    "mu double, sigma double, default_value string, choices array<string>, weights array<double>"
)


def _choice(name, choices, default, weights=None):
    return (name, "choice", None, None, False, None, None, str(default), [str(c) for c in choices], weights)


def _float(name, lower, upper, default, log=False):
    return (name, "float", float(lower), float(upper), log, None, None, str(default), None, None)


def _int(name, lower, upper, default, log=False):
    return (name, "int", float(lower), float(upper), log, None, None, str(default), None, None)


def _normal(name, mu, sigma, lower, upper, default, log=False, integer=False):
    return (name, "normal_int" if integer else "normal", float(lower), float(upper), log, float(mu), float(sigma), str(default), None, None)


def _constant(name, value):
    return (name, "constant", None, None, False, None, None, str(value), None, None)


# fixed values: the search spaces of the benchmarked models
SPACES = {
    "linear": [
        _choice("penalty", ["l2", "None"], "l2"),
        _choice("fit_intercept", [True, False], True),
        _float("C", 1e-12, math.log(5.0), 1.0, log=True),
    ],
    "tree": [
        _constant("criterion", "gini"),
        _constant("splitter", "best"),
        _constant("min_samples_split", 2),
        _constant("min_samples_leaf", 1),
        _constant("min_weight_fraction_leaf", 0.0),
    ],
    "rf": [
        _choice("criterion", ["gini", "entropy"], "gini"),
        _choice("max_features", ["sqrt", "log2", 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, "None"], "sqrt"),
        _choice("max_depth", ["None", 2, 3, 4], "None", [0.7, 0.1, 0.1, 0.1]),
        _choice("min_samples_split", [2, 3], 2, [0.95, 0.05]),
        _int("min_samples_leaf", 1, 50, 1),
        _choice("bootstrap", [True, False], True),
        _choice("min_impurity_decrease", [0.0, 0.01, 0.02, 0.05], 0.0, [0.85, 0.05, 0.05, 0.05]),
    ],
    "hgbt": [
        _normal("learning_rate", math.log(0.01), math.log(10.0), 2.2250738585072014e-308, 65535, 0.01, log=True),
        _normal("max_leaf_nodes", 31, 5, 2, 65535, 31, integer=True),
        _choice("max_depth", ["None", 2, 3, 4], "None", [0.1, 0.1, 0.7, 0.1]),
        _normal("min_samples_leaf", 20, 2, 1, 65535, 20, integer=True),
    ],
    "sklearn_mlp": [
        _int("hidden_layer_depth", 1, 3, 1),
        _int("num_nodes_per_layer", 16, 264, 32, log=True),
        _choice("activation", ["tanh", "relu"], "relu"),
        _float("alpha", 1e-7, 1e-1, 1e-4, log=True),
        _float("learning_rate_init", 1e-4, 0.5, 1e-3, log=True),
        _choice("early_stopping", [True, False], True),
        _choice("learning_rate", ["constant", "invscaling", "adaptive"], "constant"),
    ],
    "xgb": [
        _int("max_depth", 1, 11, 6),
        _float("gamma", 1e-8, 7, 1e-8, log=True),
        _float("min_child_weight", 1, 100, 1, log=True),
        _float("subsample", 0.5, 1, 1),
        _float("colsample_bytree", 0.5, 1, 1),
        _float("colsample_bylevel", 0.5, 1, 1),
        _float("reg_alpha", 1e-8, 1e2, 1e-8, log=True),
        _float("reg_lambda", 1e-8, 1e2, 1e-8, log=True),
        _float("learning_rate", 1e-5, 0.7, 0.3, log=True),
    ],
    "lgbm": [
        _int("num_leaves", 2, 4096, 31, log=True),
        _float("lambda_l1", 1e-8, 10, 1e-8, log=True),
        _float("lambda_l2", 1e-8, 10, 1e-8, log=True),
        _float("learning_rate", 0.01, 0.3, 0.1, log=True),
    ],
    "catboost": [
        _int("max_depth", 2, 12, 6, log=True),
        _float("reg_lambda", 0.5, 30, 3, log=True),
        _float("learning_rate", 0.01, 0.3, 0.03, log=True),
    ],
}

# fixed values: shown names of the kinds
KIND_LABELS = {
    "choice": "Categorical",
    "constant": "Categorical",
    "float": "UniformFloat",
    "int": "UniformInt",
    "normal": "NormalFloat",
    "normal_int": "NormalInt",
}


def space_table(spark: SparkSession, models=None) -> DataFrame:
    """The spaces of some or all models as one small table."""
    rows = [(m, *p) for m, params in SPACES.items() if models is None or m in models for p in params]
    return spark.createDataFrame(rows, SPACE_SCHEMA)


def _space_literal(models) -> Column:
    """The parameters of some models as one literal array of structs."""
    names = [c.split()[0] for c in SPACE_SCHEMA.split(", ")]
    rows = [(m, *p) for m in models for p in SPACES[m]]

    def cell(name, value):
        kind = {"choices": "array<string>", "weights": "array<double>", "log": "boolean"}.get(
            name, "double" if name in ("lower", "upper", "mu", "sigma") else "string"
        )
        literal = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        return literal.cast(kind).alias(name)

    return F.array(*[F.struct(*[cell(n, v) for n, v in zip(names, row)]) for row in rows])


def draw(keys: DataFrame, models, seed: int = 42, key: str = "draw") -> DataFrame:
    """``(key, model, name, value)``: one value per key and parameter of the models.

    Every cell takes its uniform number from the digest of (seed, model, parameter, key)
    and maps it: weighted choice by cumulated weights, linear or logarithmic ranges,
    normal by its quantile, clipped to the range.
    """
    cells = keys.select(key, F.explode(_space_literal(models)).alias("p")).select(key, "p.*")
    u = uniform(seed, "model", "name", key)
    n = F.size("choices")
    weights = F.coalesce("weights", F.transform("choices", lambda _: F.lit(1.0) / n))
    reached = F.transform(weights, lambda _, i: F.aggregate(F.slice(weights, 1, i + 1), F.lit(0.0), lambda a, w: a + w))
    index = F.least(F.size(F.filter(reached, lambda c: c <= F.col("u"))) + 1, n)
    low = F.when(F.col("log"), F.ln("lower")).otherwise(F.col("lower"))
    high = F.when(F.col("log"), F.ln("upper")).otherwise(F.col("upper"))
    span = F.when(F.col("kind") == "int", F.when(F.col("log"), F.ln(F.col("upper") + 1)).otherwise(F.col("upper") + 1)).otherwise(high)
    uniform_value = low + F.col("u") * (span - low)
    normal_value = F.col("mu") + F.col("sigma") * normal_quantile(F.greatest(F.col("u"), F.lit(1e-12)))
    raw = F.when(F.col("kind").isin("normal", "normal_int"), normal_value).otherwise(uniform_value)
    plain = F.when(F.col("log"), F.exp(raw)).otherwise(raw)
    number = F.greatest(F.least(plain, F.col("upper")), F.col("lower"))
    value = (
        F.when(F.col("kind") == "constant", F.col("default_value"))
        .when(F.col("kind") == "choice", F.element_at("choices", index))
        .when(F.col("kind") == "int", F.floor(number).cast("string"))
        .when(F.col("kind") == "normal_int", F.round(number).cast("bigint").cast("string"))
        .otherwise(number.cast("string"))
    )
    return cells.withColumn("u", u).select(key, "model", "name", value.alias("value"))


def random_configs(spark: SparkSession, model: str, n: int = 400, seed: int = 42, oversample: float = 2.0) -> DataFrame:
    """``(config_id, values map)``: the default as id 1, then up to ``n`` distinct draws in draw order."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))
    default = (
        space_table(spark, [model])
        .select("name", F.col("default_value").alias("value"))
        .agg(entries.alias("values"))
        .withColumn("draw", F.lit(-1).cast("bigint"))
    )
    keys = spark.range(int(n * oversample) + 8).withColumnRenamed("id", "draw")
    drawn = draw(keys, [model], seed).groupBy("draw").agg(entries.alias("values"))
    # equal draws are one configuration: the earliest draw stands for it
    pool = default.unionByName(drawn).withColumn("_text", F.to_json("values"))
    distinct = pool.groupBy("_text").agg(F.min("draw").alias("draw"), F.first("values").alias("values"))
    first = distinct.orderBy("draw").limit(n + 1).withColumn("_one", F.lit(1))  # a few hundred rows
    placed = running_before(first, [], ["draw"], {"_before": "_one"}, bounded=True)
    return placed.select((F.col("_before") + 1).cast("int").alias("config_id"), "values")


def space_report(space: DataFrame) -> DataFrame:
    """``(model, name, type, default, range)`` as shown in a table."""
    kinds = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    shown = (
        F.when(F.col("kind") == "choice", F.concat(F.lit("{"), F.concat_ws(", ", "choices"), F.lit("}")))
        .when(F.col("kind") == "constant", F.col("default_value"))
        .otherwise(F.format_string("[%s, %s]", F.col("lower").cast("string"), F.col("upper").cast("string")))
    )
    return space.select("model", "name", kinds[F.col("kind")].alias("type"), F.col("default_value").alias("default"), shown.alias("range"))
