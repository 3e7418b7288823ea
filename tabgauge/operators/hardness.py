"""How hard a task is, from the spread of the methods' scores, and how that moves with dataset age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabgauge.functions.scalars import year_of
from tabgauge.operators.results import metric_means


def complete_tasks(results: DataFrame, metric: str, methods: Sequence[str]) -> DataFrame:
    """``(task_id, method, value)`` fold means, only for tasks that every method has."""
    table = metric_means(results.filter(F.col("method").isin(list(methods))), metric)
    whole = table.filter("value is not null").groupBy("task_id").agg(F.count_distinct("method").alias("n"))
    return table.join(whole.filter(F.col("n") == len(methods)).select("task_id"), "task_id", "left_semi")


def hardness_grin(table: DataFrame, methods: Sequence[str], strong: Sequence[str], simple: Sequence[str]) -> DataFrame:
    """Worst strong method minus best simple method, both scaled by the task's range (floor capped at 0.5)."""
    wide = table.groupBy("task_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in methods],
        F.max("value").alias("_max"),
        F.least(F.min("value"), F.lit(0.5)).alias("_min"),
    )
    pick = lambda fn, names: fn(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    scale = F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0))
    low = (pick(F.least, strong) - F.col("_min")) / scale
    high = (pick(F.greatest, simple) - F.col("_min")) / scale
    return wide.select("task_id", *methods, (low - high).alias("hardness"))


def hardness_std(table: DataFrame) -> DataFrame:
    """Sample std of the range-scaled scores of a task, then min-max over the tasks.

    Scaling by the range divides the std by it, so one aggregate per task is enough; the
    overall minimum and maximum are scalar subqueries.
    """
    spread = table.groupBy("task_id").agg(
        (F.stddev_samp("value") / F.nullif(F.max("value") - F.least(F.min("value"), F.lit(0.5)), F.lit(0.0))).alias("s")
    )
    low, high = spread.agg(F.min("s")).scalar(), spread.agg(F.max("s")).scalar()
    return spread.select("task_id", ((F.col("s") - low) / F.nullif(high - low, F.lit(0.0))).alias("hardness"))


def with_dataset_id(hardness: DataFrame, task_dim: DataFrame) -> DataFrame:
    """Attach the dataset id and drop rows with anything missing; sort by falling hardness when writing."""
    return hardness.join(task_dim.select("task_id", "dataset_id"), "task_id", "left").na.drop("any")


def dataset_age(years: DataFrame, dataset_id: str = "dataset_id", year: str = "year") -> DataFrame:
    """``(dataset_id, age)``: parse the year, drop what does not parse."""
    parsed = years.select(F.col(dataset_id).alias("dataset_id"), year_of(F.col(year).cast("string")).cast("int").alias("age"))
    return parsed.na.drop("any")


def hardness_with_age(hardness: DataFrame, ages: DataFrame) -> DataFrame:
    """Inner join on dataset id, rows with anything missing dropped."""
    return hardness.join(ages, "dataset_id").na.drop("any")


def membership_labels(points: DataFrame, collections: DataFrame) -> DataFrame:
    """``(suite, dataset_id, in_collection, label)`` for every suite and every dataset."""
    names = collections.agg(F.array_sort(F.collect_set("suite"))).scalar()  # the suites, a few dozen
    every = points.select("dataset_id").distinct().withColumn("suite", F.explode(names))
    members = collections.select("suite", "dataset_id").distinct().withColumn("_in", F.lit(True))
    flagged = every.join(members, ["suite", "dataset_id"], "left").withColumn("in_collection", F.coalesce("_in", F.lit(False)))
    return flagged.select(
        "suite", "dataset_id", "in_collection", F.when(F.col("in_collection"), "in_collection").otherwise("not_in_collection").alias("label")
    )
