"""Stratified, seeded splits as long tables ``(row_key, fold, split)``; a null split is a test row.

Within a class, rows are dealt to the splits in digest order, so class counts differ by
at most one between splits. The place of a row comes from ``digest_positions``, which
cuts each class into pieces: three classes over billions of rows still use every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.functions.digest import order_key
from tabgauge.functions.ordered import digest_positions
from tabgauge.schema import Dataset


def outer_folds(df: DataFrame, key: str, fold_of: Column, n_folds: int, only: Sequence[int] | None = None) -> DataFrame:
    """Repeat each row for every fold, or for those of ``only``, and mark whether it is that fold's test row."""
    wanted = [f for f in range(n_folds) if only is None or f in only]
    folds = F.explode(F.array(*[F.lit(f) for f in wanted]).cast("array<int>")).alias("fold")
    return df.withColumn("_test_fold", fold_of.cast("int")).select("*", folds).withColumn("is_test", F.col("fold") == F.col("_test_fold"))


def stratified_splits(
    df: DataFrame, key: str, target: str, fold_of: Column, n_folds: int = 4, n_splits: int = 5, seed: int = 42,
    only: Sequence[int] | None = None,
) -> DataFrame:
    """``n_splits`` stratified splits inside the training rows of each outer fold.

    Folds are dealt apart, so a caller that reads some of them names these in ``only`` and gets the same rows for them.
    """
    rows = outer_folds(df.select(key, target), key, fold_of, n_folds, only)
    rows = rows.select(F.col(key).alias("row_key"), F.col(target).alias("_y"), "fold", "is_test")
    train = rows.filter(~F.col("is_test")).withColumn("_digest", order_key(seed, "fold", "row_key"))
    dealt = digest_positions(train, ["fold", "_y"], "_digest").select(
        "row_key", "fold", ((F.col("position") - 1) % n_splits).cast("int").alias("split")
    )
    test = rows.filter("is_test").select("row_key", "fold", F.lit(None).cast("int").alias("split"))
    return dealt.unionByName(test)


def stratified_holdout(df: DataFrame, key: str, target: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """``(row_key, part)`` with the first ``round(share * class size)`` rows of a class in ``train``."""
    rows = df.select(F.col(key).alias("row_key"), F.col(target).alias("_y")).withColumn("_digest", order_key(seed, "row_key"))
    sizes = rows.groupBy("_y").agg(F.round(train_share * F.count(F.lit(1))).alias("_take"))
    # one row per class; adaptive execution broadcasts it when it is small
    placed = digest_positions(rows, ["_y"], "_digest").join(sizes, "_y")
    return placed.select("row_key", F.when(F.col("position") <= F.col("_take"), "train").otherwise("valid").alias("part"))


def split_parts(splits: DataFrame, fold: int, split: int) -> DataFrame:
    """``(row_key, part)`` of one fold and validation split."""
    part = F.when(F.col("split").isNull(), "test").when(F.col("split") == split, "valid").otherwise("train")
    return splits.filter(F.col("fold") == fold).select("row_key", part.alias("part"))


def fold_parts(splits: DataFrame, fold: int) -> DataFrame:
    """``(row_key, part)`` with train and test only, for a refit."""
    part = F.when(F.col("split").isNull(), "test").otherwise("train")
    return splits.filter(F.col("fold") == fold).select("row_key", part.alias("part"))


def with_parts(dataset: Dataset, parts: DataFrame) -> DataFrame:
    """Dataset rows with their part; rows without one are left out."""
    key = dataset.roles.key
    return dataset.df.join(parts.withColumnRenamed("row_key", key), key)


def uncovered_rows(df: DataFrame, key: str, splits: DataFrame) -> DataFrame:
    """Rows that a fold misses or holds more than once: ``(row_key, fold, times)``; empty when all is well."""
    every = splits.agg(F.array_sort(F.collect_set("fold"))).scalar()  # the folds, a handful
    expected = df.select(F.col(key).alias("row_key"), F.explode(every).alias("fold"))
    seen = splits.groupBy("row_key", "fold").agg(F.count(F.lit(1)).alias("times"))
    return (
        expected.join(seen, ["row_key", "fold"], "left")
        .withColumn("times", F.coalesce("times", F.lit(0)))
        .filter("times <> 1")
    )


def wide_splits(splits: DataFrame, folds: list[int], prefix: str = "fold_") -> DataFrame:
    """One row per sample and one column per fold."""
    return splits.groupBy("row_key").pivot("fold", folds).agg(F.first("split")).select(
        "row_key", *[F.col(str(f)).alias(f"{prefix}{f}") for f in folds]
    )
