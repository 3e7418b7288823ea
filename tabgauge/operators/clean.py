"""Dataset manipulators: ``Dataset`` in, ``Dataset`` out, chained by name.

A manipulator reports what it removed in ``info``. Rows are chosen by digest of the row
key, so the same rows stay for any partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from tabgauge.functions.digest import order_key
from tabgauge.functions.ordered import first_by_digest
from tabgauge.operators.profile import distinct_counts
from tabgauge.schema import Dataset

PREPROCESS_SEED = 0

Manipulator = Callable[..., Dataset]
MANIPULATORS: dict[str, Manipulator] = {}


def manipulator(fn: Manipulator) -> Manipulator:
    """Register a manipulator under its function name."""
    MANIPULATORS[fn.__name__] = fn
    return fn


def manipulate(dataset: Dataset, names: Sequence[str], **arguments) -> Dataset:
    """Run manipulators in order; ``name__argument=value`` reaches the one it names."""
    for name in names:
        prefix = f"{name}__"
        own = {k[len(prefix) :]: v for k, v in arguments.items() if k.startswith(prefix)}
        dataset = MANIPULATORS[name](dataset, **own)
    return dataset


@manipulator
def remove_high_cardinality(dataset: Dataset, threshold: int = 20, approximate: bool = False) -> Dataset:
    """Drop categorical columns with more than ``threshold`` distinct values."""
    counts = distinct_counts(dataset.df, dataset.roles.categorical, approximate)
    gone = [c for c, n in counts.items() if n > threshold]
    return dataset.with_df(dataset.df, dataset.roles.drop(gone), n_high_cardinality=len(gone))


@manipulator
def remove_pseudo_categorical(dataset: Dataset, threshold: int = 10, approximate: bool = False) -> Dataset:
    """Drop numeric columns with fewer than ``threshold`` distinct values."""
    counts = distinct_counts(dataset.df, dataset.roles.numerical, approximate)
    gone = [c for c, n in counts.items() if n < threshold]
    return dataset.with_df(dataset.df, dataset.roles.drop(gone), num_pseudo_categorical_cols=len(gone))


def _any_missing(dataset: Dataset):
    missing = F.lit(False)
    for c in dataset.roles.features:
        missing = missing | F.col(c).isNull()
    return missing


@manipulator
def remove_rows_with_missing_values(dataset: Dataset) -> Dataset:
    """Drop rows with any missing feature."""
    removed = dataset.df.agg(F.count_if(_any_missing(dataset)).alias("n")).first()["n"]
    return dataset.with_df(dataset.df.na.drop("any", subset=dataset.roles.features), num_missing_rows=removed)


@manipulator
def remove_missing_values(dataset: Dataset, threshold: float = 0.7) -> Dataset:
    """Drop columns missing in more than ``threshold`` of the rows, then rows with a missing feature."""
    shares = dataset.df.agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in dataset.roles.features]
    ).first()
    gone = [c for c in dataset.roles.features if (shares[c] or 0.0) > threshold]
    kept = dataset.with_df(dataset.df, dataset.roles.drop(gone), num_missing_cols=len(gone))
    return remove_rows_with_missing_values(kept)


@manipulator
def balance_binarize(dataset: Dataset, seed: int = PREPROCESS_SEED) -> Dataset:
    """Keep the two largest classes, cut the larger to the size of the other, relabel 0 and 1.

    The largest class (on equal counts the higher label) becomes 0, the next becomes 1.
    """
    target, key = dataset.roles.target, dataset.roles.key
    top = (
        dataset.df.filter(F.col(target).isNotNull())
        .groupBy(target)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc(target))
        .limit(2)
        .collect()
    )
    if len(top) < 2:
        raise ValueError("cannot balance a dataset with fewer than two classes")
    first, second = top[0], top[1]
    larger = dataset.df.filter(F.col(target) == first[target]).withColumn("_digest", order_key(seed, key))
    # only the larger class is ranked; the other one is kept as it is
    sample = first_by_digest(larger, second["n"], "_digest").drop("_digest").withColumn(target, F.lit(0))
    rest = dataset.df.filter(F.col(target) == second[target]).withColumn(target, F.lit(1))
    return dataset.with_df(sample.unionByName(rest))


@manipulator
def subsample_rows(dataset: Dataset, threshold: int = 10_000, seed: int = PREPROCESS_SEED) -> Dataset:
    """Exactly ``threshold`` rows without replacement, if there are more."""
    n = dataset.df.count()
    if n <= threshold:
        return dataset.with_df(dataset.df, num_samples=n)
    keyed = dataset.df.withColumn("_digest", order_key(seed, dataset.roles.key))
    return dataset.with_df(first_by_digest(keyed, threshold, "_digest").drop("_digest"), num_samples=threshold)


@manipulator
def subsample_columns(dataset: Dataset, threshold: int = 10, seed: int = PREPROCESS_SEED) -> Dataset:
    """``threshold`` feature columns, if there are more, chosen by the digest of their names."""
    features = dataset.roles.features
    if len(features) > threshold:
        ordered = sorted(features, key=lambda c: hashlib.md5(f"{seed}:{c}".encode()).hexdigest())
        features = ordered[:threshold]
    return dataset.with_df(dataset.df, dataset.roles.keep(features), num_features=len(features))


def merge_rare_classes(df, target: str, share: float = 0.01, other: str = "others"):
    """Classes below ``share`` of all rows become one class ``other``.

    Class counts are one small aggregate; rows meet it through an ordinary join that
    adaptive execution turns into a broadcast when the class table is small.
    """
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    rare = counts.filter(F.col("_n") < share * total).select(F.col(target).alias("_rare"))
    marked = df.join(rare, F.col(target) == F.col("_rare"), "left")
    return marked.withColumn(target, F.when(F.col("_rare").isNotNull(), other).otherwise(F.col(target))).drop("_rare")

