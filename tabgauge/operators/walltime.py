"""Walltime views over ``(method, fold, split, config, task_id, total_walltime, ...)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values
DAY_SECONDS = 86_400
DEFAULT_CUTOFF = 3_600.0
ERRORED_TRIAL_TIME = -8_640.0


def under_cutoff(wide: DataFrame, cutoff: float = DEFAULT_CUTOFF, time: str = "total_walltime") -> DataFrame:
    """Rows that took less than ``cutoff`` seconds; a missing time does not pass."""
    return wide.filter(F.col(time) < cutoff)


def _valid_time(time: str) -> Column:
    return F.when((F.col(time) > 0) & (F.col(time) < DAY_SECONDS), F.col(time))


def total_days(wide: DataFrame, n_splits: int = 5, time: str = "total_walltime") -> DataFrame:
    """Days per method over times in (0, 86400), times the number of splits; methods without any are left out."""
    return (
        wide.groupBy("method")
        .agg((F.sum(_valid_time(time)) * n_splits / DAY_SECONDS).alias("days"))
        .filter("days > 0")
    )


def total_days_per_cutoff(wide: DataFrame, cutoffs: Sequence[float], n_splits: int = 5, time: str = "total_walltime") -> DataFrame:
    """``(method, fold, cutoff, days)`` for all cutoffs in one pass: conditional sums, then long."""
    names = {f"c{i}": c for i, c in enumerate(cutoffs)}
    wide_days = wide.groupBy("method", "fold").agg(
        *[(F.sum(F.when(F.col(time) < c, _valid_time(time))) * n_splits / DAY_SECONDS).alias(n) for n, c in names.items()]
    )
    cutoff = F.create_map(*[x for n, c in names.items() for x in (F.lit(n), F.lit(float(c)))])
    return wide_days.unpivot(["method", "fold"], list(names), "name", "days").select(
        "method", "fold", cutoff[F.col("name")].alias("cutoff"), F.coalesce("days", F.lit(0.0)).alias("days")
    )


def histogram(wide: DataFrame, by: Sequence[str], bins: int = 100, time: str = "total_walltime") -> DataFrame:
    """``(by..., bin, n)`` with equal-width bins from each group's smallest to largest time.

    A missing time counts as 24 hours; the last bin holds the maximum. The edges are one
    row per group; equal times are counted before they meet the edges.
    """
    by = list(by)
    times = wide.select(*by, F.coalesce(F.col(time), F.lit(float(DAY_SECONDS))).alias("t")).groupBy(*by, "t").agg(F.count(F.lit(1)).alias("n"))
    edges = times.groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("t") - F.col("lo")) / width), F.lit(bins - 1)))
    return times.join(edges, by).groupBy(*by, place.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def positive_cells(counts: DataFrame, value: str) -> DataFrame:
    """Keep what is above zero, as the failed-configuration view does."""
    return counts.filter(F.col(value) > 0)


def failed_config_counts(wide: DataFrame, measure: str) -> DataFrame:
    """``(method, task_id, n_failed)``: configurations without a value, where there are any."""
    failed = wide.groupBy("method", "task_id").agg(F.count_if(F.col(measure).isNull()).alias("n_failed"))
    return positive_cells(failed, "n_failed")
