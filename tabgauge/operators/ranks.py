"""Ranks of methods, incumbent trajectories, and rank lines over growing task sets.

Inputs are already aggregated: one row per (task, method), or one per (group, config). A
rank window therefore spans the methods of a task, and a trajectory window the configs of
one search; both are bounded by the experiment grid, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tabgauge.functions.digest import order_key
from tabgauge.functions.ordered import grouped_quantiles, running_before, tie_ranks


def method_ranks(table: DataFrame, value: str = "value", group: Sequence[str] = ("task_id",)) -> DataFrame:
    """Rank the methods of each task, best first, average ranks for ties."""
    return tie_ranks(table, list(group), value, "rank", descending=True, bounded=True)


def average_ranks(table: DataFrame, value: str = "value") -> DataFrame:
    return method_ranks(table, value).groupBy("method").agg(F.avg("rank").alias("avg_rank"), F.count("rank").alias("n_tasks"))


def collection_ranks(table: DataFrame, suites: DataFrame, value: str = "value") -> DataFrame:
    """``(suite, metric, method, avg_rank, n_tasks)`` from ``(metric, task_id, method, value)``.

    A rank depends only on the task, so ranks are made once and then joined to the suites
    a task belongs to. The row ``all_datasets`` covers every task.
    """
    ranked = method_ranks(table, value, ("metric", "task_id")).select("metric", "task_id", "method", "rank")
    # the suites of a task are a short list, so each ranked row is read once and repeated per suite
    of_task = suites.groupBy("task_id").agg(F.collect_set("suite").alias("suites"))
    every = F.concat(F.array(F.lit("all_datasets")), F.coalesce("suites", F.array().cast("array<string>")))
    labelled = ranked.join(of_task, "task_id", "left").withColumn("suite", F.explode(every))
    return labelled.groupBy("suite", "metric", "method").agg(F.avg("rank").alias("avg_rank"), F.count("rank").alias("n_tasks"))


def missing_collection_tasks(table: DataFrame, suites: DataFrame) -> DataFrame:
    """``(suite, n_tasks, n_missing)`` where a suite has tasks without results."""
    seen = table.filter("value is not null").select("task_id").distinct().withColumn("_seen", F.lit(1))
    joined = suites.select("suite", "task_id").distinct().join(seen, "task_id", "left")
    counted = joined.groupBy("suite").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("_seen").isNull()).alias("n_missing")
    )
    return counted.filter("n_missing > 0")


# ---- trajectories --------------------------------------------------------------------------------


def incumbent_trajectory(
    df: DataFrame, group: Sequence[str], order: Sequence, optimised: str = "valid", shown: str = "test"
) -> DataFrame:
    """Add ``best_so_far`` of ``optimised``; keep ``shown`` where a row equals it, else carry it forward."""
    running = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    best = F.max(optimised).over(running)
    return (
        df.withColumn("best_so_far", best)
        .withColumn("_kept", F.when(F.col(optimised) == F.col("best_so_far"), F.col(shown)))
        .withColumn(shown, F.last("_kept", ignorenulls=True).over(running))
        .drop("_kept")
    )


def shuffled_trajectories(
    df: DataFrame, group: Sequence[str], optimised: str = "valid", shown: str = "test", n_shuffles: int = 15, seed: int = 0
) -> DataFrame:
    """Repeat the search: default config first, the others in digest order, trajectory and step number.

    ``group`` keys plus ``config`` must be distinct.
    """
    group = list(group)
    repeated = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
    repeated = repeated.withColumn("_order", F.when(F.col("config") == 1, "").otherwise(order_key(seed, "rep", "config")))
    keys = [*group, "rep"]
    walked = incumbent_trajectory(repeated, keys, ["_order"], optimised, shown)
    return walked.withColumn("step", F.row_number().over(W.partitionBy(*keys).orderBy("_order"))).drop("_order")


def trajectory_band(walked: DataFrame, by: Sequence[str] = (), shown: str = "test") -> DataFrame:
    """Mean, lowest and highest ``shown`` per step over the repeats."""
    return walked.groupBy(*by, "step").agg(
        F.avg(shown).alias("mean"), F.min(shown).alias("low"), F.max(shown).alias("high")
    )


# ---- rank lines ------------------------------------------------------------------------------------


def _prefix_means(ranks: DataFrame, group: list[str], order: Sequence[str], bounded: bool) -> DataFrame:
    """Mean rank over the tasks that come earlier; ``size`` is their number (0 gives null)."""
    counted = ranks.withColumn("_one", F.lit(1)).withColumn("_has", F.col("rank").isNotNull().cast("int"))
    counted = counted.withColumn("_rank", F.coalesce("rank", F.lit(0.0)))
    placed = running_before(
        counted, group, list(order), {"size": "_one", "_n": "_has", "_sum": "_rank"}, bounded=bounded
    )
    return placed.select(*group, "task_id", "size", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).alias("mean_rank"))


def ranks_random_sets(table: DataFrame, n_rep: int = 50, seed: int = 1, bounded: bool = True) -> DataFrame:
    """``(rep, method, size, mean_rank)``: tasks in ``n_rep`` digest orders, mean rank over growing prefixes.

    Sizes run from 0 (empty, null) to n - 1. Ranks are made once; each repeat is a running sum.
    """
    ranked = method_ranks(table).select("task_id", "method", "rank")
    repeated = ranked.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
    ordered = repeated.withColumn("_order", order_key(seed, "rep", "task_id"))
    return _prefix_means(ordered, ["rep", "method"], ["_order"], bounded).drop("task_id")


def mean_rank_lines(sets: DataFrame) -> DataFrame:
    """Mean over the repeats per method and size."""
    return sets.groupBy("method", "size").agg(F.avg("mean_rank").alias("mean_rank"))


def task_frequency(suites: DataFrame) -> DataFrame:
    """``(task_id, n_suites)``."""
    return suites.groupBy("task_id").agg(F.count_distinct("suite").alias("n_suites"))


def ranks_by_frequency(table: DataFrame, suites: DataFrame, bounded: bool = True) -> DataFrame:
    """As :func:`ranks_random_sets` with one order: most used task first, then by task id."""
    ranked = method_ranks(table).select("task_id", "method", "rank").join(task_frequency(suites), "task_id", "left")
    ordered = ranked.withColumn("_use", -F.coalesce("n_suites", F.lit(0)))
    return _prefix_means(ordered, ["method"], ["_use", "task_id"], bounded)


# ---- orders of collections ---------------------------------------------------------------------------


def median_task_size(suites: DataFrame, sizes: DataFrame, size: str = "n_rows") -> DataFrame:
    """``(suite, median_size)`` of the tasks of a suite."""
    members = suites.select("suite", "task_id").distinct().join(sizes, "task_id")
    return grouped_quantiles(members.select("suite", size), ["suite"], [size], [0.5]).select(
        "suite", F.col("value").alias("median_size")
    )


def order_by_median_size(suites: DataFrame, sizes: DataFrame, size: str = "n_rows") -> DataFrame:
    """``(position, suite)``: ``all_datasets`` first, then by rising median size, then by name."""
    medians = median_task_size(suites, sizes, size).filter("suite <> 'all_datasets'")
    placed = running_before(medians.withColumn("_one", F.lit(1)), [], ["median_size", "suite"], {"_before": "_one"}, bounded=True)
    first = suites.sparkSession.createDataFrame([("all_datasets", 0)], "suite string, position int")
    return placed.select("suite", (F.col("_before") + 1).cast("int").alias("position")).unionByName(first)


def chain_order(similarity: DataFrame, start: str = "all_datasets", most: int = 1_000) -> DataFrame:
    """``(position, suite)`` of a greedy chain: from the last suite to the unused one of least ``mse``, then highest
    ``tau``, then by name.

    ``similarity(suite_a, suite_b, mse, tau)`` has one row per pair of suites. The walk is one fold over the suites'
    sorted neighbours, in one row: more than ``most`` suites are an error, so that row is bounded.
    """
    entry = F.struct("mse", F.coalesce(-F.col("tau"), F.lit(2.0)).alias("far"), F.col("suite_b").alias("suite"))
    near = similarity.filter("suite_a <> suite_b").groupBy("suite_a").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    whole = near.agg(F.map_from_entries(F.collect_list(F.struct("suite_a", "near"))).alias("near")).filter(F.size("near") > 0)
    checked = F.when(F.size("near") > most, F.raise_error(F.lit(f"more than {most} suites"))).otherwise(F.size("near"))

    def step(order, _):
        left = F.filter(F.col("near")[F.element_at(order, -1)], lambda x: ~F.array_contains(order, x["suite"]))
        return F.when(F.size(left) > 0, F.concat(order, F.array(F.get(left, F.lit(0))["suite"]))).otherwise(order)

    order = F.aggregate(F.sequence(F.lit(1), checked), F.array(F.lit(start)), step)
    return whole.select(F.posexplode(order).alias("position", "suite"))


def complete_collections(rank_rows: DataFrame, rank: str = "avg_rank") -> DataFrame:
    """Rank rows of the (suite, metric) pairs in which every method that occurs in the metric has a rank."""
    methods = rank_rows.groupBy("metric").agg(F.count_distinct("method").alias("_methods"))
    ranked = rank_rows.filter(F.col(rank).isNotNull()).groupBy("suite", "metric").agg(F.count_distinct("method").alias("_ranked"))
    whole = ranked.join(methods, "metric").filter("_ranked = _methods").select("suite", "metric")
    return rank_rows.join(whole, ["suite", "metric"])


def parallel_coordinates(rank_rows: DataFrame, orders: dict[str, DataFrame]) -> DataFrame:
    """Long rows ``(order_name, position, suite, metric, method, avg_rank)`` for each ``(position, suite)`` order.

    Collections with a method without a rank are left out, and positions close up.
    """
    whole = complete_collections(rank_rows)
    named = reduce(DataFrame.unionByName, [o.select(F.lit(name).alias("order_name"), "position", "suite") for name, o in orders.items()])
    there = named.join(whole.select("metric", "suite").distinct(), "suite")
    line = W.partitionBy("order_name", "metric").orderBy("position")  # bounded: the suites
    placed = there.withColumn("position", (F.row_number().over(line) - 1).cast("int"))
    return placed.join(whole, ["metric", "suite"]).select("order_name", "position", "suite", "metric", "method", "avg_rank")
