"""Result tables: slicing, incumbents, metric tables, missing results.

Everything reads the long fact table ``(method, fold, split, config, task_id, metric,
value)``. It is sparse, can be partitioned on disk by method and task, and becomes wide
only at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = ("method", "fold", "split", "config")
_EMPTY_IS_ALL = ("dataset", "dataset_id", "dataset_name", "metric")


def stack_measures(wide: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One column per metric to long rows; null cells are left out."""
    typed = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(list(keys), list(measures), "metric", "value").filter("value is not null")


def wide_measures(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long rows to one column per named metric (conditional aggregates, no pivot job)."""
    picked = results.filter(F.col("metric").isin(list(metrics)))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def _as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def at(results: DataFrame, task_dim: DataFrame | None = None, check_empty: bool = False, **wanted) -> DataFrame:
    """Slice by ``method, fold, split, config, dataset, dataset_id, dataset_name, metric``.

    A list keeps its column, a single value removes it. None means no filter; so does an
    empty list for a dataset or metric. ``dataset_id`` and ``dataset_name`` go through
    ``task_dim(task_id, dataset_id, dataset_name)``. The filters reach the file scan.
    ``check_empty=True`` runs a one-row probe and raises if nothing is left.
    """
    df, drop = results, []
    columns = {"dataset": "task_id"}
    for name, value in wanted.items():
        if value is None or (name in _EMPTY_IS_ALL and isinstance(value, (list, tuple, set)) and not value):
            continue
        if name in ("dataset_id", "dataset_name"):
            if task_dim is None:
                raise ValueError(f"{name} needs a task_dim table")
            tasks = task_dim.filter(F.col(name).isin(_as_list(value))).select("task_id")
            df = df.join(tasks, "task_id", "left_semi")
            column = "task_id"
        else:
            column = columns.get(name, name)
            df = df.filter(F.col(column).isin(_as_list(value)))
        if not isinstance(value, (list, tuple, set)):
            drop.append(column)
    if check_empty and df.isEmpty():
        raise LookupError("no results found")
    return df.drop(*drop)


def add_method(results: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if results is None else results.unionByName(more, allowMissingColumns=True)


def drop_methods(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    return results.filter(~F.col("method").isin(list(methods)))


def stack_methods(per_method: Sequence[DataFrame], tasks: Sequence[int] | None = None) -> DataFrame:
    """Stack several methods' results, then keep some tasks."""
    stacked = None
    for more in per_method:
        stacked = add_method(stacked, more)
    return stacked if tasks is None else stacked.filter(F.col("task_id").isin(list(tasks)))


def levels(results: DataFrame, column: str) -> DataFrame:
    """Distinct values of one level."""
    return results.select(column).distinct()


def with_dataset(results: DataFrame, task_dim: DataFrame) -> DataFrame:
    """Attach dataset id and name to each task."""
    return results.join(task_dim, "task_id", "left")


# ---- incumbents -------------------------------------------------------------------------------


def config_means(results: DataFrame, keys: Sequence[str] = ("method", "fold", "config", "task_id")) -> DataFrame:
    """Mean over splits of every metric."""
    return results.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


#: means are compared to this many places, so that a tie does not hang on the order of a sum
TIE_PLACES = 12


def _best_first(value: Column, config: Column) -> Column:
    """Orders by value, then by lower config id: the maximum is the incumbent."""
    return F.struct(F.round(value, TIE_PLACES).alias("best"), (-config).alias("neg_config"))


def incumbent_results(results: DataFrame, metric: str) -> DataFrame:
    """All metrics of the config that is best on ``metric`` per (method, fold, task), as long rows.

    Aggregates only: split means, then one map of metric means per config (bounded by the
    number of metrics), then ``max_by`` over configs. No join back and no sort.
    """
    group = ["method", "fold", "task_id"]
    per_config = (
        config_means(results)
        .groupBy(*group, "config")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("values"))
        .withColumn("_score", F.try_element_at("values", F.lit(metric)))
        .filter("_score is not null")
    )
    best = _best_first(F.col("_score"), F.col("config"))
    chosen = per_config.groupBy(*group).agg(F.max_by(F.struct("config", "values"), best).alias("c"))
    return chosen.select("*", "c.config", F.explode("c.values").alias("metric", "value")).drop("c")


def incumbent_configs(results: DataFrame, metric: str) -> DataFrame:
    """``(method, fold, task_id, config)`` of the incumbents."""
    means = config_means(results.filter(F.col("metric") == metric))
    best = F.max(_best_first(F.col("value"), F.col("config"))).alias("b")
    return means.groupBy("method", "fold", "task_id").agg(best).select(
        "method", "fold", "task_id", (-F.col("b.neg_config")).cast("int").alias("config")
    )


def incumbent_ids_wide(configs: DataFrame, folds: Sequence[int]) -> DataFrame:
    """One row per (method, task) with a ``fold_i`` column each."""
    return configs.groupBy("method", "task_id").agg(
        *[F.max(F.when(F.col("fold") == f, F.col("config"))).alias(f"fold_{f}") for f in folds]
    )


def lookup_incumbent(wide: DataFrame, method: str, task_id: int, fold: int) -> int:
    """Config id of one task and fold; an error unless there is exactly one row."""
    rows = wide.filter((F.col("method") == method) & (F.col("task_id") == task_id)).select(f"fold_{fold}").take(2)
    if len(rows) != 1 or rows[0][0] is None:
        raise LookupError(f"expected one incumbent for {method}, task {task_id}, fold {fold}; found {len(rows)}")
    return rows[0][0]


def incumbent_metric(results: DataFrame, metric: str, data_split: str = "test", methods: Sequence[str] | None = None) -> DataFrame:
    """``(task_id, method, value)``: choose on ``valid_<metric>``, report the fold mean of ``<data_split>_<metric>``.

    Three stacked aggregates over two metrics; each keeps fewer rows than the last.
    """
    chosen, shown = f"valid_{metric}", f"{data_split}_{metric}"
    picked = results.filter(F.col("metric").isin(chosen, shown))
    if methods is not None:
        picked = picked.filter(F.col("method").isin(list(methods)))
    means = picked.groupBy("method", "fold", "task_id", "config").agg(
        F.avg(F.when(F.col("metric") == chosen, F.col("value"))).alias("chosen"),
        F.avg(F.when(F.col("metric") == shown, F.col("value"))).alias("shown"),
    )
    per_fold = (
        means.filter("chosen is not null")
        .groupBy("method", "fold", "task_id")
        .agg(F.max_by("shown", _best_first(F.col("chosen"), F.col("config"))).alias("shown"))
    )
    return per_fold.groupBy("task_id", "method").agg(F.avg("shown").alias("value"))


def metric_means(results: DataFrame, metric: str) -> DataFrame:
    """``(task_id, method, value)``: mean over folds (and whatever else there is) of one metric."""
    return results.filter(F.col("metric") == metric).groupBy("task_id", "method").agg(F.avg("value").alias("value"))


def default_results(results: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Split means of the default configuration (config 1)."""
    picked = results.filter(F.col("config") == 1)
    if metrics is not None:
        picked = picked.filter(F.col("metric").isin(list(metrics)))
    return picked.groupBy("method", "fold", "task_id", "metric").agg(F.avg("value").alias("value"))


def as_table(long: DataFrame, methods: Sequence[str], row: str = "task_id") -> DataFrame:
    """Rows tasks, columns methods; the method list is given, so no extra job looks for it."""
    return long.groupBy(row).pivot("method", list(methods)).agg(F.first("value"))


# ---- missing results ------------------------------------------------------------------------------


def level_values(results: DataFrame, columns: Sequence[str], limit: int = 100_000) -> dict[str, list]:
    """Distinct values of the level columns on the driver, from one pass; an error beyond ``limit`` in all."""
    types = {f.name: f.dataType for f in results.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("text")) for c in columns])
    distinct = results.select(F.inline(cells)).filter("text is not null").distinct()
    typed = distinct.select("level", *[F.when(F.col("level") == c, F.col("text")).cast(types[c]).alias(c) for c in columns])
    rows = typed.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} level values")
    return {c: sorted(r[c] for r in rows if r["level"] == c) for c in columns}


def dense_grid(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the occurring levels, with ``value`` null where nothing was recorded.

    Level lists are small dimensions. The longest one is spread over the tasks and the
    others are exploded next to it, so the grid grows in parallel.
    """
    spark, columns = results.sparkSession, list(columns)
    found = level_values(results, columns)
    longest = max(columns, key=lambda c: len(found[c]))
    types = {f.name: f.dataType for f in results.schema.fields}
    base = spark.createDataFrame([(v,) for v in found[longest]], f"{longest} {types[longest].simpleString()}")
    grid = base.repartition(longest)
    for c in columns:
        if c != longest:
            grid = grid.withColumn(c, F.explode(F.array(*[F.lit(v) for v in found[c]]).cast(f"array<{types[c].simpleString()}>")))
    return grid.join(results.select(*columns, "value"), columns, "left").select(*columns, "value")


def tasks_without_missing(dense: DataFrame, keys: Sequence[str] = ("method", "fold")) -> DataFrame:
    """Tasks with a value in every row of the (dense) table once metrics are averaged."""
    per_row = dense.groupBy("task_id", *keys).agg(F.count("value").alias("n"))
    return per_row.groupBy("task_id").agg(F.min("n").alias("fewest")).filter("fewest > 0").select("task_id")


def drop_empty_tasks(dense: DataFrame, metric: str) -> DataFrame:
    """Keep tasks with at least one value of ``metric``."""
    present = dense.filter((F.col("metric") == metric) & F.col("value").isNotNull()).select("task_id").distinct()
    return dense.join(present, "task_id", "left_semi")


def handle_missing(dense: DataFrame, metric: str, handler: str = "fill_nan", row_keys: Sequence[str] = ("method", "fold")) -> DataFrame:
    """Drop tasks missing everywhere on ``metric``; then fill 0, or drop rows with any missing cell."""
    kept = drop_empty_tasks(dense, metric)
    if handler == "fill_nan":
        return kept.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if handler == "drop_nan":
        broken = kept.filter("value is null").select(*row_keys).distinct()
        return kept.join(broken, list(row_keys), "left_anti")
    raise ValueError("handler is fill_nan or drop_nan")


def drop_all_missing_rows(wide: DataFrame, measures: Sequence[str]) -> DataFrame:
    return wide.na.drop("all", subset=list(measures))


def drop_any_missing_rows(wide: DataFrame, measures: Sequence[str]) -> DataFrame:
    return wide.na.drop("any", subset=list(measures))


def failed_task_list(table: DataFrame, methods: Sequence[str], suites: DataFrame) -> DataFrame:
    """``(suite, method, task_id)`` of every task of a suite without a value for a method, from ``(task_id, method, value)``."""
    members = suites.select("suite", "task_id").distinct()
    every = members.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    seen = table.filter("value is not null").select("task_id", "method").distinct()
    return every.join(seen, ["task_id", "method"], "left_anti").select("suite", "method", "task_id")


def failed_tasks(table: DataFrame, methods: Sequence[str], suites: DataFrame) -> DataFrame:
    """``(suite, method, n_datasets, n_failed)`` from ``(task_id, method, value)`` means.

    A suite's task with no value for a method counts as failed.
    """
    members = suites.select("suite", "task_id").distinct()
    every = members.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    seen = table.filter("value is not null").select("task_id", "method").distinct().withColumn("_ok", F.lit(1))
    return (
        every.join(seen, ["task_id", "method"], "left")
        .groupBy("suite", "method")
        .agg(F.count(F.lit(1)).alias("n_datasets"), F.count_if(F.col("_ok").isNull()).alias("n_failed"))
    )
