"""Trials: the grid of runs, what is left to run, running them, and folding their records.

Each trial is a handful of distributed MLlib jobs. A small driver-side thread pool keeps
several of them in flight, as Spark's own cross-validator does; the rows stay in Spark.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabgauge.operators import models
from tabgauge.operators.scoring import get_scorer, score_table
from tabgauge.operators.split import split_parts, stratified_holdout
from tabgauge.schema import RUN_CONFIG, STATUS_FAILED, STATUS_SUCCESS, TRIAL_INFO, Dataset
from tabgauge.session import ensure_checkpoint_dir

TRIAL_KEYS = ["method", "task_id", "fold", "split", "config"]
_TIMES = [f.name for f in TRIAL_INFO.fields if f.name.startswith("average_")]
_LOSSES = ["train_loss", "valid_loss", "test_loss"]
PARTS = ("train", "valid", "test")

RECORD = T.StructType(
    [
        T.StructField("run_config", RUN_CONFIG),
        T.StructField("loss", T.DoubleType()),
        T.StructField("info", TRIAL_INFO),
        T.StructField("categorical_columns", T.ArrayType(T.StringType())),
    ]
)


# ---- which trials -------------------------------------------------------------------------------------


def trial_grid(tasks: DataFrame, methods: Sequence[str], folds: Sequence[int], splits: Sequence[int], n_configs: int) -> DataFrame:
    """Every method, task, fold, split and config: the parameter lists are exploded next to the task table."""
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    return (
        tasks.select("task_id")
        .withColumn("method", F.explode(literal(methods)))
        .withColumn("fold", F.explode(literal(folds)))
        .withColumn("split", F.explode(literal(splits)))
        .withColumn("config", F.explode(F.sequence(F.lit(1), F.lit(n_configs))))
        .select(*TRIAL_KEYS)
    )


def pending_trials(grid: DataFrame, log: DataFrame, overwrite: bool = False, cat_overwrite: bool = False) -> DataFrame:
    """Trials still to run, given ``log(keys..., status, n_categorical)`` of existing result files.

    Success without categoricals: done. Success with categoricals: done unless
    ``cat_overwrite``. Failure: done. ``overwrite`` reruns everything.
    """
    if overwrite:
        return grid
    rerun = (F.col("status") == STATUS_SUCCESS) & (F.col("n_categorical") > 0) if cat_overwrite else F.lit(False)
    return grid.join(log.filter(~rerun).select(*TRIAL_KEYS), TRIAL_KEYS, "left_anti")


# ---- folding records --------------------------------------------------------------------------------------


def mean_over_splits(trials: DataFrame, keys: Sequence[str] = ("method", "task_id", "fold", "config")) -> DataFrame:
    """One row per trial over its splits: mean losses, times and metrics, summed walltime, first config, split count.

    Metric maps become (part, metric) rows for the mean and are rebuilt after it; a metric
    missing in a split still divides by the number of splits.
    """
    keys = list(keys)
    scalars = trials.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in [*_LOSSES, *_TIMES]],
        F.sum("total_walltime").alias("total_walltime"),
        F.min_by("config_values", "split").alias("config_values"),
        F.count(F.lit(1)).cast("int").alias("n_splits"),
        *[F.count(f"{p}_metrics").alias(f"_has_{p}") for p in PARTS],
    )
    def entries(part: str):
        present = F.coalesce(F.map_entries(f"{part}_metrics"), F.array().cast("array<struct<key:string,value:double>>"))
        return F.transform(present, lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("metric"), e["value"].alias("value")))

    cells = F.concat(*[entries(p) for p in PARTS])
    sums = (
        trials.select(*keys, F.explode(cells).alias("c"))
        .groupBy(*keys, "c.part", "c.metric")
        .agg(F.sum("c.value").alias("total"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("part", "metric", "total")).alias("_cells"))  # parts x metrics entries
    )
    joined = scalars.join(sums, keys, "left")

    def rebuilt(part: str):
        mine = F.filter("_cells", lambda c: c["part"] == part)
        entries = F.transform(mine, lambda c: F.struct(c["metric"].alias("key"), (c["total"] / F.col("n_splits")).alias("value")))
        return F.when(F.col(f"_has_{part}") > 0, F.map_from_entries(F.array_sort(entries)))

    return joined.withColumns({f"{p}_metrics": rebuilt(p) for p in PARTS}).drop("_cells", *[f"_has_{p}" for p in PARTS])


def all_failed(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., all_failed)``: whether every trial of a group ended in an error."""
    return trials.groupBy(*by).agg(F.every(F.col("error").isNotNull()).alias("all_failed"))


def best_trials(trials: DataFrame, by: Sequence[str], cost: str = "cost", trial_id: str = "config") -> DataFrame:
    """The cheapest trial per group; equal costs go to the lower id. One aggregate, no sort."""
    ranked = trials.filter(F.col(cost).isNotNull())
    return ranked.groupBy(*by).agg(F.min(F.struct(cost, trial_id)).alias("b")).select(*by, f"b.{trial_id}", f"b.{cost}")


# ---- running --------------------------------------------------------------------------------------------------


def _watched(table: DataFrame, key: str, early_stop: str, seed: int) -> DataFrame:
    """Rows to fit on, with a flag on those that only tell boosting when to stop."""
    if early_stop == "validation":
        return table.filter("part in ('train', 'valid')").withColumn("watched", F.col("part") == "valid")
    if early_stop != "training":
        raise ValueError("early_stop is validation or training")
    train = table.filter("part = 'train'")
    parts = stratified_holdout(train, key, "label", seed=seed).withColumnRenamed("row_key", key)
    return train.join(parts.select(key, (F.col("part") == "valid").alias("watched")), key)


def run_trial(
    dataset: Dataset,
    parts: DataFrame,
    method: str,
    config: Mapping[str, Any],
    encoders,
    metric: str = "roc_auc",
    metrics: Sequence[str] = ("accuracy", "roc_auc", "log_loss"),
    task_id: int = 0,
    fold: int = 0,
    split: int = 0,
    config_id: int = 1,
    seed: int = 0,
    balanced: bool = False,
    early_stop: str | None = None,
    keep_predictions: bool = False,
    raise_errors: bool = False,
) -> tuple[tuple, DataFrame | None]:
    """Encode, fit and score one trial; returns its record (a ``RECORD`` tuple) and the predictions.

    Encoders see training rows only. One grouped job scores all parts at once. In a grid any
    error ends as a failed record with its text, so one bad trial does not stop the others.
    With ``raise_errors`` it is raised: a failed record has no scores, so a caller that reads
    only these would take the failure for an empty result.

    ``early_stop``: ``validation`` lets boosting watch the validation part, ``training`` a
    stratified fifth of the training part. It applies to boosting; the other
    estimators have no such stop and train on the training part alone.
    """
    began = time.time()
    key, target = dataset.roles.key, dataset.roles.target
    run_config = (method, task_id, fold, split, config_id, list(metrics))
    text_config = {k: str(v) for k, v in config.items()}
    held: list[DataFrame] = []
    try:
        # encoders, fit and scoring all read these rows; a lost block is computed again
        rows = dataset.df.join(parts.withColumnRenamed("row_key", key), key).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(rows)
        train = rows.filter("part = 'train'")
        fitted_encoders = encoders.fit(train)
        encoded = fitted_encoders.transform(rows)
        features = [c for c in encoded.columns if c not in (key, target, "part")]
        facts = encoded.filter("part = 'train'").agg(
            F.count(F.lit(1)).alias("n_rows"), (F.max(target) + 1).cast("int").alias("n_classes")
        ).first()
        table = models.assemble(encoded, features).select(key, F.col(target).cast("double").alias("label"), "part", "features")
        if balanced:
            table = table.join(models.balanced_weights(table.filter("part = 'train'"), "label").select("label", "weight").distinct(), "label", "left")
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(table)
        fit_rows, watch = table.filter("part = 'train'"), None
        if early_stop and method in models.BOOSTED:
            fit_rows, watch = _watched(table, key, early_stop, seed), "watched"
        prepared = time.time()
        estimator = models.build(
            method,
            config,
            {
                "n_rows": facts["n_rows"],
                "n_features": models.vector_size(table, "features"),
                "n_classes": max(2, facts["n_classes"]),
                "seed": models.model_seed(seed, method, task_id, fold, split, config_id),
                "weight": "weight" if balanced else None,
                "valid": watch,
            },
        )
        fitted = estimator.fit(fit_rows)
        trained = time.time()
        predictions = models.predict_proba(fitted, table, max(2, facts["n_classes"])).select(
            F.col(key).alias("row_key"), "part", F.col("label").cast("int").alias("y"), "probs"
        )
        wanted = list(dict.fromkeys([*metrics, metric]))
        scored = score_table(predictions, ["part"], metrics=wanted).collect()  # parts x metrics rows
        ended = time.time()
        values: dict[str, dict[str, float]] = {p: {} for p in PARTS}
        for r in scored:
            values[r["part"]][r["metric"]] = r["score"]
        optimum = get_scorer(metric).optimum
        losses = [optimum - values[p][metric] if metric in values[p] else None for p in PARTS]
        info = (
            STATUS_SUCCESS, *losses, trained - prepared, ended - trained, None, None, prepared - began, None, None,
            ended - began, text_config, 1, *[values[p] or None for p in PARTS], {},
        )
        loss = losses[1] if losses[1] is not None else losses[0]
        record = (run_config, loss, info, list(dataset.roles.categorical))
        if keep_predictions:
            ensure_checkpoint_dir(predictions.sparkSession)
            return record, predictions.checkpoint()
        return record, None
    except Exception as error:  # noqa: BLE001 - a failed trial of a grid is a record
        if raise_errors:
            raise
        info = (
            STATUS_FAILED, None, None, None, None, None, None, None, None, None, None,
            time.time() - began, text_config, 1, None, None, None, {"error": f"{type(error).__name__}: {error}"[:2000]},
        )
        return (run_config, None, info, list(dataset.roles.categorical)), None
    finally:
        for block in held:
            block.unpersist()


def records_frame(spark: SparkSession, records: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(records), RECORD)


def run_trials(spark: SparkSession, calls: Sequence[Mapping[str, Any]], parallelism: int = 4) -> DataFrame:
    """Run several trials, a few at a time, and return their records as a table."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        outcomes = list(pool.map(lambda call: run_trial(**call)[0], calls))
    return records_frame(spark, outcomes)


def run_over_splits(
    spark: SparkSession, dataset: Dataset, splits: DataFrame, fold: int, n_splits: int, parallelism: int = 4, **options
) -> tuple[DataFrame, DataFrame]:
    """Run one configuration on every split of a fold; returns the records and their mean over the splits."""
    calls = [{"dataset": dataset, "parts": split_parts(splits, fold, s), "fold": fold, "split": s, **options} for s in range(n_splits)]
    records = run_trials(spark, calls, parallelism)
    return records, mean_over_splits(trial_rows(records))


def trial_rows(records: DataFrame) -> DataFrame:
    """Records as flat rows with the trial keys, the input of :func:`mean_over_splits`."""
    infos = [f.name for f in TRIAL_INFO.fields if f.name not in ("config", "n_splits")]
    run = F.col("run_config")
    return records.select(
        run["model_name"].alias("method"), run["task_id"].alias("task_id"), run["fold_number"].alias("fold"),
        run["split_id"].alias("split"), run["config_id"].alias("config"), F.col("loss").alias("cost"),
        F.col("info.config").alias("config_values"), F.try_element_at("info.additional_info", F.lit("error")).alias("error"),
        *[F.col(f"info.{n}").alias(n) for n in infos],
    )


def refit(dataset: Dataset, parts: DataFrame, method: str, configs: DataFrame, config_id: int = 1, **options) -> tuple[tuple, DataFrame | None]:
    """Train on a fold's whole training part with one configuration and score its test part.

    ``configs(config_id, values)`` must hold the id exactly once.
    """
    rows = configs.filter(F.col("config_id") == config_id).take(2)
    if len(rows) != 1:
        raise LookupError(f"config {config_id} occurs {len(rows)} times")
    return run_trial(dataset, parts, method, rows[0]["values"], config_id=config_id, **options)
