"""Result files of trials: read a whole tree in one scan, flatten to the fact table, write records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabgauge.functions.scalars import keyword_map, model_alias
from tabgauge.operators.trials import PARTS
from tabgauge.operators.walltime import ERRORED_TRIAL_TIME
from tabgauge.schema import RESULT_KEYS, RUN_CONFIG, TRIAL_INFO

# the stored pair [loss, info] is an array of mixed types, read as text and parsed apart
FILE_SCHEMA = T.StructType(
    [
        T.StructField("run_config", RUN_CONFIG),
        T.StructField("result", T.ArrayType(T.StringType())),
        T.StructField(
            "additional_info",
            T.StructType(
                [T.StructField("dataset_properties", T.StructType([T.StructField("categorical_columns", T.ArrayType(T.StringType()))]))]
            ),
        ),
    ]
)

# fixed values: the layout <method>/task_<id>/fold_<i>/split_<j>/config_<k>/result.json
#: files of records: one that a trial wrote, or a part that Spark wrote
RECORD_FILES = "{result,part-*}.json"
PATH_PATTERN = r"([^/]+)/task_(\d+)/fold_(\d+)/split_(\d+)/config_(\d+)/[^/]*$"
TIME_METRICS = ("average_split_fit_time", "average_split_predict_time", "total_walltime")


def path_keys(path: Column) -> list[Column]:
    """Method, task, fold, split and config from a file path."""
    part = lambda i: F.regexp_extract(path, PATH_PATTERN, i)
    return [
        part(1).alias("method"),
        F.nullif(part(3), F.lit("")).cast("int").alias("fold"),
        F.nullif(part(4), F.lit("")).cast("int").alias("split"),
        F.nullif(part(5), F.lit("")).cast("int").alias("config"),
        F.nullif(part(2), F.lit("")).cast("bigint").alias("task_id"),
    ]


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.select(
        "run_config",
        F.col("result")[0].try_cast("double").alias("loss"),
        F.from_json(F.col("result")[1], TRIAL_INFO).alias("info"),
        F.col("additional_info.dataset_properties.categorical_columns").alias("categorical_columns"),
        *path_keys(F.col("_metadata.file_path")),
    )


def read_run_records(
    spark: SparkSession, root: str, max_folds: int | None = None, max_splits: int | None = None, file_name: str = RECORD_FILES
) -> DataFrame:
    """Every result file under ``root`` with the keys of its path; unfinished or torn files give no row.

    Fold and split limits are filters on the path, so skipped files are not parsed.
    """
    raw = (
        spark.read.schema(FILE_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .json(root)
    )
    records = limit_folds(_parsed(raw), max_folds, max_splits)
    return records.filter(F.col("run_config").isNotNull() & F.col("info").isNotNull())


def limit_folds(df: DataFrame, max_folds: int | None, max_splits: int | None) -> DataFrame:
    if max_folds is not None:
        df = df.filter(F.col("fold") < max_folds)
    return df if max_splits is None else df.filter(F.col("split") < max_splits)


def _safe_number(text: Column) -> Column:
    return text.try_cast("double")


def flatten_records(records: DataFrame) -> DataFrame:
    """Records to fact rows: three parts of each metric, the times, and model size facts where given.

    A trial that ended in an error gets the marker time. Only metrics the run asked for are
    kept. Missing values give no row.
    """
    keys = [
        F.col("run_config.model_name").alias("method"),
        F.col("run_config.fold_number").alias("fold"),
        F.col("run_config.split_id").alias("split"),
        F.col("run_config.config_id").alias("config"),
        F.col("run_config.task_id").alias("task_id"),
    ]
    entry = lambda name, value: F.struct(name.alias("metric"), value.cast("double").alias("value"))
    asked = F.coalesce("run_config.additional_metrics", F.array().cast("array<string>"))

    def part_cells(part: str) -> Column:
        metrics = F.col(f"info.{part}_metrics")
        return F.transform(asked, lambda m: entry(F.concat(F.lit(f"{part}_"), m), F.try_element_at(metrics, m)))

    extra = F.col("info.additional_info")
    fact = lambda name: _safe_number(F.try_element_at(extra, F.lit(name)))
    errored = F.try_element_at(extra, F.lit("error")).isNotNull()
    times = [entry(F.lit(t), F.when(errored, F.lit(ERRORED_TRIAL_TIME)).otherwise(F.col(f"info.{t}"))) for t in TIME_METRICS]
    facts = [
        entry(F.lit("num_params"), fact("num_params")),
        entry(F.lit("best_iteration"), F.coalesce(fact("best_iteration"), fact("best_iter"))),
    ]
    cells = F.concat(*[part_cells(p) for p in PARTS], F.array(*times, *facts))
    return records.select(*keys, F.explode(cells).alias("c")).select("*", "c.metric", "c.value").drop("c").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def not_yet_loaded(records: DataFrame, known: DataFrame) -> DataFrame:
    """Fact rows or records whose (method, fold, split, config, task) is not in ``known`` yet."""
    seen = known.filter(F.col("value").isNotNull()).select(*RESULT_KEYS).distinct()
    return records.join(seen, RESULT_KEYS, "left_anti")


def trial_log(records: DataFrame) -> DataFrame:
    """What the resume rules need: keys, status, number of categorical columns."""
    return records.select(
        "method", "task_id", "fold", "split", "config", F.col("info.status").alias("status"),
        F.coalesce(F.size("categorical_columns"), F.lit(0)).alias("n_categorical"),
    )


def write_run_records(records: DataFrame, root: str, mode: str = "append") -> None:
    """Records in directories by method, task, fold, split and config, one JSON line each.

    ``result`` keeps the stored pair form. Records of many trials share a writer task, and
    no task opens more than the directories of its own rows.
    """
    keyed = records.select(
        F.col("run_config.model_name").alias("method"),
        F.concat(F.lit("task_"), F.col("run_config.task_id")).alias("task"),
        F.concat(F.lit("fold_"), F.col("run_config.fold_number")).alias("fold"),
        F.concat(F.lit("split_"), F.col("run_config.split_id")).alias("split"),
        F.concat(F.lit("config_"), F.col("run_config.config_id")).alias("config"),
        "run_config",
        F.array(F.col("loss").cast("string"), F.to_json("info")).alias("result"),
        F.struct(F.struct("categorical_columns").alias("dataset_properties")).alias("additional_info"),
    )
    keys = ["method", "task", "fold", "split", "config"]
    keyed.repartition(*keys).write.mode(mode).partitionBy(*keys).json(root)


def read_config_table(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``(model, config_id, values)`` from a JSON map of config id to parameters; keyword texts are resolved."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    return parsed.select(F.explode("m").alias("config_id", "values")).select(
        model_alias(F.lit(model)).alias("model"), F.col("config_id").cast("int").alias("config_id"), keyword_map("values").alias("values")
    )


def experiment_path(root: str, method: str, task_id: int, fold: int, split: int, config: int) -> str:
    return f"{root}/{method}/task_{task_id}/fold_{fold}/split_{split}/config_{config}"


def select_records(records: DataFrame, methods: Sequence[str]) -> DataFrame:
    return records.filter(F.col("run_config.model_name").isin(list(methods)))
