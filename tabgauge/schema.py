"""Record shapes shared by sources and operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F, types as T

from tabgauge.functions.scalars import nan_to_null


@dataclass(frozen=True)
class ColumnRoles:
    """Which column is the row key, the target, and how each feature is treated."""

    key: str
    target: str
    categorical: tuple[str, ...] = ()
    numerical: tuple[str, ...] = ()
    order: tuple[str, ...] = field(default=())

    @property
    def features(self) -> list[str]:
        kept = set(self.categorical) | set(self.numerical)
        return [c for c in self.order if c in kept] if self.order else [*self.categorical, *self.numerical]

    @property
    def indicator(self) -> list[bool]:
        return [c in set(self.categorical) for c in self.features]

    def keep(self, columns) -> ColumnRoles:
        kept = set(columns)
        return replace(
            self,
            categorical=tuple(c for c in self.categorical if c in kept),
            numerical=tuple(c for c in self.numerical if c in kept),
        )

    def drop(self, columns) -> ColumnRoles:
        gone = set(columns)
        return self.keep(c for c in self.features if c not in gone)


@dataclass(frozen=True)
class Dataset:
    """A feature table with its roles and what the cleaning steps reported so far."""

    df: DataFrame
    roles: ColumnRoles
    info: dict = field(default_factory=dict)

    def with_df(self, df: DataFrame, roles: ColumnRoles | None = None, **info) -> Dataset:
        roles = roles or self.roles
        return Dataset(df.select(roles.key, *roles.features, roles.target), roles, {**self.info, **info})


def without_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float column; the gate every source passes."""
    floats = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, floats) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# fixed values: status of a trial
STATUS_SUCCESS, STATUS_FAILED = 1, 2

METRIC_MAP = T.MapType(T.StringType(), T.DoubleType())

TRIAL_INFO = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("valid_loss", T.DoubleType()),
        T.StructField("test_loss", T.DoubleType()),
        T.StructField("average_split_fit_time", T.DoubleType()),
        T.StructField("average_split_predict_time", T.DoubleType()),
        T.StructField("average_split_predict_time_valid", T.DoubleType()),
        T.StructField("average_split_predict_time_test", T.DoubleType()),
        T.StructField("average_split_preprocess_time_train", T.DoubleType()),
        T.StructField("average_split_preprocess_time_valid", T.DoubleType()),
        T.StructField("average_split_preprocess_time_test", T.DoubleType()),
        T.StructField("total_walltime", T.DoubleType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("n_splits", T.IntegerType()),
        T.StructField("train_metrics", METRIC_MAP),
        T.StructField("valid_metrics", METRIC_MAP),
        T.StructField("test_metrics", METRIC_MAP),
        T.StructField("additional_info", T.MapType(T.StringType(), T.StringType())),
    ]
)

RUN_CONFIG = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("task_id", T.LongType()),
        T.StructField("fold_number", T.IntegerType()),
        T.StructField("split_id", T.IntegerType()),
        T.StructField("config_id", T.IntegerType()),
        T.StructField("additional_metrics", T.ArrayType(T.StringType())),
    ]
)

#: the long fact table every result operator reads
RESULT_KEYS = ["method", "fold", "split", "config", "task_id"]
RESULTS = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("split", T.IntegerType()),
        T.StructField("config", T.IntegerType()),
        T.StructField("task_id", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
