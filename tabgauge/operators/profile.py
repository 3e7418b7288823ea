"""Profile a feature table: roles, class counts, category counts, missing columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from tabgauge.schema import ColumnRoles, Dataset

#: distinct counts per job; each one multiplies the rows that a job shuffles
DISTINCT_BATCH = 100


def infer_roles(
    df: DataFrame,
    key: str,
    target: str,
    indicator: Mapping[str, bool] | None = None,
    known_categorical: Iterable[str] = (),
) -> ColumnRoles:
    """Text and boolean columns are categorical, so are the known ones; ``indicator`` overrides."""
    features = [f for f in df.schema.fields if f.name not in (key, target)]
    if indicator is None:
        known = set(known_categorical)
        indicator = {f.name: isinstance(f.dataType, (T.StringType, T.BooleanType)) or f.name in known for f in features}
    names = [f.name for f in features]
    return ColumnRoles(
        key,
        target,
        tuple(n for n in names if indicator[n]),
        tuple(n for n in names if not indicator[n]),
        tuple(names),
    )


def distinct_counts(df: DataFrame, columns: Iterable[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values per column: one aggregate per batch of columns."""
    columns = list(columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    result: dict[str, int] = {}
    for at in range(0, len(columns), DISTINCT_BATCH):
        batch = columns[at : at + DISTINCT_BATCH]
        row = df.agg(*[count(F.col(c)).alias(c) for c in batch]).first()
        result.update(row.asDict())
    return result


def category_counts(df: DataFrame, roles: ColumnRoles, approximate: bool = False) -> DataFrame:
    """Long table ``(column, n_categories)`` of the categorical columns."""
    columns = list(roles.categorical)
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "column", "n_categories")


def missing_shares(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Long table ``(column, missing_share)``, one scan and no shuffle of rows."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in roles.features])
    return shares.unpivot([], roles.features, "column", "missing_share")


def all_missing_columns(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """``(position, column)`` of the features without any value."""
    present = df.agg(*[F.count(c).alias(c) for c in roles.features]).unpivot([], roles.features, "column", "n")
    order = F.array(*[F.lit(c) for c in roles.features])
    return present.filter("n = 0").select((F.array_position(order, F.col("column")) - 1).cast("int").alias("position"), "column")


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """One row: class count, output shape, and kind of target (binary, multiclass, continuous)."""
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    fraction = F.max((F.col(target) != F.floor(F.col(target))).cast("int")) if numeric else F.lit(0)
    return df.agg(F.count_distinct(target).cast("int").alias("n_classes"), fraction.alias("_f")).select(
        "n_classes",
        F.when(F.col("n_classes") > 2, F.col("n_classes")).otherwise(1).alias("output_shape"),
        F.when(F.col("_f") == 1, "continuous").when(F.col("n_classes") > 2, "multiclass").otherwise("binary").alias("output_type"),
    )


def dataset_properties(dataset: Dataset, approximate: bool = False) -> DataFrame:
    """The whole profile as one row, from a single pass over the table."""
    df, roles = dataset.df, dataset.roles
    count = F.approx_count_distinct if approximate else F.count_distinct
    names = lambda cs: F.array(*[F.lit(c) for c in cs]).cast("array<string>")
    numeric = isinstance(df.schema[roles.target].dataType, T.NumericType)
    fraction = F.max((F.col(roles.target) != F.floor(F.col(roles.target))).cast("int")) if numeric else F.lit(0)
    row = df.agg(
        F.count_distinct(roles.target).cast("int").alias("n_classes"),
        fraction.alias("_fraction"),
        *[count(F.col(c)).cast("int").alias(f"_d_{c}") for c in roles.categorical],
        *[F.count(c).alias(f"_n_{c}") for c in roles.features],
    )
    kind = (
        F.when(F.col("_fraction") == 1, "continuous")
        .when(F.col("n_classes") > 2, "multiclass")
        .otherwise("binary")
    )
    empty = F.array(*[F.when(F.col(f"_n_{c}") == 0, F.lit(i)).otherwise(F.lit(-1)) for i, c in enumerate(roles.features)])
    return row.select(
        kind.alias("output_type"),
        F.lit("tabular_classification").alias("task_type"),
        "n_classes",
        F.when(F.col("n_classes") > 2, F.col("n_classes")).otherwise(1).alias("output_shape"),
        names(roles.features).alias("feature_names"),
        names(roles.categorical).alias("categorical_columns"),
        names(roles.numerical).alias("numerical_columns"),
        F.array(*[F.lit(b) for b in roles.indicator]).cast("array<boolean>").alias("categorical_indicator"),
        F.array(*[F.col(f"_d_{c}") for c in roles.categorical]).cast("array<int>").alias("n_categories_per_cat_col"),
        F.filter(empty, lambda i: i >= 0).alias("all_nan_col_idx"),
    )


def cast_features(df: DataFrame, roles: ColumnRoles, all_missing: Iterable[str] = ()) -> DataFrame:
    """Categoricals to text, features without a value to double, the rest unchanged."""
    empty = set(all_missing)

    def cast(name: str):
        if name in empty and name not in roles.categorical:
            return F.col(name).cast("double")
        return F.col(name).cast("string") if name in roles.categorical else F.col(name)

    return df.select(*[cast(c).alias(c) if c in set(roles.features) else F.col(c) for c in df.columns])


def match_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Give each column the type it has in the training table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name in df.columns])


def safe_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that hold ``" , : { } [ ]`` to their position; return the map too."""
    names = {c: str(i) if re.search(r'[",:{}\[\]]', c) else c for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def densify(df: DataFrame) -> DataFrame:
    """Sparse vector columns to plain arrays."""
    return df.select(
        *[
            vector_to_array(F.col(f.name)).alias(f.name) if isinstance(f.dataType, VectorUDT) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def presence_mask(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Row key and, per feature, 1 where a value is present."""
    return df.select(roles.key, *[F.col(c).isNotNull().cast("int").alias(c) for c in roles.features])
