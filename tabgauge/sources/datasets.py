"""Load feature tables and bibliography tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabgauge.operators.encode import encode_target
from tabgauge.operators.profile import infer_roles
from tabgauge.schema import Dataset, without_nan

Reader = Callable[..., DataFrame]
LOADERS: dict[str, Reader] = {}


def loader(name: str):
    """Register a reader ``(spark, path, **options) -> DataFrame`` under a name."""

    def add(fn: Reader) -> Reader:
        LOADERS[name] = fn
        return fn

    return add


@loader("parquet")
def _parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


@loader("orc")
def _orc(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).orc(path)


@loader("csv")
def _csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.options(**{"header": True, **options})
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_dataset(
    spark: SparkSession,
    path: str,
    key: str,
    target: str,
    format: str = "parquet",
    indicator: Mapping[str, bool] | None = None,
    known_categorical: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    **options,
) -> Dataset:
    """Read a table, set NaN to null, infer roles, label-encode the target into ``y``."""
    if format not in LOADERS:
        raise ValueError(f"unknown loader: {format}")
    raw = LOADERS[format](spark, path, **options)
    if columns is not None:
        raw = raw.select(key, target, *columns)
    return as_dataset(raw, key, target, indicator, known_categorical)


def as_dataset(
    raw: DataFrame, key: str, target: str, indicator: Mapping[str, bool] | None = None, known_categorical: Sequence[str] = ()
) -> Dataset:
    """A :class:`Dataset` from any DataFrame with a row key and a target."""
    df = without_nan(raw)
    roles = infer_roles(df, key, target, indicator, known_categorical)
    encoded = encode_target(df, target, "_y").drop(target).withColumnRenamed("_y", target)
    return Dataset(encoded.select(key, *roles.features, target), roles)


def read_headerless_csv(
    spark: SparkSession, path: str, names: Sequence[str], types: Mapping[str, str] | None = None, fill: float = 0, rows: int | None = None
) -> DataFrame:
    """CSV without header under the given names; numbers missing in it become ``fill``; ``rows`` caps the read."""
    types = types or {}
    schema = ", ".join(f"`{n}` {types.get(n, 'double')}" for n in names)
    df = without_nan(spark.read.schema(schema).option("header", False).csv(path)).na.fill(fill)
    return df if rows is None else df.limit(rows)


def read_bibliography(spark: SparkSession, path: str, id_columns: Sequence[str]) -> DataFrame:
    """CSV with header; id columns become nullable longs (``12.0`` counts as 12), other columns stay text."""
    raw = spark.read.option("header", True).csv(path)
    tidy = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    return tidy.withColumns({c: nullable_id(F.col(c)) for c in id_columns})


def nullable_id(value):
    """Text to a nullable long; what is not a number becomes null."""
    return value.try_cast("double").cast("bigint")
