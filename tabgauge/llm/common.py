"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabgauge.session import ensure_checkpoint_dir

#: what parts words for most operators: ASCII white space
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. The plain function is exact, and faster, where all is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Words between ASCII white space; no words for null or blank text.

    Every kind of white space becomes a blank first, so that the split is by one plain character.
    """
    t = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a barrier for the optimizer.

    A filter on a computed column is otherwise pushed below it with the whole expression in its place, again inside
    every function over elements that uses it; columns that build on each other would be worked out once per element.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def written(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: a cut of the lineage that outlives executors."""
    path = shared_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
