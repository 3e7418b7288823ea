"""Result CSVs with two header rows, split tables, predictions, logs, and table text."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- results CSV ------------------------------------------------------------------------------------------


#: one cell of a CSV line, quoted or not
_CELL = r'(?:"(?:[^"]|"")*+"|[^,"]*+)'


def _header(spark: SparkSession, path: str) -> tuple[list[list[str]], str]:
    """(the three header rows, where the data are): in files of their own, or the head of the first file."""
    try:
        lines = spark.read.text(f"{path}/header", wholetext=True).first()["value"].splitlines()
        return list(csv.reader(lines)), f"{path}/rows"
    except Exception as error:  # noqa: BLE001 - a results file of another tool
        if "PATH_NOT_FOUND" not in str(error):
            raise
    first = min(spark.read.text(path).inputFiles())
    return list(csv.reader([r["value"] for r in spark.read.text(first).limit(3).collect()])), path


def _plain(cell: Column) -> Column:
    """A CSV cell without its quotes; null if blank."""
    inner = F.when(cell.startswith('"'), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)
    return F.nullif(inner, F.lit(""))


def _quoted(cell: Column) -> Column:
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text.rlike('[",]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def read_results_csv(spark: SparkSession, path: str, metrics: Sequence[str] | None = None, tasks: Sequence[int] | None = None) -> DataFrame:
    """Wide CSV (metric row, task row, index-name row, data) to the long fact table, in one file or any number of parts.

    Two index columns give ``method, fold``; four also ``split, config``. Cells stay in their line until they are rows, so
    the width of the file does not show in the plan; ``metrics`` and ``tasks`` drop the other cells there. Only the header
    is read on the driver. Index cells may be quoted but hold no line breaks.
    """
    (kinds, numbers, names), data = _header(spark, path)
    index = [n for n in names if n]
    n = len(index)
    wanted = [(i, m, int(t)) for i, (m, t) in enumerate(zip(kinds[n:], numbers[n:])) if (metrics is None or m in metrics) and (tasks is None or int(t) in tasks)]
    cells = spark.createDataFrame(wanted, "pos int, metric string, task_id bigint")
    head = ",".join([f"({_CELL})"] * n)
    line = F.col("value")
    keys = [_plain(F.regexp_extract(line, f"^{head}(?:,|$)", i + 1)) for i in range(n)]
    typed = [k.alias(c) if c == "method" else k.try_cast("int").alias(c) for c, k in zip(index, keys)]
    rest = F.regexp_replace(line, f"^{head}(?:,|$)", "")
    rows = spark.read.text(data).select(*typed, F.split(rest, ",").alias("cells")).filter(F.col("fold").isNotNull())  # header lines have no fold
    found = rows.select(*index, F.posexplode("cells").alias("pos", "cell"))
    found = found.select(*index, "pos", F.replace(F.trim("cell"), F.lit('"'), F.lit("")).try_cast("double").alias("value"))
    return found.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(cells, "pos").select(*index, "metric", "task_id", "value")


def write_results_csv(results: DataFrame, path: str, keys: Sequence[str] = ("method", "fold", "split", "config")) -> None:
    """Long fact table to the wide CSV: ``header`` holds the two header rows and the index names, ``rows`` the data in key order.

    A column is a (metric, task); only the header meets the driver. A line is put together from its own cells and the gaps
    between them, so the plan does not grow with the width. Of several values of a cell the largest stays.
    """
    spark = results.sparkSession
    given = results.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ordered = sorted((r["metric"], r["task_id"]) for r in given.select("metric", "task_id").distinct().collect())  # the header
    blank = [""] * (len(keys) - 1)
    head = [["metric", *blank, *(m for m, _ in ordered)], ["task_id", *blank, *(t for _, t in ordered)], [*keys, *[""] * len(ordered)]]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(head)
    spark.createDataFrame([(text.getvalue().rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    places = spark.createDataFrame([(m, t, i) for i, (m, t) in enumerate(ordered)], "metric string, task_id bigint, pos int")
    cells = given.join(places, ["metric", "task_id"]).groupBy(*keys, "pos").agg(F.max("value").alias("value"))
    wide = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))  # at most the header's width
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["pos"]).otherwise(-1)
    filled = F.transform("cells", lambda c, i: F.concat(F.repeat(F.lit(","), c["pos"] - before(i)), c["value"].cast("string")))
    after = F.repeat(F.lit(","), F.lit(len(ordered) - 1) - F.element_at("cells", -1)["pos"])
    line = F.concat(F.concat_ws(",", *[_quoted(F.col(k)) for k in keys]), F.array_join(filled, ""), after)
    wide.orderBy(*keys).select(line.alias("value")).write.mode("overwrite").text(f"{path}/rows")


def load_results(spark: SparkSession, root: str, methods: Sequence[str], file_name: str = "results.csv", tasks: Sequence[int] | None = None) -> DataFrame:
    """Stack the result CSVs of several methods and keep some tasks."""
    stacked = None
    for m in methods:
        one = read_results_csv(spark, f"{root}/{m}/{file_name}", tasks=tasks)
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return stacked


def comparison_table(results: DataFrame, metric: str, tasks: Sequence[int]) -> DataFrame:
    """``method, fold`` rows and one column per task, for one metric and suite."""
    picked = results.filter((F.col("metric") == metric) & F.col("task_id").isin(list(tasks)))
    return picked.groupBy("method", "fold").pivot("task_id", list(tasks)).agg(F.first("value"))


def write_table_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


# ---- split tables ---------------------------------------------------------------------------------------------


def write_splits(splits: DataFrame, path: str) -> int:
    """Append ``(task_id, row_key, fold, split)`` for tasks not written yet; returns how many tasks were new."""
    spark = splits.sparkSession
    try:
        present = spark.read.parquet(path).select("task_id").distinct()
        fresh = splits.join(present, "task_id", "left_anti")
    except Exception as error:  # noqa: BLE001 - nothing written yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        fresh = splits
    n_new = fresh.select("task_id").distinct().count()
    if n_new:
        fresh.repartition("task_id", F.pmod(F.xxhash64("row_key"), F.lit(64))).write.mode("append").partitionBy("task_id").parquet(path)
    return n_new


def read_splits(spark: SparkSession, path: str, task_id: int, fold: int | None = None) -> DataFrame:
    """Splits of a task: the task prunes directories, the fold reaches the parquet filter."""
    df = spark.read.parquet(path).filter(F.col("task_id") == task_id)
    return df if fold is None else df.filter(F.col("fold") == fold)


def split_key_lists(splits: DataFrame, key_range: int = 100_000) -> DataFrame:
    """``(fold, split, role, piece, keys)``: JSON-ready sorted key lists for every fold and split.

    A list is cut into pieces by ranges of ``key_range`` keys, so that no record grows with the table and the pieces of
    some keys do not depend on how many others there are.
    """
    n_splits = splits.agg(F.sequence(F.lit(0), F.max("split"))).scalar()
    rows = splits.select("row_key", "fold", F.col("split").alias("_own"), F.explode(n_splits).alias("split"))
    role = F.when(F.col("_own").isNull(), "test").when(F.col("_own") == F.col("split"), "valid").otherwise("train")
    piece = F.floor(F.col("row_key") / F.lit(key_range)).cast("bigint")
    return rows.groupBy("fold", "split", role.alias("role"), piece.alias("piece")).agg(F.array_sort(F.collect_list("row_key")).alias("keys"))


# ---- predictions and logs ------------------------------------------------------------------------------------------


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """``(part, row_key, y, probs)`` in one directory per data part."""
    predictions.write.mode(mode).partitionBy("part").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def truth_and_probs(predictions: DataFrame) -> DataFrame:
    """Truth first, then one column entry per class, as a single array per row."""
    return predictions.select("row_key", F.concat(F.array(F.col("y").cast("double")), F.col("probs")).alias("row"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append result records as JSON lines; earlier ones stay."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ---- table text ------------------------------------------------------------------------------------------------------

_FORMATS: Mapping[str, tuple[str, str, str]] = {
    "latex": ("", " & ", " \\\\"),
    "markdown": ("| ", " | ", " |"),
    "html": ("<tr><td>", "</td><td>", "</td></tr>"),
}


def table_text(df: DataFrame, columns: Sequence[str], format: str = "latex") -> DataFrame:
    """One text line per row, column ``line``."""
    begin, between, end = _FORMATS[format]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit(begin), F.concat_ws(between, *cells), F.lit(end)).alias("line"))


def table_head(columns: Sequence[str], format: str = "latex") -> list[str]:
    """The lines above the rows."""
    begin, between, end = _FORMATS[format]
    head = begin + between.join(columns) + end
    if format == "markdown":
        return [head, "|" + "|".join("---" for _ in columns) + "|"]
    return [head, "\\midrule"] if format == "latex" else [head.replace("td>", "th>")]
