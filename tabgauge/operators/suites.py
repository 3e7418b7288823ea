"""Which datasets papers and suites use: counts, consistency checks, co-use, suite statistics.

The bibliography table has one row per (paper, dataset use): ``paper_key, dataset_name,
dataset_id, dataset_mapping, task_type, invalid``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabgauge.functions.ordered import grouped_quantiles
from tabgauge.functions.scalars import quality_column_name
from tabgauge.session import ensure_checkpoint_dir

# fixed values
REGRESSION, CLASSIFICATION, INVALID = "Regression", "Classification", "INVALID"
QUALITIES = (
    "NumberOfNumericFeatures",
    "NumberOfSymbolicFeatures",
    "NumberOfFeatures",
    "NumberOfClasses",
    "NumberOfMissingValues",
    "NumberOfInstances",
    "MajorityClassPercentage",
    "MinorityClassPercentage",
)


# ---- use counts -------------------------------------------------------------------------------------


def _identity() -> Column:
    return F.coalesce("dataset_id", "dataset_mapping")


def ambiguous_uses(uses: DataFrame) -> DataFrame:
    """Valid classification rows with neither or both of dataset id and mapping."""
    plain = (F.col("task_type") != REGRESSION) & ~F.coalesce(F.col("invalid") == INVALID, F.lit(False))
    both = F.col("dataset_id").isNotNull() == F.col("dataset_mapping").isNotNull()
    return uses.filter(plain & both)


def classify_uses(uses: DataFrame, suite_papers: Sequence[str] = (), checked: bool = True) -> DataFrame:
    """Add ``use`` (regression, suite, invalid, dataset) and ``dataset_key``.

    With ``checked`` a row whose identity is unclear fails the job that meets it.
    """
    invalid = F.coalesce(F.col("invalid") == INVALID, F.lit(False))
    use = (
        F.when(F.col("task_type") == REGRESSION, "regression")
        .when(F.col("paper_key").isin(list(suite_papers)), "suite")
        .when(invalid, "invalid")
        .otherwise("dataset")
    )
    unclear = F.col("dataset_id").isNotNull() == F.col("dataset_mapping").isNotNull()
    found = _identity().cast("string")
    if checked:
        found = F.when(unclear, F.raise_error(F.lit("a use needs exactly one of dataset id and mapping"))).otherwise(found)
    key = (
        F.when(F.col("use").isin("regression", "invalid"), F.col("dataset_name"))
        .when(F.col("use") == "suite", F.col("dataset_id").cast("string"))
        .otherwise(found)
    )
    return uses.withColumn("use", use).withColumn("dataset_key", key)


def use_counts(uses: DataFrame, suite_papers: Sequence[str] = (), catalogue: DataFrame | None = None) -> DataFrame:
    """``(dataset_key, count, names, available)`` over the uses that are neither regression nor suite rows.

    Names are counted apart before they are gathered, so a dataset used by everyone sends
    one row per spelling.
    """
    kept = classify_uses(uses, suite_papers).filter(F.col("use").isin("invalid", "dataset"))
    if catalogue is not None:
        names = catalogue.select(F.col("dataset_id").cast("string").alias("dataset_key"), F.col("name").alias("_catalogue"))
        kept = kept.join(names, "dataset_key", "left")
    else:
        kept = kept.withColumn("_catalogue", F.lit(None).cast("string"))
    name = F.when(F.col("use") == "invalid", F.col("dataset_name")).otherwise(F.lower(F.coalesce("dataset_name", "_catalogue")))
    spelled = kept.groupBy("dataset_key", (F.col("use") == "dataset").alias("available"), name.alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return spelled.groupBy("dataset_key", "available").agg(
        F.sum("n").alias("count"), F.array_sort(F.collect_set("name")).alias("names")
    )


def regression_counts(uses: DataFrame) -> DataFrame:
    return uses.filter(F.col("task_type") == REGRESSION).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("count"))


def with_creation_year(counts: DataFrame, ages: DataFrame) -> DataFrame:
    """Attach the creation year by dataset id; unknown years stay null."""
    keyed = ages.select(F.col("dataset_id").cast("string").alias("dataset_key"), F.col("year").cast("bigint").alias("creation"))
    return counts.join(keyed, "dataset_key", "left")


def most_used(counts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most used datasets, ties by key."""
    return counts.orderBy(F.desc("count"), F.asc("dataset_key")).limit(n)


# ---- set checks -------------------------------------------------------------------------------------------


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` does not have."""
    return a.subtract(b.select(*a.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return only_in_first(a, b).unionByName(only_in_first(b, a))


def all_members(suites: DataFrame, column: str = "task_id") -> DataFrame:
    """Union of all suites without duplicates."""
    return suites.select(column).distinct()


def missing_members(suites: DataFrame, known: DataFrame, column: str = "task_id") -> DataFrame:
    """Members that are not in ``known``."""
    return only_in_first(all_members(suites, column), known.select(column))


def unique_tasks(suites: DataFrame, tasks: DataFrame, suite_order: str = "suite") -> DataFrame:
    """One task per dataset: the first in (suite order, task id); with size and kind.

    ``tasks(task_id, dataset_id, n_rows, n_cols, n_symbolic)``. Returns ``task_id,
    dataset_id, n_cells, kind``; sort by ``n_cells`` for the run order.
    """
    joined = suites.join(tasks, "task_id")
    first = F.min_by(F.struct("task_id", "n_rows", "n_cols", "n_symbolic"), F.struct(F.col(suite_order), F.col("task_id")))
    return joined.groupBy("dataset_id").agg(first.alias("t")).select(
        "t.task_id",
        "dataset_id",
        (F.col("t.n_rows") * F.col("t.n_cols")).alias("n_cells"),
        F.when(F.col("t.n_symbolic") > 1, "categorical").otherwise("numeric").alias("kind"),
    )


# ---- co-use ----------------------------------------------------------------------------------------------


def co_used_sets(uses: DataFrame, paper: str, item: str, max_size: int = 5, min_support: int = 2) -> DataFrame:
    """``(size, items, n_papers)``: item sets of 2..max_size used together by at least ``min_support`` papers.

    Papers with the same items are one weighted basket. Sets grow one item at a time and
    only from sets that already have the support, so no paper spells out all its
    combinations; items are joined by basket, where a very long basket is an ordinary
    skewed join.
    """
    ensure_checkpoint_dir(uses.sparkSession)
    pairs = uses.select(F.col(paper).alias("paper"), F.col(item).cast("string").alias("item")).filter("item is not null").distinct()
    common = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support).select("item")
    contents = pairs.join(common, "item", "left_semi").groupBy("paper").agg(F.array_sort(F.collect_set("item")).alias("items"))
    baskets = contents.groupBy("items").agg(F.count(F.lit(1)).alias("weight")).filter(F.size("items") > 1)
    baskets = baskets.withColumn("basket", F.monotonically_increasing_id()).checkpoint()
    members = baskets.select("basket", F.explode("items").alias("item"))
    level = baskets.select("basket", "weight", F.explode("items").alias("last")).withColumn("items", F.array("last"))
    found = []
    for size in range(2, max_size + 1):
        grown = (
            level.join(members, "basket")
            .filter(F.col("item") > F.col("last"))
            .select("basket", "weight", F.concat("items", F.array("item")).alias("items"), F.col("item").alias("last"))
        )
        if size < max_size:
            grown = grown.checkpoint()  # read by the count and by the next level; the last level only by its count
        frequent = grown.groupBy("items").agg(F.sum("weight").alias("n_papers")).filter(F.col("n_papers") >= min_support)
        found.append(frequent.select(F.lit(size).alias("size"), "items", "n_papers"))
        level = grown.join(frequent.select("items"), "items", "left_semi")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def support_table(sets: DataFrame, supports: Sequence[int] = (2, 3, 4, 5, 6)) -> DataFrame:
    """``(size, support_2, ...)``: number of sets of a size with at least that support."""
    return sets.groupBy("size").agg(*[F.count_if(F.col("n_papers") >= j).alias(f"support_{j}") for j in supports])


def top_sets(sets: DataFrame, n: int = 20) -> DataFrame:
    """Per size the sets with the highest support, of the first ``n`` in (support, items) order."""
    ordered = W.partitionBy("size").orderBy(F.desc("n_papers"), F.asc("items"))
    # only sets at the maximum can be listed, so the window sees those alone
    best = sets.groupBy("size").agg(F.max("n_papers").alias("n_papers"))
    return sets.join(best, ["size", "n_papers"]).withColumn("_at", F.row_number().over(ordered)).filter(F.col("_at") <= n).drop("_at")


def papers_of_sets(uses: DataFrame, paper: str, item: str, sets: DataFrame) -> DataFrame:
    """``(items, paper)`` rows for a short list of sets: papers that hold every item of the set."""
    wanted = sets.select("items", F.size("items").alias("_size"), F.explode("items").alias("item"))
    pairs = uses.select(F.col(paper).alias("paper"), F.col(item).cast("string").alias("item")).distinct()
    hits = pairs.join(wanted, "item").groupBy("items", "_size", "paper").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == F.col("_size")).select("items", "paper")


# ---- suite tables ---------------------------------------------------------------------------------------------


def collection_metadata(suites: DataFrame, qualities: DataFrame, columns: Sequence[str] = QUALITIES, symbolic: str = "NumberOfSymbolicFeatures") -> DataFrame:
    """Median and quartiles of each quality per suite, and how many datasets are numeric only."""
    members = suites.select("suite", "task_id").distinct().join(qualities, "task_id")
    names = {0.5: "median", 0.75: "q3", 0.25: "q1"}
    long = grouped_quantiles(members, ["suite"], columns, list(names))
    wide = long.groupBy("suite").agg(
        *[
            F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("value"))).alias(quality_column_name(label, c))
            for p, label in names.items()
            for c in columns
        ]
    )
    counts = members.groupBy("suite").agg(
        F.count(F.lit(1)).alias("number_of_datasets"),
        F.count_if(F.col(symbolic) <= 1).alias("number_of_numerical_datasets"),
        F.count_if(~F.coalesce(F.col(symbolic) <= 1, F.lit(False))).alias("number_of_categorical_datasets"),
    )
    return wide.join(counts, "suite", "full_outer")


def suite_summary(uses: DataFrame, unused_names: DataFrame, published: DataFrame) -> DataFrame:
    """Per paper: counts by kind, the numbers it states itself, and whether they agree.

    ``published(paper_key, type, method, stated_classification, stated_regression,
    stated_other)``; papers of type ``Suite`` are left out, those of type ``Data`` count zero.
    """
    invalid = F.coalesce(F.col("invalid") == INVALID, F.lit(False))
    classification = F.col("task_type") == CLASSIFICATION
    unused = unused_names.select(F.col("dataset_name").alias("dataset_name")).distinct().withColumn("_unused", F.lit(True))
    known = uses.join(unused, "dataset_name", "left")
    counts = known.groupBy("paper_key").agg(
        F.count_if(classification).alias("n_classification"),
        F.count_if(F.col("task_type") == REGRESSION).alias("n_regression"),
        F.count_distinct(F.when(classification & invalid & F.col("_unused"), F.col("dataset_name"))).alias("n_unusable"),
        F.count_distinct(F.when(classification & ~invalid, _identity())).alias("n_datasets"),
    )
    joined = published.filter("type <> 'Suite'").join(counts, "paper_key", "left")
    data_only = F.col("type") == "Data"
    zero = lambda c: F.when(data_only, 0).otherwise(F.coalesce(c, F.lit(0)))
    return joined.select(
        "paper_key",
        "type",
        F.coalesce("method", F.lit("-")).alias("method"),
        zero("n_classification").alias("classification"),
        zero("n_regression").alias("regression"),
        zero("n_unusable").alias("invalid_classification"),
        F.col("stated_other").alias("other"),
        (F.coalesce("n_datasets", F.lit(0)) + F.coalesce("n_unusable", F.lit(0)) - F.col("stated_classification")).alias("classification_gap"),
        (F.coalesce("n_regression", F.lit(0)) - F.col("stated_regression")).alias("regression_gap"),
    )


def summary_averages(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two rows, ``Mean`` and ``Median``, over the papers that are not data-only."""
    # one row per paper, so the exact percentile buffer holds a few dozen values
    kept = summary.filter("type <> 'Data'")
    mean = kept.agg(F.lit("Mean").alias("row"), *[F.avg(c).alias(c) for c in columns])
    median = kept.agg(F.lit("Median").alias("row"), *[F.median(c).cast("double").alias(c) for c in columns])
    return mean.unionByName(median)


def suite_statistics(suites: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per suite: numeric, categorical, mixed; binary, multiclass; mean majority share; numeric to other ratio.

    ``tasks(task_id, n_symbolic, n_numeric, n_classes, majority_size, n_rows)``; a missing
    class count or majority size is skipped where it is needed.
    """
    members = suites.select("suite", "task_id").distinct().join(tasks, "task_id")
    numeric = F.col("n_symbolic") == 1
    categorical = ~F.coalesce(numeric, F.lit(False)) & F.coalesce(F.col("n_numeric") == 0, F.lit(False))
    counted = members.groupBy("suite").agg(
        F.count_if(numeric).alias("numeric"),
        F.count_if(categorical).alias("categorical"),
        F.count_if(~F.coalesce(numeric, F.lit(False)) & ~categorical).alias("mixed"),
        F.count_if(F.col("n_classes") == 2).alias("binary"),
        F.count_if(F.col("n_classes") != 2).alias("multiclass"),
        F.avg(F.try_divide(F.col("majority_size"), F.col("n_rows"))).alias("balancedness"),
    )
    return counted.withColumn("ratio", F.try_divide(F.col("numeric"), F.col("categorical") + F.col("mixed")))
