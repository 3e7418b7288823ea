"""Rank correlation and significance statistics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabgauge.functions.ordered import running_before, sorted_codes, tie_ranks
from tabgauge.operators.ranks import method_ranks
from tabgauge.session import ensure_checkpoint_dir

# fixed values: studentised range over sqrt(2) for the post-hoc test, by number of methods from 2 on
NEMENYI_Q = {
    0.05: [1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544],
    0.10: [1.645, 2.052, 2.291, 2.459, 2.589, 2.693, 2.780, 2.855, 2.920, 2.978, 3.030, 3.077, 3.120, 3.159, 3.196, 3.230, 3.261, 3.291, 3.319],
}


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; runs on aggregated rows only."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def upper_p(z: pd.Series) -> pd.Series:
    """One-sided normal tail."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))


# ---- Kendall's tau -----------------------------------------------------------------------------------


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def kendall(df: DataFrame, groups: Sequence[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """Concordant and discordant pairs, ties, tau-b and tau-c per group, without forming the pairs.

    Each y becomes its rank code. Two codes first differ at one bit; above that bit they
    share a prefix. So per (bit, prefix) it is enough to walk in x order and count, for a
    row with bit 1, the earlier rows with bit 0 (concordant), and the other way round
    (discordant). That is n log n rows of work, and the walk is cut into slices.
    Rows with a null on either side are left out; ``groups`` must not be empty.
    """
    groups = list(groups)
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # five later steps read these counts; without the cut each would redo what led to them
    ensure_checkpoint_dir(df.sparkSession)
    cells = cells.checkpoint()
    codes = sorted_codes(cells, groups, "y", "code", bounded=bounded)
    width = codes.groupBy(*groups).agg(F.length(F.bin(F.max("code").cast("bigint"))).alias("bits"))
    coded = cells.join(codes.join(width, groups), [*groups, "y"])
    levels = coded.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    prefix, digit = F.expr("shiftright(code, bit + 1)"), F.expr("shiftright(code, bit) & 1")
    walk = levels.groupBy(*groups, "bit", prefix.alias("prefix"), "x").agg(
        F.sum(F.when(digit == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(digit == 1, F.col("n")).otherwise(0)).alias("ones"),
    )
    placed = running_before(walk, [*groups, "bit", "prefix"], ["x"], {"zeros_before": "zeros", "ones_before": "ones"}, bounded)
    crossing = placed.groupBy(*groups).agg(
        # as doubles: the number of pairs of a large table does not fit a long
        F.sum(F.col("ones").cast("double") * F.col("zeros_before")).alias("concordant"),
        F.sum(F.col("zeros").cast("double") * F.col("ones_before")).alias("discordant"),
    )

    def tie_sums(column: str) -> DataFrame:
        t = F.col("t").cast("double")
        return (
            cells.groupBy(*groups, column)
            .agg(F.sum("n").alias("t"))
            .groupBy(*groups)
            .agg(
                F.count(F.lit(1)).alias(f"{column}_levels"),
                F.sum(_pairs(t)).alias(f"{column}_ties"),
                F.sum(t * (t - 1) * (t - 2)).alias(f"{column}_0"),
                F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{column}_1"),
                *([F.sum("t").alias("n")] if column == "x" else []),
            )
        )

    joined = crossing.join(tie_sums("x"), groups).join(tie_sums("y"), groups)
    n = F.col("n").cast("double")
    all_pairs = _pairs(n)
    diff = F.col("concordant") - F.col("discordant")
    least = F.least("x_levels", "y_levels")
    m = n * (n - 1)
    spread = (
        (m * (2 * n + 5) - F.col("x_1") - F.col("y_1")) / 18
        + 2 * F.col("x_ties") * F.col("y_ties") / F.nullif(m, F.lit(0.0))
        + F.col("x_0") * F.col("y_0") / F.nullif(9 * m * (n - 2), F.lit(0.0))
    )
    return joined.select(
        *groups,
        "n",
        "concordant",
        "discordant",
        (diff / F.nullif(F.sqrt((all_pairs - F.col("x_ties")) * (all_pairs - F.col("y_ties"))), F.lit(0.0))).alias("tau_b"),
        F.when(least > 1, 2 * diff / (n * n * (least - 1) / least)).alias("tau_c"),
        (diff / F.nullif(F.sqrt(spread), F.lit(0.0))).alias("z"),
    )


def hardness_age_tau(hardness_age: DataFrame, age: str = "age", hardness: str = "hardness") -> DataFrame:
    """Tau-c of age and hardness with the one-sided (greater) p-value of the normal approximation."""
    rows = kendall(hardness_age.select(F.lit(0).alias("_g"), age, hardness), ["_g"], age, hardness)
    return rows.drop("_g").withColumn("p_value", upper_p("z"))


def suite_pairs(rank_rows: DataFrame, key: str = "method", suite: str = "suite", value: str = "avg_rank") -> DataFrame:
    """``(suite_a, suite_b, key, a, b)``: every two suites' values side by side, per method.

    The output is the (suites x suites) matrix itself, so its size is that of the answer.
    """
    left = rank_rows.select(F.col(suite).alias("suite_a"), key, F.col(value).alias("a"))
    right = rank_rows.select(F.col(suite).alias("suite_b"), key, F.col(value).alias("b"))
    return left.join(right, key)


def suite_similarity(
    rank_rows: DataFrame, pair_value: Callable[[Column, Column], Column] | None = None, name: str = "mse", **columns
) -> DataFrame:
    """``(suite_a, suite_b, mse, tau)``; ``pair_value(a, b)`` replaces the squared difference."""
    pair_value = pair_value or (lambda a, b: F.pow(a - b, 2))
    pairs = suite_pairs(rank_rows, **columns)
    mean = pairs.groupBy("suite_a", "suite_b").agg(F.avg(pair_value(F.col("a"), F.col("b"))).alias(name))
    tau = kendall(pairs, ["suite_a", "suite_b"], "a", "b", bounded=True).select("suite_a", "suite_b", F.col("tau_b").alias("tau"))
    return mean.join(tau, ["suite_a", "suite_b"])


#: differences up to which published tables of the signed-rank test are exact
EXACT_TASKS = 25

# ---- Wilcoxon signed rank with Holm's correction ------------------------------------------------------


def method_pairs(table: DataFrame) -> DataFrame:
    """``(method_a, method_b, task_id, d)`` for a < b, from ``(task_id, method, value)``.

    One shuffle gathers the few methods of a task into an array; the pairs come from it.
    """
    rows = table.filter("value is not null").groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("method", "value"))).alias("m")
    )
    left = rows.select("task_id", "m", F.posexplode("m").alias("i", "a"))
    return left.select("task_id", "a", F.explode(F.expr("slice(m, i + 2, greatest(size(m) - i - 1, 0))")).alias("b")).select(
        F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b"), "task_id", (F.col("a.value") - F.col("b.value")).alias("d")
    )


def signed_rank_sums(table: DataFrame, bounded: bool = False) -> DataFrame:
    """``(method_a, method_b, n, w_plus, w_minus, tie_term)``; zero differences are removed."""
    keys = ["method_a", "method_b"]
    moved = method_pairs(table).filter("d <> 0").withColumn("size", F.abs("d"))
    ranked = tie_ranks(moved, keys, "size", "rank", descending=False, bounded=bounded)
    ties = moved.groupBy(*keys, "size").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*keys).agg(
        F.sum(F.pow("t", 3) - F.col("t")).alias("tie_term")
    )
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
    )
    return sums.join(ties, keys)


def holm(df: DataFrame, p: str, output: str = "p_holm", within: Sequence[str] = ()) -> DataFrame:
    """Holm's step-down: p in rising order times (m, m - 1, ...), running maximum, at most 1.

    The rows are pairs of methods, so the window is bounded by the method list.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    ordered = group.orderBy(F.col(p).asc(), *[F.col(c) for c in ("method_a", "method_b") if c in df.columns])
    scaled = F.col(p) * (F.count(F.lit(1)).over(group) - F.row_number().over(ordered) + 1)
    return (
        df.withColumn("_scaled", scaled)
        .withColumn(output, F.least(F.max("_scaled").over(ordered.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0)))
        .drop("_scaled")
    )


def exact_signed_rank_p(n: Column, w: Column) -> Column:
    """Two-sided p-value of the smaller rank sum ``w`` of ``n`` untied differences, from the null distribution.

    Each rank falls on either side with equal chance. The number of ways to reach every sum grows rank by rank: the ways
    without the rank, and the ways with it, moved up by it. All counts are whole numbers below ``2 ** n``.
    """
    nothing = lambda r: F.array_repeat(F.lit(0.0), r)
    ways = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.array(F.lit(1.0)),
        lambda c, r: F.zip_with(F.concat(c, nothing(r)), F.concat(nothing(r), c), lambda without, with_: without + with_),
    )
    reached = F.aggregate(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda total, x: total + x)
    return F.least(2 * reached / F.pow(F.lit(2.0), n), F.lit(1.0))


def wilcoxon_holm(table: DataFrame, alpha: float = 0.05, bounded: bool = False, exact_up_to: int = 0) -> DataFrame:
    """Pairwise signed-rank tests with Holm-corrected p-values, two-sided.

    Pairs with up to ``exact_up_to`` differences (``EXACT_TASKS`` is the usual choice), none of them tied, get the
    exact p-value; the others, and all by default, the tie-corrected normal approximation. The definition follows the
    published tests, not one particular library.
    """
    sums = signed_rank_sums(table, bounded)
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = (F.least("w_plus", "w_minus") - mean) / F.nullif(F.sqrt(var), F.lit(0.0))
    exact = (F.col("n") <= exact_up_to) & (F.col("tie_term") == 0)
    p_value = F.when(exact, exact_signed_rank_p(F.col("n"), F.least("w_plus", "w_minus"))).otherwise(two_sided_p("z"))
    tested = sums.withColumn("z", z).withColumn("p_value", p_value)
    return holm(tested, "p_value").withColumn("different", F.col("p_holm") < alpha)


# ---- many methods ----------------------------------------------------------------------------------


def friedman(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: number of methods and of tasks that have them all, tie-corrected Friedman statistic, critical difference."""
    ranked = method_ranks(table)
    methods = ranked.agg(F.count_distinct("method")).scalar()
    # tasks where every method has a rank, and how many methods share each rank
    whole = ranked.filter(F.col("rank").isNotNull()).groupBy("task_id").agg(F.count(F.lit(1)).alias("_methods"))
    complete = whole.filter(F.col("_methods") == methods).select("task_id")
    facts = ranked.join(complete, "task_id")
    shared = facts.groupBy("task_id", "rank").agg(F.count(F.lit(1)).alias("t"))
    ties = shared.agg(F.coalesce(F.sum(F.pow("t", 3) - F.col("t")), F.lit(0.0))).scalar()
    per_method = facts.groupBy("method").agg(F.avg("rank").alias("r"), F.count("rank").alias("n"))
    # beyond the table of the studentised range there is no critical difference
    q = F.get(F.array(*[F.lit(v) for v in NEMENYI_Q[alpha]]), (F.col("k") - 2).cast("int"))
    summed = per_method.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n_tasks"), F.sum(F.pow("r", 2)).alias("s"))
    k, n = F.col("k"), F.col("n_tasks")
    tied = 1 - ties / F.nullif(n * k * (k * k - 1), F.lit(0))
    return summed.select(
        F.col("k").alias("n_methods"),
        "n_tasks",
        (12 * n / (k * (k + 1)) * (F.col("s") - k * F.pow(k + 1, 2) / 4) / F.nullif(tied, F.lit(0.0))).alias("chi_square"),
        (q * F.sqrt(k * (k + 1) / (6 * n))).alias("critical_difference"),
    )


def mean_ranks_with_spread(table: DataFrame) -> DataFrame:
    """``(method, mean_rank, mean_value, std_value)``, the table shown beside the omnibus test."""
    return method_ranks(table).groupBy("method").agg(
        F.avg("rank").alias("mean_rank"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value")
    )

