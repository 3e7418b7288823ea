"""Results, ranks, statistics, hardness and suites on tables worked out by hand."""

import itertools
import math

import numpy as np
import pytest
from compare import plan_text
from pyspark.sql import functions as F

from tabgauge.functions.digest import uniform
from tabgauge.operators import hardness, ranks, results, significance, suites, walltime

LONG = "method string, fold int, split int, config int, task_id bigint, metric string, value double"


@pytest.fixture(scope="module")
def facts(spark):
    rows = []
    for split in (0, 1):
        rows += [("a", 0, split, 1, 7, "valid_x", 0.5), ("a", 0, split, 2, 7, "valid_x", 0.5), ("a", 0, split, 3, 7, "valid_x", 0.4)]
        rows += [("a", 0, split, 1, 7, "test_x", 0.1 + split), ("a", 0, split, 2, 7, "test_x", 0.9), ("a", 0, split, 3, 7, "test_x", 1.0)]
    rows += [("b", 0, 0, 4, 7, "valid_x", 0.3), ("b", 0, 0, 4, 7, "test_x", 0.2)]
    return spark.createDataFrame(rows, LONG)


def test_incumbent_ties_take_the_lower_config(facts):
    ids = {(r["method"]): r["config"] for r in results.incumbent_configs(facts, "valid_x").collect()}
    assert ids == {"a": 1, "b": 4}
    table = {r["method"]: r["value"] for r in results.incumbent_metric(facts, "x").collect()}
    assert table == {"a": pytest.approx(0.6), "b": 0.2}
    everything = results.incumbent_results(facts, "valid_x")
    assert everything.groupBy("method", "fold", "task_id").agg(F.count_distinct("config").alias("n")).filter("n <> 1").count() == 0
    wide = results.incumbent_ids_wide(results.incumbent_configs(facts, "valid_x"), [0, 1])
    assert results.lookup_incumbent(wide, "a", 7, 0) == 1
    with pytest.raises(LookupError):
        results.lookup_incumbent(wide, "a", 7, 1)


def test_slicing_rules(facts):
    assert "method" not in results.at(facts, method="a").columns
    assert "method" in results.at(facts, method=["a"]).columns
    assert results.at(facts, dataset=[], metric=[]).count() == facts.count()
    with pytest.raises(LookupError):
        results.at(facts, check_empty=True, method="nobody")
    with pytest.raises(ValueError):
        results.at(facts, dataset_id=1)
    assert results.add_method(None, facts).count() == facts.count()
    assert results.drop_methods(facts, ["a"]).count() == 2


def test_filters_reach_the_scan(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "facts"))
    sliced = results.at(spark.read.parquet(str(tmp_path / "facts")), method=["a"], fold=0, metric="valid_x")
    plan = plan_text(sliced)
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(f in pushed for f in ("EqualTo(method,a)", "EqualTo(fold,0)", "EqualTo(metric,valid_x)"))


def test_dense_grid_and_missing(spark):
    rows = [("a", 0, 1, "m", 1.0), ("a", 1, 1, "m", 2.0), ("b", 0, 2, "m", 3.0)]
    df = spark.createDataFrame(rows, "method string, fold int, task_id int, metric string, value double")
    dense = results.dense_grid(df, ["method", "fold", "task_id", "metric"])
    assert dense.count() == 8 and dense.filter("value is null").count() == 5
    assert results.handle_missing(dense, "m").agg(F.sum("value")).first()[0] == 6.0
    assert results.handle_missing(dense, "m", "drop_nan").count() == 0
    with pytest.raises(ValueError):
        results.handle_missing(dense, "m", "other")
    with pytest.raises(ValueError):
        results.level_values(df, ["method", "fold"], limit=1)


def test_walltime_rules(spark):
    rows = [("a", 0, 10.0), ("a", 0, -8640.0), ("a", 0, 90000.0), ("a", 0, None), ("b", 0, -8640.0)]
    df = spark.createDataFrame(rows, "method string, fold int, total_walltime double")
    assert [(r["method"], r["days"]) for r in walltime.total_days(df).collect()] == [("a", 10 * 5 / 86400)]
    assert walltime.under_cutoff(df, 100).count() == 3
    h = {r["bin"]: r["n"] for r in walltime.histogram(df.filter("method = 'a'"), ["method"], bins=10).collect()}
    assert sum(h.values()) == 4 and h[9] == 2


def test_trajectory_with_tie(spark):
    rows = [(1, 1.0, 10.0), (2, 3.0, 20.0), (3, 2.0, 30.0), (4, 3.0, 40.0), (5, 5.0, 50.0)]
    df = spark.createDataFrame(rows, "config int, valid double, test double").withColumn("g", F.lit(0))
    walked = ranks.incumbent_trajectory(df, ["g"], ["config"]).orderBy("config").collect()
    assert [r["best_so_far"] for r in walked] == [1, 3, 3, 3, 5]
    assert [r["test"] for r in walked] == [10, 20, 20, 40, 50]
    repeats = ranks.shuffled_trajectories(df, ["g"], n_shuffles=4)
    assert repeats.filter("step = 1 and config <> 1").count() == 0 and repeats.count() == 20
    last = repeats.filter("step = 5").select("best_so_far").distinct().collect()
    assert [r[0] for r in last] == [5.0]


def test_rank_sums(spark):
    df = spark.range(60).select((F.col("id") % 5).alias("task_id"), F.concat(F.lit("m"), (F.col("id") / 5).cast("int")).alias("method"), F.floor(uniform(1, "id") * 4).cast("double").alias("value"))
    sums = ranks.method_ranks(df).groupBy("task_id").agg(F.sum("rank").alias("s")).collect()
    assert all(r["s"] == 12 * 13 / 2 for r in sums)
    sets = ranks.ranks_random_sets(df, n_rep=3)
    assert sets.filter("size = 0 and mean_rank is not null").count() == 0
    assert {r[0] for r in sets.select("size").distinct().collect()} == set(range(5))
    sliced = ranks.ranks_random_sets(df, n_rep=3, bounded=False)
    assert sets.join(sliced.withColumnRenamed("mean_rank", "b"), ["rep", "method", "size"]).filter("abs(mean_rank - b) > 1e-9").count() == 0


def _tau_counts(xs, ys):
    c = d = 0
    for (a, b), (e, f) in itertools.combinations(zip(xs, ys), 2):
        s = np.sign(a - e) * np.sign(b - f)
        c, d = c + (s > 0), d + (s < 0)
    return int(c), int(d)


@pytest.mark.parametrize("bounded", [True, False])
def test_kendall_against_brute_force(spark, bounded):
    df = spark.range(180).select(
        (F.col("id") % 2).alias("g"), F.floor(uniform(1, "id") * 15).alias("x"), F.floor(uniform(2, "id") * 40 + uniform(1, "id") * 30).alias("y")
    )
    rows = df.toPandas()
    for r in significance.kendall(df, ["g"], "x", "y", bounded).collect():
        part = rows[rows["g"] == r["g"]]
        c, d = _tau_counts(part["x"], part["y"])
        assert (r["concordant"], r["discordant"]) == (c, d)
        m = min(part["x"].nunique(), part["y"].nunique())
        assert r["tau_c"] == pytest.approx(2 * (c - d) / (len(part) ** 2 * (m - 1) / m))


def test_kendall_without_ties(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 3, 5, 4])], "g int, x int, y int")
    r = significance.kendall(df, ["g"], "x", "y").first()
    assert (r["concordant"], r["discordant"], r["tau_b"]) == (9, 1, pytest.approx(0.8))
    assert r["z"] == pytest.approx(8 / math.sqrt(5 * 4 * 15 / 18))


def test_wilcoxon_and_holm(spark):
    table = spark.createDataFrame(
        [(t, m, v) for t in range(8) for m, v in (("a", t + 1.0), ("b", 0.0 if t else 1.0), ("c", -t * 2.0))], "task_id int, method string, value double"
    )
    rows = {(r["method_a"], r["method_b"]): r for r in significance.wilcoxon_holm(table).collect()}
    ab = rows[("a", "b")]
    assert (ab["n"], ab["w_plus"], ab["w_minus"]) == (7, 28.0, 0.0)  # the zero difference of task 0 is gone
    assert ab["p_value"] == pytest.approx(math.erfc(abs((0 - 14) / math.sqrt(7 * 8 * 15 / 24)) / math.sqrt(2)))
    ordered = sorted(rows.values(), key=lambda r: r["p_value"])
    assert [r["p_holm"] for r in ordered] == sorted(r["p_holm"] for r in ordered)
    assert all(r["p_holm"] >= r["p_value"] for r in ordered)


def test_friedman(spark):
    table = spark.createDataFrame([(t, m, float(i)) for t in range(5) for i, m in enumerate("abc")], "task_id int, method string, value double")
    r = significance.friedman(table).first()
    assert r["chi_square"] == pytest.approx(10.0)
    assert r["critical_difference"] == pytest.approx(2.343 * math.sqrt(3 * 4 / 30))


def test_chain_order(spark):
    rows = [("all_datasets", "x", 0.5, 0.9), ("all_datasets", "y", 0.1, 0.1), ("y", "x", 0.2, 0.0), ("y", "all_datasets", 0.0, 1.0), ("x", "y", 0.2, 0.0)]
    rows += [(s, s, 0.0, 1.0) for s in ("all_datasets", "x", "y")]
    df = spark.createDataFrame(rows, "suite_a string, suite_b string, mse double, tau double")
    assert [(r["position"], r["suite"]) for r in ranks.chain_order(df).collect()] == [(0, "all_datasets"), (1, "y"), (2, "x")]
    with pytest.raises(Exception, match="more than 2 suites"):
        ranks.chain_order(df, most=2).collect()


def test_hardness(spark):
    rows = [(1, "s1", 0.9), (1, "s2", 0.8), (1, "t1", 0.6), (1, "t2", 0.7), (2, "s1", 0.4), (2, "s2", 0.3), (2, "t1", 0.2), (2, "t2", 0.4)]
    table = spark.createDataFrame(rows, "task_id int, method string, value double")
    got = {r["task_id"]: r["hardness"] for r in hardness.hardness_grin(table, ["s1", "s2", "t1", "t2"], ["s1", "s2"], ["t1", "t2"]).collect()}
    assert got[1] == pytest.approx((0.8 - 0.5) / 0.4 - (0.7 - 0.5) / 0.4)
    assert got[2] == pytest.approx((0.3 - 0.2) / 0.2 - (0.4 - 0.2) / 0.2)
    std = {r["task_id"]: r["hardness"] for r in hardness.hardness_std(table).collect()}
    assert sorted(std.values()) == [0.0, 1.0]


def test_unclear_identity_is_an_error(spark):
    schema = "paper_key string, dataset_name string, dataset_id bigint, dataset_mapping bigint, task_type string, invalid string"
    bad = spark.createDataFrame([("p", "n", None, None, "Classification", None), ("p", "n", 1, 2, "Classification", None)], schema)
    assert suites.ambiguous_uses(bad).count() == 2
    with pytest.raises(Exception, match="exactly one of dataset id"):
        suites.use_counts(bad).collect()


def test_co_used_sets_against_brute_force(spark):
    """One long basket, many equal baskets, single-item baskets."""
    baskets = {f"p{i}": {"abcdefgh"[(i * 3 + j) % 8] for j in range(i % 5)} for i in range(40)}
    baskets["long"] = set("abcdefgh")
    df = spark.createDataFrame([(p, x) for p, items in baskets.items() for x in items], "paper string, item string")
    want = {}
    for items in baskets.values():
        for size in range(2, 6):
            for s in itertools.combinations(sorted(items), size):
                want[s] = want.get(s, 0) + 1
    want = {s: n for s, n in want.items() if n >= 2}
    got = {tuple(r["items"]): r["n_papers"] for r in suites.co_used_sets(df, "paper", "item").collect()}
    assert got == want
    top = suites.top_sets(suites.co_used_sets(df, "paper", "item", max_size=2), n=3)
    papers = {r["paper"] for r in suites.papers_of_sets(df, "paper", "item", top.limit(1)).collect()}
    first = set(top.limit(1).first()["items"])
    assert papers == {p for p, items in baskets.items() if first <= items}


def test_friedman_beyond_the_table_with_ties_and_gaps(spark):
    rows = [(t, f"m{m}", float((m * 7 + t) % 25) / 25) for t in range(30) for m in range(25)]
    rows += [(99, "m1", 0.5)]  # a task without the other methods does not count
    r = significance.friedman(spark.createDataFrame(rows, "task_id int, method string, value double")).first()
    assert (r["n_methods"], r["n_tasks"], r["critical_difference"]) == (25, 30, None)
    same = [(t, f"m{m}", 1.0 if m < 2 else 0.0) for t in range(6) for m in range(3)]
    tied = significance.friedman(spark.createDataFrame(same, "task_id int, method string, value double")).first()
    assert tied["chi_square"] == pytest.approx(12.0)


def test_exact_signed_rank_p_by_enumeration(spark):
    """Every assignment of signs to the ranks, counted."""
    cases = [(n, float(w)) for n in (1, 2, 5, 9) for w in range(n * (n + 1) // 4 + 1)]
    df = spark.createDataFrame(cases, "n long, w double").select("n", "w", significance.exact_signed_rank_p(F.col("n"), F.col("w")).alias("p"))
    for r in df.collect():
        sums = [sum(k + 1 for k in range(r["n"]) if s >> k & 1) for s in range(2 ** r["n"])]
        assert r["p"] == pytest.approx(min(1.0, 2 * sum(x <= r["w"] for x in sums) / len(sums)))


def test_pairs_with_few_tasks_get_exact_p_values(spark):
    rows = [(t, m, v) for t in range(8) for m, v in (("a", t + 1.0), ("b", 0.0 if t else 1.0))]
    table = spark.createDataFrame(rows, "task_id int, method string, value double")
    p = lambda **options: significance.wilcoxon_holm(table, **options).first()["p_value"]
    assert p(exact_up_to=significance.EXACT_TASKS) == 2 / 2**7 and p(exact_up_to=6) == p() != 2 / 2**7


def test_incomplete_collections_are_dropped_and_positions_close_up(spark):
    rows = [(s, "m", k, None if (s, k) == ("b", "y") else 1.0) for s in "abc" for k in ("x", "y")]
    table = spark.createDataFrame(rows, "suite string, metric string, method string, avg_rank double")
    order = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, suite string")
    out = ranks.parallel_coordinates(table, {"plain": order}).collect()
    assert sorted((r["position"], r["suite"], r["method"]) for r in out) == [(0, "a", "x"), (0, "a", "y"), (1, "c", "x"), (1, "c", "y")]
