"""Result-table queries: slicing, incumbents, missing results, walltime, ranks, correlation, hardness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabgauge.functions import scalars as X
from tabgauge.operators import hardness, ranks, results, significance, walltime
from tabgauge.plans.inputs import METHODS, QUALITY, R1, R2, SUITES, TASK_METHOD, Inputs
from tabgauge.plans.registry import query
from tabgauge.sources import tables

KEYS = ["method", "fold", "split", "config", "task_id"]
TASKS = list(range(20))


def _r(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _named(t: Inputs):
    """The fact table with metrics named ``valid_score`` and ``test_score``."""
    return t.results


# ---- slicing ------------------------------------------------------------------------------------------


@query("result_cells", f"with {R1} select method, fold, split, config, task_id, metric, value from (unpivot (select method, fold, split, config, task_id, valid_score, test_score, total_walltime from r1) on valid_score, test_score, total_walltime into name metric value value)")
def _(t: Inputs):
    return t.results


@query(
    "slice_results",
    f"""with {R1} select method, split, config, task_id, test_score as value from r1 where method in ('m1','m4') and fold = 2 and task_id in (3, 9, 11)""",
)
def _(t: Inputs):
    return results.at(t.results, method=["m1", "m4"], fold=2, dataset=[3, 9, 11], metric="test_score").select("method", "split", "config", "task_id", "value")


@query(
    "slice_by_dataset",
    f"""with {R1} select method, fold, config, task_id, valid_score as value from r1
    where split = 1 and task_id in (select s_suppkey%20 from supplier group by 1 having min(s_suppkey)+100 in (104, 113))
      and task_id in (select s_suppkey%20 from supplier group by 1 having min(s_name) in ('Supplier#000000004', 'Supplier#000000013'))""",
)
def _(t: Inputs):
    sliced = results.at(
        t.results, t.task_dim, split=1, dataset_id=[104, 113], dataset_name=["Supplier#000000004", "Supplier#000000013"],
        dataset=[], metric=["valid_score"],
    )
    return sliced.select("method", "fold", "config", "task_id", "value")


@query(
    "attach_dataset",
    f"""with {R1} select method, fold, split, config, task_id, d.dataset_id, d.dataset_name, test_score from r1
    left join (select s_suppkey%20 as task_id, min(s_suppkey)+100 as dataset_id, min(s_name) as dataset_name from supplier group by 1) d using (task_id)""",
)
def _(t: Inputs):
    return results.with_dataset(t.r1.select(*KEYS, "test_score"), t.task_dim)


@query(
    "level_values",
    f"""with {R1} select 'method' as level, method as value from r1 group by all union all select 'fold', fold::varchar from r1 group by all
    union all select 'split', split::varchar from r1 group by all union all select 'config', config::varchar from r1 group by all
    union all select 'task_id', task_id::varchar from r1 group by all""",
)
def _(t: Inputs):
    # one pass: the distinct keys of each level come from one exploded aggregate
    cells = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in KEYS])
    return t.r1.select(F.inline(cells)).distinct()


@query(
    "stack_methods",
    f"""with {R1} select method, fold, split, config, task_id, test_score from r1 where method in ('m0','m2','m3') and task_id < 8""",
)
def _(t: Inputs):
    per_method = [t.r1.filter(F.col("method") == m).select(*KEYS, "test_score") for m in ("m0", "m2", "m3")]
    return results.stack_methods(per_method, tasks=list(range(8)))


@query("drop_methods", f"""with {R1} select method, fold, split, config, task_id, test_score from r1 where method not in ('m0','m5')""")
def _(t: Inputs):
    return results.drop_methods(t.r1.select(*KEYS, "test_score"), ["m0", "m5"])


@query(
    "metric_part_names",
    f"""with {R1} select distinct part||'_'||metric as name, count(*) over (partition by part, metric) as n from r1,
      (select unnest(['train','valid','test']) as part), (select unnest(['accuracy','roc_auc']) as metric)""",
)
def _(t: Inputs):
    parts, metrics = F.array(*map(F.lit, ["train", "valid", "test"])), F.array(*map(F.lit, ["accuracy", "roc_auc"]))
    named = t.r1.select(F.explode(parts).alias("part"), "method").select("part", F.explode(metrics).alias("metric"))
    return named.groupBy(X.metric_part_name("part", "metric").alias("name")).agg(F.count(F.lit(1)).alias("n"))


# ---- incumbents ------------------------------------------------------------------------------------------

_INCUMBENT = f"""with {R1}, cm as (
      select method, fold, task_id, config, avg(valid_score) as v, avg(test_score) as s, avg(total_walltime) as w from r1 group by all),
    inc as (select *, row_number() over (partition by method, fold, task_id order by round(v, 12) desc, config) as rn from cm)"""


@query(
    "incumbent_metric_table",
    _INCUMBENT + """, x as (select task_id, method, avg(s) as value from inc where rn = 1 group by all)
    select task_id, round(max(value) filter (method='m0'), 10) as m0, round(max(value) filter (method='m1'), 10) as m1,
      round(max(value) filter (method='m2'), 10) as m2, round(max(value) filter (method='m3'), 10) as m3,
      round(max(value) filter (method='m4'), 10) as m4, round(max(value) filter (method='m5'), 10) as m5 from x group by 1""",
)
def incumbent_metric_table(t: Inputs):
    """Flagship: tasks by methods, config chosen on validation, test score reported."""
    long = results.incumbent_metric(t.results, "score")
    return _r(results.as_table(long, METHODS), 10, *METHODS)


@query(
    "incumbent_results",
    _INCUMBENT + """ select method, fold, task_id, config, metric, round(value, case metric when 'total_walltime' then 8 else 10 end) as value from (
      unpivot (select method, fold, task_id, config, v as valid_score, s as test_score, w as total_walltime from inc where rn = 1)
      on valid_score, test_score, total_walltime into name metric value value)""",
)
def _(t: Inputs):
    chosen = results.incumbent_results(t.results, "valid_score")
    places = F.when(F.col("metric") == "total_walltime", F.round("value", 8)).otherwise(F.round("value", 10))
    return chosen.withColumn("value", places)


@query(
    "incumbent_config_ids",
    _INCUMBENT + """ select method, task_id, max(config) filter (fold=0) as fold_0, max(config) filter (fold=1) as fold_1,
      max(config) filter (fold=2) as fold_2, max(config) filter (fold=3) as fold_3 from inc where rn = 1 group by 1, 2""",
)
def _(t: Inputs):
    return results.incumbent_ids_wide(results.incumbent_configs(t.results, "valid_score"), [0, 1, 2, 3])


@query(
    "default_results",
    f"""with {R1} select method, fold, task_id, 'test_score' as metric, round(avg(test_score), 10) as value from r1 where config = 1 group by all""",
)
def _(t: Inputs):
    return _r(results.default_results(t.results, ["test_score"]), 10, "value")


@query(
    "metric_table",
    f"""with {TASK_METHOD} select task_id, {', '.join(f"round(max(value) filter (method='{m}'), 10) as {m}" for m in METHODS)} from tm group by 1""",
)
def _(t: Inputs):
    return _r(results.as_table(results.metric_means(t.results, "test_score"), METHODS), 10, *METHODS)


@query(
    "comparison_table",
    f"""with {R1}, f as (select method, fold, task_id, round(avg(test_score), 10) as value from r1 group by all)
    select method, fold, max(value) filter (task_id=2) as "2", max(value) filter (task_id=5) as "5", max(value) filter (task_id=17) as "17" from f group by 1, 2""",
)
def _(t: Inputs):
    means = results.config_means(t.results, ("method", "fold", "task_id"))
    return tables.comparison_table(_r(means, 10, "value"), "test_score", [2, 5, 17])


# ---- missing results --------------------------------------------------------------------------------------------


@query(
    "tasks_without_missing",
    f"""with {R2}, d as (select task_id, method, fold, avg(test_score) as v from r2 group by all)
    select task_id from d group by 1 having count(v) = count(*)""",
)
def _(t: Inputs):
    cells = t.r2.select("task_id", "method", "fold", F.col("test_score").alias("value"))
    return results.tasks_without_missing(cells)


_DENSE = f"""with {R2}, f as (select method, fold, task_id, avg(test_score) as value from r2 group by all),
    grid as (select m.method, f.fold, k.task_id from (select distinct method from r2) m, (select distinct fold from r2) f, (select distinct task_id from r2) k),
    dense as (select grid.*, value from grid left join f using (method, fold, task_id)),
    kept as (select * from dense where task_id in (select task_id from dense where value is not null))"""


def _dense(t: Inputs):
    means = t.r2.groupBy("method", "fold", "task_id").agg(F.avg("test_score").alias("value"))
    return results.dense_grid(means, ["method", "fold", "task_id"]).withColumn("metric", F.lit("test_score"))


@query("dense_grid", _DENSE + " select method, fold, task_id, round(value, 10) as value from dense")
def _(t: Inputs):
    return _r(_dense(t).drop("metric"), 10, "value")


@query("fill_missing_results", _DENSE + " select method, fold, task_id, round(coalesce(value, 0), 10) as value from kept")
def _(t: Inputs):
    return _r(results.handle_missing(_dense(t), "test_score").drop("metric"), 10, "value")


@query(
    "drop_missing_results",
    _DENSE + """ select method, fold, task_id, round(value, 10) as value from kept
    where (method, fold) not in (select (method, fold) from kept where value is null)""",
)
def _(t: Inputs):
    return _r(results.handle_missing(_dense(t), "test_score", "drop_nan").drop("metric"), 10, "value")


@query(
    "drop_empty_cells",
    f"""with {R2} select method, fold, split, config, task_id, test_score, total_walltime from r2 where test_score is not null""",
)
def _(t: Inputs):
    kept = results.drop_all_missing_rows(t.r2, ["test_score", "total_walltime"])
    return results.drop_any_missing_rows(kept, ["test_score", "total_walltime"])


@query(
    "failed_tasks",
    f"""with {R2}, {SUITES}, ok as (select distinct task_id, method from r2 where test_score is not null)
    select suite, m.method, count(*) as n_datasets, count(*) filter (ok.method is null) as n_failed
    from suites cross join (select unnest(['m0','m1','m2','m3','m4','m5']) as method) m left join ok on ok.task_id = suites.task_id and ok.method = m.method group by 1, 2""",
)
def _(t: Inputs):
    means = t.r2.groupBy("task_id", "method").agg(F.avg("test_score").alias("value"))
    return results.failed_tasks(means, METHODS, t.suites)


@query(
    "failed_task_list",
    f"""with {R2}, {SUITES}, ok as (select distinct task_id, method from r2 where test_score is not null)
    select suite, m.method, task_id from suites cross join (select unnest(['m0','m1','m2','m3','m4','m5']) as method) m
    where not exists (from ok where ok.task_id = suites.task_id and ok.method = m.method)""",
)
def _(t: Inputs):
    means = t.r2.groupBy("task_id", "method").agg(F.avg("test_score").alias("value"))
    return results.failed_task_list(means, METHODS, t.suites)


# ---- walltime ---------------------------------------------------------------------------------------------------------


@query("results_under_cutoff", f"""with {R1} select method, fold, split, config, task_id, total_walltime from r1 where total_walltime < 50000""")
def _(t: Inputs):
    return walltime.under_cutoff(t.r1.select(*KEYS, "total_walltime"), 50_000.0)


@query(
    "total_walltime_days",
    f"""with {R1} select method, round(sum(total_walltime)*5/86400.0::double, 6) as days from r1 where total_walltime > 0 and total_walltime < 86400 group by 1""",
)
def _(t: Inputs):
    return _r(walltime.total_days(t.r1), 6, "days")


@query(
    "walltime_days_per_cutoff",
    f"""with {R1} select method, fold, c::double as cutoff, round(coalesce(sum(total_walltime) filter (total_walltime < c and total_walltime > 0 and total_walltime < 86400), 0)*5/86400.0::double, 6) as days
    from r1, (select unnest([20000, 50000, 90000]) as c) group by 1, 2, 3""",
)
def _(t: Inputs):
    return _r(walltime.total_days_per_cutoff(t.r1, [20_000, 50_000, 90_000]), 6, "days")


_HISTOGRAM = """, x as (select {by} as g, coalesce(case when config % 9 = 0 then null else total_walltime end, 86400) as t from r1 where {where}),
    e as (select g, min(t) as lo, max(t) as hi from x group by 1)
    select x.g as {by}, cast(case when hi = lo then 0 else least(floor((t-lo)/((hi-lo)/{bins})), {bins}-1) end as int) as bin, count(*) as n
    from x join e using (g) group by 1, 2"""


def _gappy(t: Inputs):
    return t.r1.withColumn("total_walltime", F.when(F.col("config") % 9 != 0, F.col("total_walltime")))


@query("walltime_histogram", f"with {R1}" + _HISTOGRAM.format(by="method", where="fold=0 and split=0", bins=100))
def _(t: Inputs):
    return walltime.histogram(_gappy(t).filter("fold = 0 and split = 0"), ["method"]).withColumn("n", F.col("n").cast("bigint"))


@query("walltime_histogram_per_task", f"with {R1}" + _HISTOGRAM.format(by="task_id", where="method='m3'", bins=20))
def _(t: Inputs):
    return walltime.histogram(_gappy(t).filter("method = 'm3'"), ["task_id"], bins=20)


@query(
    "failed_config_counts",
    f"""with {R2} select method, task_id, count(*) as n_failed from r2 where test_score is null group by 1, 2""",
)
def _(t: Inputs):
    return walltime.failed_config_counts(t.r2, "test_score")


# ---- ranks --------------------------------------------------------------------------------------------------------------

_RANKED = f"""with {TASK_METHOD}, rk as (
      select task_id, method, value, rank() over (partition by task_id order by round(value, 12) desc)
        + (count(*) over (partition by task_id, round(value, 12)) - 1)/2.0::double as rank from tm)"""


@query("method_ranks", _RANKED + " select task_id, method, rank from rk")
def _(t: Inputs):
    return ranks.method_ranks(t.task_method.withColumn("value", F.round("value", 12))).select("task_id", "method", "rank")


@query(
    "tied_method_ranks",
    f"""with {R1}, v as (select task_id, fold, method, floor(avg(test_score)*10 + 1e-6) as value from r1 group by all)
    select task_id, fold, method, rank() over (partition by task_id, fold order by value desc) + (count(*) over (partition by task_id, fold, value) - 1)/2.0::double as rank from v""",
)
def _(t: Inputs):
    coarse = t.r1.groupBy("task_id", "fold", "method").agg(F.floor(F.avg("test_score") * 10 + 1e-6).alias("value"))
    return ranks.method_ranks(coarse, group=("task_id", "fold")).drop("value")


@query(
    "value_ranks_all_rows",
    """with r as (select l_returnflag, l_quantity, rank() over (partition by l_returnflag order by l_quantity desc) as first, count(*) over (partition by l_returnflag, l_quantity) as n from lineitem)
    select l_returnflag, l_quantity, first + (n-1)/2.0::double as rank, count(*) as n from r group by all""",
)
def _(t: Inputs):
    """Average-tie ranks of raw rows in three large groups (the sliced form)."""
    from tabgauge.functions.ordered import tie_ranks

    ranked = tie_ranks(t.table("lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return ranked.groupBy("l_returnflag", "l_quantity", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("average_ranks", _RANKED + " select method, round(avg(rank), 10) as avg_rank, count(*) as n_tasks from rk group by 1")
def _(t: Inputs):
    return _r(ranks.average_ranks(t.task_method.withColumn("value", F.round("value", 12))), 10, "avg_rank")


_COLLECTION = f"""with {R1}, {SUITES}, v as (
      select 'test_score' as metric, task_id, method, round(avg(test_score), 12) as value from r1 group by all
      union all select 'valid_score', task_id, method, round(avg(valid_score), 12) from r1 group by all),
    rk as (select metric, task_id, method, rank() over (partition by metric, task_id order by value desc)
        + (count(*) over (partition by metric, task_id, value) - 1)/2.0::double as rank from v),
    cr as (select suite, metric, method, avg(rank) as avg_rank, count(*) as n_tasks from rk join suites using (task_id) group by all
      union all select 'all_datasets', metric, method, avg(rank), count(*) from rk group by all)"""


def _collection_ranks(t: Inputs):
    means = t.results.filter("metric <> 'total_walltime'").groupBy("metric", "task_id", "method").agg(F.round(F.avg("value"), 12).alias("value"))
    return ranks.collection_ranks(means, t.suites)


@query("collection_ranks", _COLLECTION + " select suite, metric, method, round(avg_rank, 10) as avg_rank, n_tasks from cr")
def _(t: Inputs):
    return _r(_collection_ranks(t), 10, "avg_rank")


@query(
    "missing_collection_tasks",
    f"""with {R2}, {SUITES}, ok as (select distinct task_id from r2 where test_score is not null)
    select suite, count(*) as n_tasks, count(*) filter (task_id not in (select task_id from ok)) as n_missing from suites group by 1 having count(*) filter (task_id not in (select task_id from ok)) > 0""",
)
def _(t: Inputs):
    means = t.r2.groupBy("task_id", "method").agg(F.avg("test_score").alias("value"))
    return ranks.missing_collection_tasks(means, t.suites)


# ---- trajectories ------------------------------------------------------------------------------------------------------------

_CONFIG = """, c as (select method, task_id, config, round(avg(valid_score), 10) as valid, round(avg(test_score), 10) as test from r1 group by all)"""


def _searches(t: Inputs):
    return t.r1.groupBy("method", "task_id", "config").agg(
        F.round(F.avg("valid_score"), 10).alias("valid"), F.round(F.avg("test_score"), 10).alias("test")
    )


_WALK = """, b as (select *, max(valid) over w as best from {source} window w as (partition by {keys} order by {order} rows unbounded preceding)),
    k as (select *, last_value(case when valid = best then test end ignore nulls) over (partition by {keys} order by {order} rows unbounded preceding) as carried from b)"""


@query(
    "incumbent_trajectory",
    f"with {R1}{_CONFIG}" + _WALK.format(source="c", keys="method, task_id", order="config")
    + " select method, task_id, config, best as best_so_far, carried as test from k",
)
def _(t: Inputs):
    walked = ranks.incumbent_trajectory(_searches(t), ["method", "task_id"], ["config"])
    return walked.select("method", "task_id", "config", "best_so_far", "test")


_SHUFFLED = (
    f"with {R1}{_CONFIG}, s as (select *, case when config = 1 then '' else md5('0:'||rep||':'||config) end as o from c, (select unnest(range(15)) as rep))"
    + _WALK.format(source="s", keys="method, task_id, rep", order="o")
    + ", st as (select *, row_number() over (partition by method, task_id, rep order by o) as step from k)"
)


@query("shuffled_trajectories", _SHUFFLED + " select method, task_id, rep::int as rep, step::int as step, config, best as best_so_far, carried as test from st")
def _(t: Inputs):
    walked = ranks.shuffled_trajectories(_searches(t), ["method", "task_id"])
    return walked.select("method", "task_id", "rep", "step", "config", "best_so_far", "test")


@query(
    "trajectory_band",
    _SHUFFLED + " select method, task_id, step::int as step, round(avg(carried), 10) as mean, min(carried) as low, max(carried) as high from st group by 1, 2, 3",
)
def _(t: Inputs):
    walked = ranks.shuffled_trajectories(_searches(t), ["method", "task_id"])
    return _r(ranks.trajectory_band(walked, ["method", "task_id"]), 10, "mean")


@query(
    "trajectory_table_for_task",
    (f"with {R1}, c as (select method, config, valid_score as valid, test_score as test from r1 where task_id = 4 and fold = 1 and split = 0)"
     + ", s as (select *, case when config = 1 then '' else md5('0:'||rep||':'||config) end as o from c, (select unnest(range(15)) as rep))"
     + _WALK.format(source="s", keys="method, rep", order="o")
     + ", st as (select *, row_number() over (partition by method, rep order by o) as step from k)"
     + " select method, step::int as step, round(avg(carried), 10) as mean, min(carried) as low, max(carried) as high from st group by 1, 2"),
)
def _(t: Inputs):
    """All methods on one task, fold and split: slice, repeat, band."""
    wide = t.r1.filter("task_id = 4 and fold = 1 and split = 0").select(
        "method", "config", F.col("valid_score").alias("valid"), F.col("test_score").alias("test")
    )
    return _r(ranks.trajectory_band(ranks.shuffled_trajectories(wide, ["method"]), ["method"]), 10, "mean")


# ---- rank lines -----------------------------------------------------------------------------------------------------------------

_RANDOM_SETS = _RANKED + """, p as (
      select method, rep, rank, row_number() over w - 1 as size, avg(rank) over (partition by rep, method order by md5('1:'||rep||':'||task_id) rows between unbounded preceding and 1 preceding) as m
      from rk, (select unnest(range(50)) as rep) window w as (partition by rep, method order by md5('1:'||rep||':'||task_id)))"""


@query("ranks_random_sets", _RANDOM_SETS + " select rep::int as rep, method, size, round(m, 10) as mean_rank from p")
def _(t: Inputs):
    table = t.task_method.withColumn("value", F.round("value", 12))
    return _r(ranks.ranks_random_sets(table), 10, "mean_rank")


@query("mean_rank_lines", _RANDOM_SETS + " select method, size, round(avg(m), 10) as mean_rank from p group by 1, 2")
def _(t: Inputs):
    table = t.task_method.withColumn("value", F.round("value", 12))
    return _r(ranks.mean_rank_lines(ranks.ranks_random_sets(table)), 10, "mean_rank")


@query("task_frequency", f"with {SUITES} select task_id, count(distinct suite) as n_suites from suites group by 1")
def _(t: Inputs):
    return ranks.task_frequency(t.suites)


@query(
    "ranks_by_frequency",
    _RANKED + f""", {SUITES}, fq as (select task_id, count(distinct suite) as n from suites group by 1)
    select method, task_id, row_number() over w - 1 as size,
      round(avg(rank) over (partition by method order by n desc, task_id rows between unbounded preceding and 1 preceding), 10) as mean_rank
    from rk join fq using (task_id) window w as (partition by method order by n desc, task_id)""",
)
def _(t: Inputs):
    table = t.task_method.withColumn("value", F.round("value", 12))
    return _r(ranks.ranks_by_frequency(table, t.suites, bounded=False), 10, "mean_rank")


_MEDIANS = f"with {SUITES}, {QUALITY}, md as (select suite, quantile_cont(q1, 0.5) as m from suites join quality using (task_id) group by 1)"


@query("median_task_size", _MEDIANS + " select suite, round(m, 6) as median_size from md")
def _(t: Inputs):
    return _r(ranks.median_task_size(t.suites, t.quality, "q1"), 6, "median_size")


@query(
    "suite_order_by_size",
    _MEDIANS + """ select suite, cast(row_number() over (order by m, suite) as int) as position from md union all select 'all_datasets', 0""",
)
def _(t: Inputs):
    return ranks.order_by_median_size(t.suites, t.quality, "q1")


# ---- correlation and tests -----------------------------------------------------------------------------------------------------------

_SUITE_PAIRS = _COLLECTION + """, q as (select a.suite as suite_a, b.suite as suite_b, a.method, round(a.avg_rank, 9) as a, round(b.avg_rank, 9) as b
      from cr a join cr b on a.method = b.method and a.metric = b.metric where a.metric = 'test_score'),
    tau as (select x.suite_a, x.suite_b, sum(sign(round(x.a-y.a,9))*sign(round(x.b-y.b,9)))/sqrt(sum(abs(sign(round(x.a-y.a,9))))*sum(abs(sign(round(x.b-y.b,9))))) as tau
      from q x join q y on x.suite_a=y.suite_a and x.suite_b=y.suite_b and x.method < y.method group by 1, 2),
    ms as (select suite_a, suite_b, avg((a-b)^2) as mse from q group by 1, 2)"""


@query("suite_similarity", _SUITE_PAIRS + " select suite_a, suite_b, round(mse, 10) as mse, round(tau, 10) as tau from ms left join tau using (suite_a, suite_b)")
def _(t: Inputs):
    return _similar(t)


@query(
    "suite_order_by_similarity",
    _SUITE_PAIRS.replace("with ", "with recursive ", 1) + """, sim as (select suite_a, suite_b, round(mse, 10) as mse, coalesce(-round(tau, 10), 2) as far
      from ms left join tau using (suite_a, suite_b) where suite_a <> suite_b),
    chain(position, suite, used) as (
      select 0, 'all_datasets', ['all_datasets']
      union all
      select position + 1, nxt, list_append(used, nxt) from (
        select position, used, arg_min(suite_b, row(mse, far, suite_b)) as nxt
        from chain join sim on suite_a = suite where not list_contains(used, suite_b) group by position, used))
    select cast(position as int) as position, suite from chain""",
)
def _(t: Inputs):
    return ranks.chain_order(_similar(t))


def _similar(t: Inputs) -> DataFrame:
    rows = _r(_collection_ranks(t).filter("metric = 'test_score'"), 9, "avg_rank")
    return _r(significance.suite_similarity(rows), 10, "mse", "tau")


@query(
    "parallel_coordinates",
    _SUITE_PAIRS.replace("with ", "with recursive ", 1) + f""", {QUALITY}, sim as (select suite_a, suite_b, round(mse, 10) as mse, coalesce(-round(tau, 10), 2) as far
      from ms left join tau using (suite_a, suite_b) where suite_a <> suite_b),
    chain(position, suite, used) as (
      select 0, 'all_datasets', ['all_datasets']
      union all
      select position + 1, nxt, list_append(used, nxt) from (
        select position, used, arg_min(suite_b, row(mse, far, suite_b)) as nxt
        from chain join sim on suite_a = suite where not list_contains(used, suite_b) group by position, used)),
    md as (select suite, quantile_cont(q1, 0.5) as m from suites join quality using (task_id) group by 1),
    o as (select 'median' as order_name, cast(row_number() over (order by m, suite) as int) as position, suite from md
      union all select 'median', 0, 'all_datasets' union all select 'similarity', position, suite from chain),
    whole as (select suite, metric from cr c group by suite, metric
      having count(distinct method) filter (avg_rank is not null) = (select count(distinct method) from cr x where x.metric = c.metric)),
    placed as (select order_name, metric, suite, cast(row_number() over (partition by order_name, metric order by position) - 1 as int) as position
      from o join whole using (suite))
    select order_name, position, suite, metric, method, round(avg_rank, 10) as avg_rank from placed join cr using (suite, metric)""",
)
def _(t: Inputs):
    orders = {"median": ranks.order_by_median_size(t.suites, t.quality, "q1"), "similarity": ranks.chain_order(_similar(t))}
    return _r(ranks.parallel_coordinates(_collection_ranks(t), orders), 10, "avg_rank")


@query(
    "suite_distance_user_pair",
    _SUITE_PAIRS + " select suite_a, suite_b, round(avg(abs(a-b)), 10) as mean_abs, max(round(tau, 10)) as tau from q left join tau using (suite_a, suite_b) group by 1, 2",
)
def _(t: Inputs):
    rows = _r(_collection_ranks(t).filter("metric = 'test_score'"), 9, "avg_rank")
    out = significance.suite_similarity(rows, lambda a, b: F.abs(a - b), name="mean_abs")
    return _r(out, 10, "mean_abs", "tau")


@query(
    "kendall_tau_all_rows",
    """with c as (select l_returnflag as g, l_linenumber as x, l_quantity as y, count(*) as n from lineitem group by all),
    p as (select a.g, sum(a.n*b.n) filter (a.x < b.x and a.y < b.y) as con, sum(a.n*b.n) filter (a.x < b.x and a.y > b.y) as dis from c a join c b on a.g = b.g group by 1),
    s as (select g, sum(n) as n, count(distinct x) as kx, count(distinct y) as ky from c group by 1),
    tx as (select g, sum(t*(t-1)/2.0::double) as tx from (select g, x, sum(n) as t from c group by 1, 2) group by 1),
    ty as (select g, sum(t*(t-1)/2.0::double) as ty from (select g, y, sum(n) as t from c group by 1, 2) group by 1)
    select g, n::bigint as n, con::bigint as concordant, dis::bigint as discordant,
      round((con-dis)/sqrt((n*(n-1)/2.0::double-tx)*(n*(n-1)/2.0::double-ty)), 9) as tau_b,
      round(2*(con-dis)::double/(n*n*(least(kx,ky)-1)/least(kx,ky)::double), 9) as tau_c
    from p join s using (g) join tx using (g) join ty using (g)""",
)
def _(t: Inputs):
    """Tau over whole groups of raw rows, without forming the pairs."""
    df = t.table("lineitem").select(F.col("l_returnflag").alias("g"), "l_linenumber", "l_quantity")
    tau = significance.kendall(df, ["g"], "l_linenumber", "l_quantity").drop("z")
    counts = {c: F.col(c).cast("bigint") for c in ("concordant", "discordant")}
    return _r(tau.withColumns(counts), 9, "tau_b", "tau_c")


_HARD = f"""with {TASK_METHOD}, sc as (select task_id, stddev_samp(value)/nullif(max(value)-least(min(value),0.5::double),0) as s from tm group by 1),
    hs as (select task_id, (s - (select min(s) from sc))/((select max(s) from sc) - (select min(s) from sc)) as hardness from sc),
    dim as (select s_suppkey%20 as task_id, min(s_suppkey)+100 as dataset_id from supplier group by 1),
    ages as (select dataset_id, (1980 + dataset_id%7)::int as age from dim where dataset_id%6 <> 0),
    ha as (select task_id, dataset_id, hardness, age from hs join dim using (task_id) join ages using (dataset_id) where hardness is not null)"""


def _ages(t: Inputs):
    did = F.col("dataset_id")
    years = t.task_dim.select("dataset_id", F.when(did % 6 == 0, "n/a").otherwise((1980 + did % 7).cast("string")).alias("year"))
    return hardness.dataset_age(years)


def _hardness_age(t: Inputs):
    hard = hardness.with_dataset_id(hardness.hardness_std(t.task_method), t.task_dim)
    return hardness.hardness_with_age(hard, _ages(t))


@query(
    "hardness_age_tau",
    _HARD + """, p as (select sum(sign(a.age-b.age)*sign(a.hardness-b.hardness)) as diff from ha a join ha b on a.task_id < b.task_id),
    s as (select count(*) as n, least(count(distinct age), count(distinct hardness)) as m from ha)
    select n, round(2*diff/(n*n*(m-1)/m::double), 10) as tau_c from p, s""",
)
def _(t: Inputs):
    return _r(significance.hardness_age_tau(_hardness_age(t)).select("n", "tau_c"), 10, "tau_c")


@query("hardness_age_p_value")
def _(t: Inputs):
    return significance.hardness_age_tau(_hardness_age(t)).select("n", "z", "p_value")


_SIGNED = f"""with {R1}, v as (select task_id*100+fold*10+split as task_id, method, floor(avg(test_score)*100 + 1e-6) as value from r1 group by r1.task_id, fold, split, method),
    d as (select a.method as method_a, b.method as method_b, a.task_id, a.value-b.value as d from v a join v b on a.task_id = b.task_id and a.method < b.method),
    k as (select *, rank() over (partition by method_a, method_b order by abs(d)) + (count(*) over (partition by method_a, method_b, abs(d)) - 1)/2.0::double as rk,
            count(*) over (partition by method_a, method_b, abs(d)) as t from d where d <> 0)"""


def _paired(t: Inputs):
    task = F.col("task_id") * 100 + F.col("fold") * 10 + F.col("split")
    return t.r1.groupBy(task.alias("task_id"), "method").agg(F.floor(F.avg("test_score") * 100 + 1e-6).cast("double").alias("value"))


@query("method_pairs", _SIGNED + " select method_a, method_b, task_id, d from d")
def _(t: Inputs):
    return significance.method_pairs(_paired(t))


@query(
    "signed_rank_sums",
    _SIGNED + """ select method_a, method_b, count(*) as n, sum(case when d > 0 then rk else 0 end)::double as w_plus,
      sum(case when d < 0 then rk else 0 end)::double as w_minus, sum((t*t-1))::double as tie_term from k group by 1, 2""",
)
def _(t: Inputs):
    return significance.signed_rank_sums(_paired(t))


@query(
    "signed_rank_exact_p",
    f"""with recursive {TASK_METHOD}, d as (
      select a.method as method_a, b.method as method_b, round(a.value, 12) - round(b.value, 12) as d from tm a join tm b using (task_id) where a.method < b.method),
    r as (select *, rank() over (partition by method_a, method_b order by abs(d)) as rk from d where d <> 0),
    w as (select method_a, method_b, count(*) as n, coalesce(sum(rk) filter (d > 0), 0) as up, coalesce(sum(rk) filter (d < 0), 0) as down from r group by 1, 2),
    ways(n, c) as (select 0, [1.0::double] union all
      select n + 1, list_transform(range(len(c) + n + 1), lambda i: coalesce(c[i + 1], 0) + case when i > n then coalesce(c[i - n], 0) else 0 end) from ways where n < 25)
    select method_a, method_b, w.n, least(up, down)::double as w, round(least(1, 2 * list_sum(c[1:least(up, down)::int + 1]) / pow(2, w.n)), 12) as p_value
    from w join ways on ways.n = w.n""",
)
def _(t: Inputs):
    """Exact p-values of the pairs of methods over the tasks (20 differences without ties)."""
    sums = significance.signed_rank_sums(t.task_method.withColumn("value", F.round("value", 12)), bounded=True)
    w = F.least("w_plus", "w_minus")
    return sums.select("method_a", "method_b", "n", w.alias("w"), F.round(significance.exact_signed_rank_p(F.col("n"), w), 12).alias("p_value"))


@query("wilcoxon_holm")
def _(t: Inputs):
    return significance.wilcoxon_holm(_paired(t))


@query(
    "friedman",
    _RANKED + """, w as (select * from rk where task_id in (select task_id from rk group by 1 having count(*) = (select count(distinct method) from rk))),
    a as (select method, avg(rank) as r, count(*) as n from w group by 1),
    e as (select coalesce(sum(t*t*t - t), 0)::double as ties from (select count(*)::double as t from w group by task_id, rank)),
    s as (select count(*) as k, max(n) as n, sum(r*r) as s, (select ties from e) as ties from a)
    select k as n_methods, n as n_tasks, round(12*n/(k*(k+1))::double*(s - k*(k+1)*(k+1)/4.0::double)/(1 - ties/(n*k*(k*k-1))), 7) as chi_square,
      round(2.850::double*sqrt(k*(k+1)/(6.0::double*n)), 10) as critical_difference from s""",
)
def _(t: Inputs):
    out = significance.friedman(t.task_method.withColumn("value", F.round("value", 12)))
    return _r(_r(out, 7, "chi_square"), 10, "critical_difference")


@query(
    "mean_ranks_with_spread",
    _RANKED + " select method, round(avg(rank), 10) as mean_rank, round(avg(value), 10) as mean_value, round(stddev_samp(value), 10) as std_value from rk group by 1",
)
def _(t: Inputs):
    out = significance.mean_ranks_with_spread(t.task_method.withColumn("value", F.round("value", 12)))
    return _r(out, 10, "mean_rank", "mean_value", "std_value")


# ---- hardness ---------------------------------------------------------------------------------------------------------------------------


@query(
    "hardness_grin",
    f"""with {TASK_METHOD}, w as (select task_id, {', '.join(f"max(value) filter (method='{m}') as {m}" for m in METHODS)}, max(value) as hi, least(min(value), 0.5::double) as lo from tm group by 1)
    select task_id, round((least(m0, m1)-lo)/(hi-lo) - (greatest(m2, m3)-lo)/(hi-lo), 10) as hardness from w""",
)
def _(t: Inputs):
    out = hardness.hardness_grin(t.task_method, METHODS, ["m0", "m1"], ["m2", "m3"])
    return _r(out.select("task_id", "hardness"), 10, "hardness")


@query("hardness_std", _HARD + " select task_id, round(hardness, 10) as hardness from hs")
def _(t: Inputs):
    return _r(hardness.hardness_std(t.task_method), 10, "hardness")


@query(
    "complete_tasks",
    f"""with {R2}, m as (select task_id, method, avg(test_score) as value from r2 where test_score is not null group by all)
    select task_id, method, round(value, 10) as value from m where task_id in (select task_id from m group by 1 having count(*) = 6)""",
)
def _(t: Inputs):
    facts = results.stack_measures(t.r2, KEYS, ["test_score", "total_walltime"])
    return _r(hardness.complete_tasks(facts, "test_score", METHODS), 10, "value")


@query("dataset_age", _HARD + " select dataset_id, age from ages")
def _(t: Inputs):
    return _ages(t)


@query("hardness_with_age", _HARD + " select task_id, dataset_id, round(hardness, 10) as hardness, age from ha")
def _(t: Inputs):
    return _r(_hardness_age(t), 10, "hardness")


@query(
    "membership_labels",
    f"""with {SUITES}, dim as (select s_suppkey%20 as task_id, min(s_suppkey)+100 as dataset_id from supplier group by 1)
    select s.suite, dim.dataset_id, m.suite is not null as in_collection, case when m.suite is not null then 'in_collection' else 'not_in_collection' end as label
    from dim cross join (select distinct suite from suites join dim using (task_id)) s left join suites m on m.suite = s.suite and m.task_id = dim.task_id""",
)
def _(t: Inputs):
    collections = t.suites.join(t.task_dim.select("task_id", "dataset_id"), "task_id").select("suite", "dataset_id")
    return hardness.membership_labels(t.task_dim, collections)


