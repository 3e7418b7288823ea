"""Suite and bibliography queries: use counts, set checks, co-use, suite tables, table text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgauge.functions.scalars import quality_column_name
from tabgauge.operators import suites
from tabgauge.plans.inputs import BASKETS, QUALITY, SUITES, USES, Inputs
from tabgauge.plans.registry import query
from tabgauge.sources import tables

SUITE_PAPERS = ["suite3", "suite17"]

_CLASSIFIED = USES + """, k as (
      select *, case when task_type='Regression' then 'regression' when paper_key in ('suite3','suite17') then 'suite'
                     when invalid='INVALID' then 'invalid' else 'dataset' end as use from uses),
    c as (select *, case when use in ('regression','invalid') then dataset_name when use='suite' then dataset_id::varchar
                     else coalesce(dataset_id, dataset_mapping)::varchar end as dataset_key from k)"""

_COUNTS = _CLASSIFIED + """, n as (
      select dataset_key, use='dataset' as available, count(*) as n,
             array_to_string(list_sort(list(distinct case when use='invalid' then dataset_name else lower(dataset_name) end)), ',') as names
      from c where use in ('invalid','dataset') group by 1, 2)"""


def _text_names(df):
    return df.withColumn("names", F.concat_ws(",", "names"))


@query("classify_uses", f"with {_CLASSIFIED} select use, dataset_key, count(*) as n from c group by 1, 2")
def _(t: Inputs):
    return suites.classify_uses(t.uses, SUITE_PAPERS).groupBy("use", "dataset_key").agg(F.count(F.lit(1)).alias("n"))


@query("use_counts", f"with {_COUNTS} select dataset_key, available, n as count, names from n")
def _(t: Inputs):
    return _text_names(suites.use_counts(t.uses, SUITE_PAPERS))


@query(
    "use_counts_with_catalogue",
    f"""with {USES} select coalesce(dataset_id, dataset_mapping)::varchar as dataset_key, true as available, count(*) as count,
      array_to_string(list_sort(list(distinct lower(case when dataset_id is null then s_name else dataset_name end))), ',') as names
    from uses left join supplier on s_suppkey = coalesce(dataset_id, dataset_mapping) where task_type <> 'Regression' and invalid is null group by 1""",
)
def _(t: Inputs):
    catalogue = t.table("supplier").select(F.col("s_suppkey").alias("dataset_id"), F.col("s_name").alias("name"))
    unnamed = t.uses.filter("invalid is null").withColumn("dataset_name", F.when(F.col("dataset_id").isNotNull(), F.col("dataset_name")))
    return _text_names(suites.use_counts(unnamed, (), catalogue))


@query(
    "ambiguous_uses",
    f"""with {USES} select paper_key, dataset_name, count(*) as n from uses
    where task_type <> 'Regression' and invalid is null and dataset_id is not null and dataset_id = 12 group by 1, 2""",
)
def _(t: Inputs):
    # give the uses of one dataset a second identity: exactly those must be reported
    doubled = t.uses.withColumn("dataset_mapping", F.when(F.col("dataset_id") == 12, F.lit(1)).otherwise(F.col("dataset_mapping")))
    return suites.ambiguous_uses(doubled).groupBy("paper_key", "dataset_name").agg(F.count(F.lit(1)).alias("n"))


@query("regression_counts", f"with {USES} select dataset_name, count(*) as count from uses where task_type='Regression' group by 1")
def _(t: Inputs):
    return suites.regression_counts(t.uses)


@query(
    "use_counts_with_year",
    f"""with {_COUNTS}, ages as (select s_suppkey as dataset_id, 1980 + s_suppkey % 37 as year from supplier where s_suppkey % 4 <> 0)
    select dataset_key, n as count, year::bigint as creation from n left join ages on dataset_id::varchar = dataset_key""",
)
def _(t: Inputs):
    ages = t.table("supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("dataset_id"), (1980 + F.col("s_suppkey") % 37).alias("year"))
    return suites.with_creation_year(suites.use_counts(t.uses, SUITE_PAPERS), ages).select("dataset_key", "count", "creation")


@query("most_used_datasets", f"with {_COUNTS} select dataset_key, n as count, available from n order by n desc, dataset_key limit 20")
def _(t: Inputs):
    return suites.most_used(suites.use_counts(t.uses, SUITE_PAPERS)).select("dataset_key", "count", "available")


# ---- set checks -------------------------------------------------------------------------------------------


@query(
    "missing_members",
    f"""with {SUITES} select 'in suites only' as side, task_id from suites where task_id not in (select s_suppkey%15 from supplier) group by all
    union all select 'known only', s_suppkey%15+3 from supplier where s_suppkey%15+3 not in (select task_id from suites where task_id < 16) group by all""",
)
def _(t: Inputs):
    known = t.table("supplier").select((F.col("s_suppkey") % 15).alias("task_id"))
    shifted = known.select((F.col("task_id") + 3).alias("task_id"))
    some = t.suites.filter("task_id < 16").select("task_id")
    first = suites.missing_members(t.suites, known).select(F.lit("in suites only").alias("side"), "task_id")
    return first.unionByName(suites.only_in_first(shifted, some).select(F.lit("known only").alias("side"), "task_id"))


@query(
    "symmetric_difference",
    """with a as (select distinct p_name from part where p_size < 8), b as (select distinct p_name from part where p_size > 45)
    select p_name from a where p_name not in (select p_name from b) union all select p_name from b where p_name not in (select p_name from a)""",
)
def _(t: Inputs):
    part = t.table("part")
    return suites.symmetric_difference(part.filter("p_size < 8").select("p_name"), part.filter("p_size > 45").select("p_name"))


@query("all_members", f"with {SUITES} select distinct task_id from suites")
def _(t: Inputs):
    return suites.all_members(t.suites)


@query(
    "unique_tasks",
    f"""with {SUITES}, k as (select task_id, task_id//2 as dataset_id, n_rows, 3 + task_id%5 as n_cols, task_id%3 as n_symbolic from ({'with ' + QUALITY + ' select * from quality'}) q),
    j as (select *, row_number() over (partition by dataset_id order by suite, task_id) as rn from suites join k using (task_id))
    select task_id, dataset_id, n_rows*n_cols as n_cells, case when n_symbolic > 1 then 'categorical' else 'numeric' end as kind from j where rn = 1""",
)
def _(t: Inputs):
    tasks = t.quality.select(
        "task_id", F.expr("task_id div 2").alias("dataset_id"), "n_rows", (3 + F.col("task_id") % 5).alias("n_cols"), (F.col("task_id") % 3).alias("n_symbolic")
    )
    return suites.unique_tasks(t.suites, tasks)


# ---- co-use -----------------------------------------------------------------------------------------------------

_SETS = f"""with {BASKETS},
    s2 as (select 2 as size, a.dataset||'|'||b.dataset as items, count(*) as n_papers from baskets a join baskets b on a.paper=b.paper and a.dataset<b.dataset group by 2),
    s3 as (select 3, a.dataset||'|'||b.dataset||'|'||c.dataset as items, count(*) from baskets a join baskets b on a.paper=b.paper and a.dataset<b.dataset
      join baskets c on a.paper=c.paper and b.dataset<c.dataset group by 2),
    s4 as (select 4, a.dataset||'|'||b.dataset||'|'||c.dataset||'|'||d.dataset as items, count(*) from baskets a join baskets b on a.paper=b.paper and a.dataset<b.dataset
      join baskets c on a.paper=c.paper and b.dataset<c.dataset join baskets d on a.paper=d.paper and c.dataset<d.dataset group by 2),
    s5 as (select 5, a.dataset||'|'||b.dataset||'|'||c.dataset||'|'||d.dataset||'|'||e.dataset as items, count(*) from baskets a join baskets b on a.paper=b.paper and a.dataset<b.dataset
      join baskets c on a.paper=c.paper and b.dataset<c.dataset join baskets d on a.paper=d.paper and c.dataset<d.dataset join baskets e on a.paper=e.paper and d.dataset<e.dataset group by 2),
    sets as (select * from (select * from s2 union all select * from s3 union all select * from s4 union all select * from s5) where n_papers >= 2)"""


@query("co_used_sets", _SETS + " select size::int as size, items, n_papers from sets")
def _(t: Inputs):
    sets = suites.co_used_sets(t.baskets, "paper", "dataset")
    return sets.withColumn("items", F.concat_ws("|", "items")).withColumn("n_papers", F.col("n_papers").cast("bigint"))


@query(
    "co_use_support_table",
    _SETS + " select size::int as size, " + ", ".join(f"count(*) filter (n_papers >= {j}) as support_{j}" for j in range(2, 7)) + " from sets group by 1",
)
def _(t: Inputs):
    return suites.support_table(suites.co_used_sets(t.baskets, "paper", "dataset"))


@query(
    "top_co_used_sets",
    _SETS + """, r as (select *, row_number() over (partition by size order by n_papers desc, items) as rn, max(n_papers) over (partition by size) as best from sets)
    select size::int as size, items, n_papers from r where rn <= 20 and n_papers = best""",
)
def _(t: Inputs):
    top = suites.top_sets(suites.co_used_sets(t.baskets, "paper", "dataset"))
    return top.select("size", F.concat_ws("|", "items").alias("items"), F.col("n_papers").cast("bigint").alias("n_papers"))


@query(
    "papers_of_top_pair",
    f"""with {BASKETS}, p as (select a.dataset as x, b.dataset as y, count(*) as n from baskets a join baskets b on a.paper=b.paper and a.dataset<b.dataset group by 1, 2),
    top as (select * from p where n = (select max(n) from p) order by x, y limit 20)
    select x||'|'||y as items, a.paper from top join baskets a on a.dataset = x join baskets b on b.dataset = y and a.paper = b.paper""",
)
def _(t: Inputs):
    top = suites.top_sets(suites.co_used_sets(t.baskets, "paper", "dataset", max_size=2))
    return suites.papers_of_sets(t.baskets, "paper", "dataset", top).select(F.concat_ws("|", "items").alias("items"), "paper")


# ---- suite tables ---------------------------------------------------------------------------------------------------

_QUALITY_COLUMNS = ["NumberOfInstances", "NumberOfFeatures"]
_LABELS = {0.5: "median", 0.75: "q3", 0.25: "q1"}


@query(
    "collection_metadata",
    f"""with {SUITES}, {QUALITY}, m as (select suite, q1 as "NumberOfInstances", q2 as "NumberOfFeatures", task_id%3 as s from suites join quality using (task_id))
    select suite, """
    + ", ".join(f'round(quantile_cont("{c}", {p}), 6) as "{quality_column_name(label, c)}"' for p, label in _LABELS.items() for c in _QUALITY_COLUMNS)
    + ", count(*) as number_of_datasets, count(*) filter (s <= 1) as number_of_numerical_datasets, count(*) filter (s > 1) as number_of_categorical_datasets from m group by 1",
)
def _(t: Inputs):
    qualities = t.quality.select(
        "task_id", F.col("q1").alias("NumberOfInstances"), F.col("q2").alias("NumberOfFeatures"), (F.col("task_id") % 3).alias("NumberOfSymbolicFeatures")
    )
    out = suites.collection_metadata(t.suites, qualities, _QUALITY_COLUMNS)
    named = [quality_column_name(label, c) for label in _LABELS.values() for c in _QUALITY_COLUMNS]
    return out.withColumns({c: F.round(c, 6) for c in named})


_PUBLISHED = """published as (
      select 'suite'||n_nationkey as paper_key, case n_nationkey%5 when 0 then 'Suite' when 1 then 'Data' when 2 then 'Comp' else 'New' end as type,
             case when n_nationkey%2=0 then n_name end as method, n_nationkey*2 as stated_classification, n_nationkey as stated_regression, n_nationkey%4 as stated_other from nation),
    unused as (select distinct dataset_name from uses where invalid = 'INVALID' and paper_key < 'suite2')"""

_SUMMARY = f"""with {USES}, {_PUBLISHED}, n as (
      select paper_key, count(*) filter (task_type='Classification') as nc, count(*) filter (task_type='Regression') as nr,
             count(distinct dataset_name) filter (task_type='Classification' and invalid='INVALID' and dataset_name in (select dataset_name from unused)) as nu,
             count(distinct coalesce(dataset_id, dataset_mapping)) filter (task_type='Classification' and invalid is null) as nd from uses group by 1),
    s as (select paper_key, type, coalesce(method, '-') as method, case when type='Data' then 0 else coalesce(nc,0) end as classification,
             case when type='Data' then 0 else coalesce(nr,0) end as regression, case when type='Data' then 0 else coalesce(nu,0) end as invalid_classification, stated_other as other,
             coalesce(nd,0)+coalesce(nu,0)-stated_classification as classification_gap, coalesce(nr,0)-stated_regression as regression_gap
          from published left join n using (paper_key) where type <> 'Suite')"""


def _summary(t: Inputs):
    key = F.col("n_nationkey")
    published = t.table("nation").select(
        F.concat(F.lit("suite"), key).alias("paper_key"),
        F.when(key % 5 == 0, "Suite").when(key % 5 == 1, "Data").when(key % 5 == 2, "Comp").otherwise("New").alias("type"),
        F.when(key % 2 == 0, F.col("n_name")).alias("method"),
        (key * 2).alias("stated_classification"), key.alias("stated_regression"), (key % 4).alias("stated_other"),
    )
    unused = t.uses.filter("invalid = 'INVALID' and paper_key < 'suite2'").select("dataset_name")
    return suites.suite_summary(t.uses, unused, published)


@query("suite_summary", _SUMMARY + " select * from s")
def _(t: Inputs):
    return _summary(t)


@query(
    "suite_summary_averages",
    _SUMMARY + """ select 'Mean' as row, round(avg(classification),8) as classification, round(avg(regression),8) as regression, round(avg(other),8) as other from s where type <> 'Data'
    union all select 'Median', median(classification), median(regression), median(other) from s where type <> 'Data'""",
)
def _(t: Inputs):
    columns = ["classification", "regression", "other"]
    return suites.summary_averages(_summary(t), columns).withColumns({c: F.round(c, 8) for c in columns})


@query(
    "suite_statistics",
    f"""with {SUITES}, k as (select s_suppkey%20 as task_id, count(*) as n_rows, min(s_nationkey) as major from supplier group by 1),
    f as (select suite, task_id, 1 + task_id%3 as n_symbolic, task_id%4 as n_numeric, case when task_id=6 then null else 2 + task_id%2 end as n_classes,
            case when task_id=9 then null else major end as major, n_rows from suites join k using (task_id)),
    s as (select suite, count(*) filter (n_symbolic=1) as numeric, count(*) filter (n_symbolic<>1 and n_numeric=0) as categorical,
      count(*) filter (n_symbolic<>1 and n_numeric<>0) as mixed, count(*) filter (n_classes=2) as binary, count(*) filter (n_classes<>2) as multiclass,
      round(avg(major::double/n_rows), 8) as balancedness from f group by 1)
    select *, round(numeric::double/nullif(categorical+mixed,0), 8) as ratio from s""",
)
def _(t: Inputs):
    task = F.col("task_id")
    tasks = t.table("supplier").groupBy((F.col("s_suppkey") % 20).alias("task_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("s_nationkey").alias("major")
    )
    facts = tasks.select(
        "task_id", "n_rows", (1 + task % 3).alias("n_symbolic"), (task % 4).alias("n_numeric"),
        F.when(task != 6, 2 + task % 2).alias("n_classes"), F.when(task != 9, F.col("major")).alias("majority_size"),
    )
    return suites.suite_statistics(t.suites, facts).withColumns({c: F.round(c, 8) for c in ("balancedness", "ratio")})


# ---- table text ----------------------------------------------------------------------------------------------------------


@query(
    "table_text",
    f"""with {_COUNTS}, top as (select dataset_key, n, names from n order by n desc, dataset_key limit 20)
    select 'latex' as format, dataset_key||' & '||n||' & '||names||' \\\\' as line from top
    union all select 'markdown', '| '||dataset_key||' | '||n||' | '||names||' |' from top
    union all select 'html', '<tr><td>'||dataset_key||'</td><td>'||n||'</td><td>'||names||'</td></tr>' from top""",
)
def _(t: Inputs):
    top = _text_names(suites.most_used(suites.use_counts(t.uses, SUITE_PAPERS)))
    lines = [
        tables.table_text(top, ["dataset_key", "count", "names"], f).select(F.lit(f).alias("format"), "line")
        for f in ("latex", "markdown", "html")
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])
