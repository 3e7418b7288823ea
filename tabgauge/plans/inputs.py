"""Stand-in inputs derived from the test tables, as DataFrames and as SQL text.

Each view exists twice: a property of :class:`Inputs` and a constant with the CTE of the
same name for the SQL side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabgauge.operators.results import stack_measures
from tabgauge.operators.split import stratified_splits
from tabgauge.schema import ColumnRoles, Dataset

METHODS = [f"m{i}" for i in range(6)]
MEASURES = ["valid_score", "test_score", "total_walltime"]

R1 = """r1 as (
  select 'm'||(l_partkey%6) as method, cast(l_orderkey%4 as int) as fold, cast(l_linenumber%5 as int) as split,
         cast(1+(l_partkey//6)%10 as int) as config, l_suppkey%20 as task_id,
         sum(cast(round(l_discount*100) as bigint))/(10.0::double*count(*)) as valid_score,
         sum(cast(l_quantity as bigint))/(50.0::double*count(*)) as test_score,
         sum(cast(round(l_extendedprice*100) as bigint))/(100.0::double*count(*)) as total_walltime
  from lineitem group by all)"""

R2 = (
    R1
    + """, r2 as (
  select method, fold, split, config, task_id,
         case when task_id = 7 or (method='m2' and task_id%5=0) then null else test_score end as test_score,
         total_walltime
  from r1)"""
)

#: per (task, method): fold mean of the split and config means
TASK_METHOD = (
    R1
    + """, tm as (select task_id, method, avg(test_score) as value from r1 group by 1, 2)"""
)

B1 = """b1 as (
  select l_linestatus as grp, cast(l_returnflag='R' as int) as y, l_discount*10 as p from lineitem)"""

B2 = """b2 as (
  select vec_id, label as y, list_transform(e, lambda x: x/list_sum(e)) as probs
  from (select vec_id, label, list_transform(embedding[1:10], lambda x: exp(cast(x as double))) as e from embeddings))"""

B3 = """b3 as (
  select l.doc_id, d.lang as grp, l.quality as y, (d.n_chars%1000)/1000.0::double as p
  from labels l join documents d using (doc_id))"""

D1 = """d1 as (
  select o_orderkey as row_key, o_orderstatus as y_text,
         case when o_orderkey%11=0 then null else o_totalprice end as price,
         case when o_orderkey%10<8 then null else c_acctbal end as mostly_missing,
         cast(null as double) as all_missing, cast(1.0 as double) as constant_num,
         year(o_orderdate) as year_num, o_orderpriority as prio,
         case when o_orderkey%13=0 then null else c_mktsegment end as segment,
         c_name as high_card
  from orders join customer on o_custkey=c_custkey)"""

D2 = """d2 as (
  select o_orderkey as row_key, f.fold as fold,
         case when o_orderkey%4=f.fold then null
              else cast((row_number() over (partition by f.fold, o_orderkey%4=f.fold, o_orderstatus
                    order by md5('42:'||f.fold||':'||o_orderkey))-1)%5 as int) end as split
  from orders, (select unnest([0,1,2,3]) as fold) f)"""

BASKETS = """baskets as (
  select distinct 's'||l_orderkey as paper, p_brand as dataset
  from lineitem join part on p_partkey=l_partkey)"""

SUITES = """suites as (
  select distinct 'suite'||c_nationkey as suite, o_custkey%20 as task_id
  from orders join customer on o_custkey=c_custkey)"""

QUALITY = """quality as (
  select s_suppkey%20 as task_id, count(*) as n_rows, min(s_acctbal) as q1, max(s_acctbal) as q2,
         cast(1995+min(s_suppkey)%7 as varchar) as year_text
  from supplier group by 1)"""

#: one row per order as a (paper, dataset) use, with the two kinds of id and an invalid flag
USES = """uses as (
  select 'suite'||c_nationkey as paper_key, c_mktsegment||'_'||(o_custkey%40) as dataset_name,
         case when o_orderkey%3=0 or o_orderstatus='P' then null else o_custkey%40 end as dataset_id,
         case when o_orderkey%3=0 and o_orderstatus<>'P' then o_custkey%40 end as dataset_mapping,
         case when o_orderpriority='5-LOW' then 'Regression' else 'Classification' end as task_type,
         case when o_orderstatus='P' then 'INVALID' end as invalid
  from orders join customer on o_custkey=c_custkey)"""

#: trial records with nested metric maps, one per (method, task, fold, split, config) of r1
TRIALS = (
    R1
    + """, trials as (
  select method, task_id, fold, split, config, 1-valid_score as valid_loss, 1-test_score as test_loss,
         total_walltime, valid_score, test_score, (config*7+split)%9=0 as failed
  from r1)"""
)


class Inputs:
    """The test tables of one scale folder and the stand-in views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def r1(self) -> DataFrame:
        """Results, one column per measure; whole-number sums over one division, so both engines agree to the bit."""
        n = F.count(F.lit(1))
        hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
        return (
            self.table("lineitem")
            .groupBy(
                F.concat(F.lit("m"), F.col("l_partkey") % 6).alias("method"),
                (F.col("l_orderkey") % 4).cast("int").alias("fold"),
                (F.col("l_linenumber") % 5).cast("int").alias("split"),
                F.expr("cast(1 + (l_partkey div 6) % 10 as int)").alias("config"),
                (F.col("l_suppkey") % 20).alias("task_id"),
            )
            .agg(
                (hundredths("l_discount") / (10.0 * n)).alias("valid_score"),
                (F.sum(F.col("l_quantity").cast("bigint")) / (50.0 * n)).alias("test_score"),
                (hundredths("l_extendedprice") / (100.0 * n)).alias("total_walltime"),
            )
        )

    @cached_property
    def results(self) -> DataFrame:
        """The long fact table of r1."""
        return stack_measures(self.r1, ["method", "fold", "split", "config", "task_id"], MEASURES)

    @cached_property
    def r2(self) -> DataFrame:
        """Results where one task is missing everywhere and one method misses some tasks."""
        gone = (F.col("task_id") == 7) | ((F.col("method") == "m2") & (F.col("task_id") % 5 == 0))
        return self.r1.select(
            "method", "fold", "split", "config", "task_id",
            F.when(~gone, F.col("test_score")).alias("test_score"), "total_walltime",
        )

    @cached_property
    def task_method(self) -> DataFrame:
        return self.r1.groupBy("task_id", "method").agg(F.avg("test_score").alias("value"))

    @cached_property
    def task_dim(self) -> DataFrame:
        """``(task_id, dataset_id, dataset_name)`` from the suppliers."""
        return self.table("supplier").groupBy((F.col("s_suppkey") % 20).alias("task_id")).agg(
            (F.min("s_suppkey") + 100).alias("dataset_id"), F.min("s_name").alias("dataset_name")
        )

    @cached_property
    def b1(self) -> DataFrame:
        """Binary predictions with many ties."""
        return self.table("lineitem").select(
            F.col("l_linestatus").alias("grp"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            (F.col("l_discount") * 10).alias("p"),
        ).withColumn("probs", F.array("p"))

    @cached_property
    def b2(self) -> DataFrame:
        """Ten-class predictions."""
        powers = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double")))
        e = self.table("embeddings").select("vec_id", F.col("label").alias("y"), powers.alias("e"))
        total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
        return e.select("vec_id", "y", F.transform("e", lambda x: x / total).alias("probs"))

    @cached_property
    def b3(self) -> DataFrame:
        """Unbalanced binary labels with fine-grained scores."""
        return (
            self.table("labels")
            .join(self.table("documents").select("doc_id", "lang", "n_chars"), "doc_id")
            .select("doc_id", F.col("lang").alias("grp"), F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"))
            .withColumn("probs", F.array("p"))
        )

    @cached_property
    def d1_raw(self) -> DataFrame:
        key = F.col("o_orderkey")
        customers = self.table("customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("row_key"),
            F.col("o_orderstatus").alias("y_text"),
            F.when(key % 11 != 0, F.col("o_totalprice")).alias("price"),
            F.when(key % 10 >= 8, F.col("c_acctbal")).alias("mostly_missing"),
            F.lit(None).cast("double").alias("all_missing"),
            F.lit(1.0).alias("constant_num"),
            F.year("o_orderdate").alias("year_num"),
            F.col("o_orderpriority").alias("prio"),
            F.when(key % 13 != 0, F.col("c_mktsegment")).alias("segment"),
            F.col("c_name").alias("high_card"),
        )

    @cached_property
    def d1(self) -> Dataset:
        """Feature table with roles and injected missing values."""
        numerical = ("price", "mostly_missing", "all_missing", "constant_num", "year_num")
        categorical = ("prio", "segment", "high_card")
        return Dataset(self.d1_raw, ColumnRoles("row_key", "y_text", categorical, numerical, numerical + categorical))

    @cached_property
    def d2(self) -> DataFrame:
        """Splits of the orders."""
        return stratified_splits(self.table("orders"), "o_orderkey", "o_orderstatus", F.col("o_orderkey") % 4)

    @cached_property
    def baskets(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", "p_brand")
        return (
            self.table("lineitem").select("l_orderkey", "l_partkey")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.concat(F.lit("s"), "l_orderkey").alias("paper"), F.col("p_brand").alias("dataset"))
            .distinct()
        )

    @cached_property
    def suites(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            self.table("orders").select("o_custkey")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.concat(F.lit("suite"), "c_nationkey").alias("suite"), (F.col("o_custkey") % 20).alias("task_id"))
            .distinct()
        )

    @cached_property
    def quality(self) -> DataFrame:
        return self.table("supplier").groupBy((F.col("s_suppkey") % 20).alias("task_id")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("s_acctbal").alias("q1"),
            F.max("s_acctbal").alias("q2"),
            (1995 + F.min("s_suppkey") % 7).cast("string").alias("year_text"),
        )

    @cached_property
    def uses(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        third, pending = F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") == "P"
        number = F.col("o_custkey") % 40
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("suite"), "c_nationkey").alias("paper_key"),
            F.concat("c_mktsegment", F.lit("_"), number).alias("dataset_name"),
            F.when(~(third | pending), number).alias("dataset_id"),
            F.when(third & ~pending, number).alias("dataset_mapping"),
            F.when(F.col("o_orderpriority") == "5-LOW", "Regression").otherwise("Classification").alias("task_type"),
            F.when(pending, "INVALID").alias("invalid"),
        )

    @cached_property
    def trials(self) -> DataFrame:
        """Trial records with metric maps."""
        named = lambda c: F.create_map(F.lit("score"), F.col(c))
        return self.r1.select(
            "method", "task_id", "fold", "split", "config",
            F.lit(None).cast("double").alias("train_loss"),
            (1 - F.col("valid_score")).alias("valid_loss"),
            (1 - F.col("test_score")).alias("test_loss"),
            *[F.lit(None).cast("double").alias(c) for c in _TIME_COLUMNS],
            "total_walltime",
            F.create_map(F.lit("id"), F.col("config").cast("string")).alias("config_values"),
            F.lit(None).cast("map<string,double>").alias("train_metrics"),
            named("valid_score").alias("valid_metrics"),
            named("test_score").alias("test_metrics"),
            F.when((F.col("config") * 7 + F.col("split")) % 9 == 0, "timeout").alias("error"),
        )


_TIME_COLUMNS = [
    "average_split_fit_time",
    "average_split_predict_time",
    "average_split_predict_time_valid",
    "average_split_predict_time_test",
    "average_split_preprocess_time_train",
    "average_split_preprocess_time_valid",
    "average_split_preprocess_time_test",
]
