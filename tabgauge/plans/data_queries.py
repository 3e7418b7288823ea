"""Profiling, cleaning, splitting and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgauge.functions import scalars as X
from tabgauge.functions.digest import order_key, uniform
from tabgauge.operators import clean, encode, profile, split
from tabgauge.plans.inputs import BASKETS, D1, D2, Inputs
from tabgauge.plans.registry import query
from tabgauge.sources import tables
from tabgauge.sources.datasets import load_dataset

# ---- load and profile ---------------------------------------------------------------------------


@query(
    "load_dataset",
    """select o_orderkey, o_custkey, o_totalprice, o_orderpriority,
         cast(dense_rank() over (order by o_orderstatus) - 1 as int) as o_orderstatus
       from orders""",
)
def _(t: Inputs):
    columns = ["o_custkey", "o_totalprice", "o_orderpriority"]
    return load_dataset(t.spark, f"{t.sf_dir}/orders.parquet", "o_orderkey", "o_orderstatus", columns=columns).df


@query(
    "infer_column_roles",
    """select column_name as "column", column_type in ('VARCHAR', 'BOOLEAN') or column_name = 'l_linenumber' as is_categorical
       from (describe select * exclude (l_orderkey, l_returnflag) from lineitem)
       where (select count(*) from lineitem) > 0""",
)
def _(t: Inputs):
    df = t.table("lineitem")
    roles = profile.infer_roles(df, "l_orderkey", "l_returnflag", known_categorical=["l_linenumber"])
    flags = F.map_from_arrays(F.array(*map(F.lit, roles.features)), F.array(*map(F.lit, roles.indicator)))
    present = df.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return present.select(F.explode(flags).alias("column", "is_categorical"))


@query(
    "target_profile",
    f"""with {D1}
    select count(distinct y_text)::int as n_classes, case when count(distinct y_text) > 2 then count(distinct y_text) else 1 end::int as output_shape,
           case when count(distinct y_text) > 2 then 'multiclass' else 'binary' end as output_type
    from d1""",
)
def _(t: Inputs):
    return profile.target_profile(t.d1_raw, "y_text")


@query(
    "category_counts",
    f"""with {D1}
    select 'prio' as "column", count(distinct prio) as n_categories from d1
    union all select 'segment', count(distinct segment) from d1
    union all select 'high_card', count(distinct high_card) from d1""",
)
def _(t: Inputs):
    return profile.category_counts(t.d1.df, t.d1.roles)


@query(
    "all_missing_columns",
    f"""with {D1}
    select 2::int as position, 'all_missing' as "column" from d1 having count(all_missing) = 0""",
)
def _(t: Inputs):
    return profile.all_missing_columns(t.d1.df, t.d1.roles)


@query(
    "missing_shares",
    f"""with {D1}, s as (
      select avg((price is null)::int) as price, avg((mostly_missing is null)::int) as mostly_missing,
             avg((all_missing is null)::int) as all_missing, avg((constant_num is null)::int) as constant_num,
             avg((year_num is null)::int) as year_num, avg((prio is null)::int) as prio,
             avg((segment is null)::int) as segment, avg((high_card is null)::int) as high_card from d1)
    select name as "column", round(value, 9) as missing_share from (unpivot s on columns(*) into name name value value)""",
)
def _(t: Inputs):
    return profile.missing_shares(t.d1.df, t.d1.roles).withColumn("missing_share", F.round("missing_share", 9))


@query(
    "dataset_properties",
    f"""with {D1}
    select 'multiclass' as output_type, 'tabular_classification' as task_type, count(distinct y_text)::int as n_classes,
           count(distinct y_text)::int as output_shape,
           'price,mostly_missing,all_missing,constant_num,year_num,prio,segment,high_card' as feature_names,
           'prio,segment,high_card' as categorical_columns,
           'price,mostly_missing,all_missing,constant_num,year_num' as numerical_columns,
           'false,false,false,false,false,true,true,true' as categorical_indicator,
           count(distinct prio)||','||count(distinct segment)||','||count(distinct high_card) as n_categories_per_cat_col,
           '2' as all_nan_col_idx
    from d1""",
)
def _(t: Inputs):
    row = profile.dataset_properties(t.d1)
    lists = [c for c, kind in row.dtypes if kind.startswith("array")]
    return row.withColumns({c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))) for c in lists})


@query(
    "profile_after_encoding",
    f"""with {D1}, e as (
      select dense_rank() over (order by prio) - 1 as prio, coalesce(price, 0) as price from d1 where segment is not null)
    select 'price' as "column", count(distinct price) as n_values, count(price) as n_present, false as is_categorical from e
    union all select 'prio', count(distinct prio), count(prio), true from e""",
)
def _(t: Inputs):
    rows = t.d1_raw.filter("segment is not null").select("row_key", "y_text", F.coalesce("price", F.lit(0.0)).alias("price"), "prio")
    encoded = encode.OrdinalEncoder(("prio",)).fit(rows).transform(rows)
    roles = profile.infer_roles(encoded, "row_key", "y_text", known_categorical=["prio"])
    counts = encoded.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.count_distinct(c).alias("n_values"), F.count(c).alias("n_present"),
                    F.lit(c in roles.categorical).alias("is_categorical"),
                )
                for c in roles.features
            ]
        ).alias("r")
    )
    return counts.select(F.inline("r"))


@query(
    "cast_features",
    """select o_orderkey as row_key, cast(year(o_orderdate) as varchar) as year_text, o_totalprice as price, cast(null as double) as empty from orders""",
)
def _(t: Inputs):
    raw = t.table("orders").select(
        F.col("o_orderkey").alias("row_key"), F.year("o_orderdate").alias("year_text"), F.col("o_totalprice").alias("price"),
        F.lit(None).cast("int").alias("empty"), F.col("o_orderstatus").alias("y"),
    )
    roles = profile.infer_roles(raw, "row_key", "y", known_categorical=["year_text"])
    return profile.match_types(profile.cast_features(raw, roles, all_missing=["empty"]).drop("y"), raw.select(
        "row_key", F.col("year_text").cast("string").alias("year_text"), "price", F.col("empty").cast("double").alias("empty")))


@query(
    "safe_column_names",
    """select l_orderkey as plain, l_quantity as "1", l_discount as "2" from lineitem""",
)
def _(t: Inputs):
    odd = t.table("lineitem").select(
        F.col("l_orderkey").alias("plain"), F.col("l_quantity").alias("qty: [a,b]"), F.col("l_discount").alias('dis"count{}')
    )
    return profile.safe_names(odd)[0]


@query("sparse_to_dense")
def _(t: Inputs):
    from pyspark.ml.feature import OneHotEncoder

    codes = t.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("line"))
    sparse = OneHotEncoder(inputCol="line", outputCol="vector", dropLast=False).fit(codes).transform(codes)
    dense = profile.densify(sparse)
    return dense.groupBy(F.array_position("vector", F.lit(1.0)).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "presence_mask",
    f"""with {D1}
    select row_key, (price is not null)::int as price, (mostly_missing is not null)::int as mostly_missing,
           (all_missing is not null)::int as all_missing, (constant_num is not null)::int as constant_num,
           (year_num is not null)::int as year_num, (prio is not null)::int as prio, (segment is not null)::int as segment,
           (high_card is not null)::int as high_card from d1""",
)
def _(t: Inputs):
    return profile.presence_mask(t.d1.df, t.d1.roles)


# ---- manipulators ------------------------------------------------------------------------------------


@query(
    "remove_high_cardinality",
    f"""with {D1}
    select row_key, price, mostly_missing, all_missing, constant_num, year_num::int as year_num, prio, segment, y_text from d1
    where (select count(distinct high_card) from d1) > 20""",
)
def _(t: Inputs):
    return clean.remove_high_cardinality(t.d1).df


@query(
    "remove_pseudo_categorical",
    f"""with {D1} select row_key, price, mostly_missing, prio, segment, high_card, y_text from d1""",
)
def _(t: Inputs):
    return clean.remove_pseudo_categorical(t.d1).df


@query(
    "remove_rows_with_missing_values",
    f"""with {D1} select row_key, price, segment, y_text from d1 where price is not null and segment is not null""",
)
def _(t: Inputs):
    small = t.d1.with_df(t.d1.df, t.d1.roles.keep(["price", "segment"]))
    return clean.remove_rows_with_missing_values(small).df


@query(
    "remove_missing_values",
    f"""with {D1} select row_key, price, constant_num, year_num::int as year_num, prio, segment, high_card, y_text
    from d1 where price is not null and segment is not null""",
)
def _(t: Inputs):
    return clean.remove_missing_values(t.d1).df


@query(
    "balance_binarize",
    f"""with {D1}, c as (
      select y_text, count(*) as n, row_number() over (order by count(*) desc, y_text desc) as place from d1 group by 1),
    r as (select d1.*, place, row_number() over (partition by y_text order by md5('0:'||row_key)) as rn
          from d1 join c using (y_text) where place <= 2)
    select row_key, price, segment, cast(place - 1 as int) as y_text from r
    where rn <= (select n from c where place = 2)""",
)
def _(t: Inputs):
    return clean.balance_binarize(t.d1.with_df(t.d1.df, t.d1.roles.keep(["price", "segment"]))).df


@query(
    "subsample_rows",
    f"""with {D1} select row_key, price, prio, y_text from d1 order by md5('0:'||row_key) limit 5000""",
)
def _(t: Inputs):
    return clean.subsample_rows(t.d1.with_df(t.d1.df, t.d1.roles.keep(["price", "prio"])), threshold=5000).df


@query(
    "subsample_columns",
    f"""with {D1}, cols as (
      select name, row_number() over (order by md5('0:'||name)) as place
      from (values ('price'),('mostly_missing'),('all_missing'),('constant_num'),('year_num'),('prio'),('segment'),('high_card')) v(name))
    select name as "column",
           sum(case name when 'price' then (price is not null)::int when 'mostly_missing' then (mostly_missing is not null)::int
             when 'all_missing' then (all_missing is not null)::int when 'constant_num' then (constant_num is not null)::int
             when 'year_num' then (year_num is not null)::int when 'prio' then (prio is not null)::int
             when 'segment' then (segment is not null)::int else (high_card is not null)::int end)::bigint as n_present
    from d1, cols where place <= 3 group by 1""",
)
def _(t: Inputs):
    kept = clean.subsample_columns(t.d1, threshold=3)
    counts = kept.df.agg(*[F.count(c).alias(c) for c in kept.roles.features])
    return counts.unpivot([], kept.roles.features, "column", "n_present")


@query(
    "manipulator_chain",
    f"""with {D1}
    select row_key, price, prio, segment, y_text from d1 where price is not null and segment is not null
    order by md5('0:'||row_key) limit 2000""",
)
def _(t: Inputs):
    names = ["remove_high_cardinality", "remove_pseudo_categorical", "remove_missing_values", "subsample_rows"]
    return clean.manipulate(t.d1, names, remove_missing_values__threshold=0.5, subsample_rows__threshold=2000).df


@query(
    "merge_rare_classes",
    """with c as (select p_name, count(*) as n from part group by 1)
    select p_partkey, case when n < 0.015 * (select count(*) from part) then 'others' else p_name end as p_name
    from part join c using (p_name)""",
)
def _(t: Inputs):
    return clean.merge_rare_classes(t.table("part").select("p_partkey", "p_name"), "p_name", share=0.015)


# ---- splits ---------------------------------------------------------------------------------------------


@query("stratified_splits", f"""with {D2} select row_key, fold, split from d2""")
def _(t: Inputs):
    return t.d2


@query(
    "stratified_holdout",
    """with r as (
      select o_orderkey as row_key, count(*) over (partition by o_orderstatus) as n,
             row_number() over (partition by o_orderstatus order by md5('42:'||o_orderkey)) as rn from orders)
    select row_key, case when rn <= round(0.8::double * n) then 'train' else 'valid' end as part from r""",
)
def _(t: Inputs):
    return split.stratified_holdout(t.table("orders"), "o_orderkey", "o_orderstatus")


@query(
    "split_parts",
    f"""with {D2} select row_key, case when split is null then 'test' when split = 2 then 'valid' else 'train' end as part
    from d2 where fold = 1""",
)
def _(t: Inputs):
    return split.split_parts(t.d2, 1, 2)


@query(
    "fold_parts",
    f"""with {D2} select row_key, case when split is null then 'test' else 'train' end as part from d2 where fold = 3""",
)
def _(t: Inputs):
    return split.fold_parts(t.d2, 3)


@query(
    "uncovered_rows",
    """select o_orderkey as row_key, f.fold as fold, case when o_orderkey % 500 = 0 and f.fold = 2 then 0 else 2 end::bigint as times
    from orders, (select unnest([0,1,2,3]) as fold) f
    where (o_orderkey % 500 = 0 and f.fold = 2) or (o_orderkey % 700 = 0 and f.fold = 1)""",
)
def _(t: Inputs):
    key = F.col("row_key")
    broken = t.d2.filter(~((key % 500 == 0) & (F.col("fold") == 2)))
    doubled = broken.unionByName(broken.filter((key % 700 == 0) & (F.col("fold") == 1)))
    return split.uncovered_rows(t.table("orders"), "o_orderkey", doubled)


@query(
    "wide_splits",
    f"""with {D2} select row_key, max(split) filter (fold=0) as fold_0, max(split) filter (fold=1) as fold_1,
      max(split) filter (fold=2) as fold_2, max(split) filter (fold=3) as fold_3 from d2 group by 1""",
)
def _(t: Inputs):
    return split.wide_splits(t.d2, [0, 1, 2, 3])


@query(
    "split_key_lists",
    f"""with {D2}, r as (
      select row_key, fold, s.split as split, case when d2.split is null then 'test' when d2.split = s.split then 'valid' else 'train' end as role
      from d2, (select unnest([0,1,2,3,4]) as split) s)
    select fold, split, role, row_key // 4000 as piece, count(*) as n_keys, min(row_key) as first_key, max(row_key) as last_key,
           md5(string_agg(row_key::varchar, ',' order by row_key)) as digest
    from r group by 1, 2, 3, 4""",
)
def _(t: Inputs):
    lists = tables.split_key_lists(t.d2, key_range=4_000)
    return lists.select(
        "fold", "split", "role", "piece", F.size("keys").cast("bigint").alias("n_keys"), F.array_min("keys").alias("first_key"),
        F.array_max("keys").alias("last_key"), F.md5(F.concat_ws(",", F.transform("keys", lambda k: k.cast("string")))).alias("digest"),
    )


# ---- encoders ----------------------------------------------------------------------------------------------

_TRAIN = "row_key % 4 <> 0"


def _fit(t: Inputs, encoder, columns):
    rows = t.d1_raw.select("row_key", *columns)
    return encoder.fit(rows.filter(_TRAIN)).transform(rows)


_ORDINAL_SQL = """with {d1}, d as (
      select segment, dense_rank() over (order by segment) - 1 as code from (select distinct segment from d1 where row_key % 4 <> 0 and segment is not null)),
    h as (select high_card, dense_rank() over (order by high_card) - 1 as code from (select distinct high_card from d1 where row_key % 4 <> 0))
    select row_key, cast({segment} as int) as segment, cast({high_card} as int) as high_card
    from d1 left join d on d1.segment = d.segment left join h on d1.high_card = h.high_card"""


@query(
    "encode_target",
    f"""with {D1} select row_key, y_text, cast(dense_rank() over (order by y_text) - 1 as int) as y from d1""",
)
def _(t: Inputs):
    return encode.encode_target(t.d1_raw.select("row_key", "y_text"), "y_text")


@query(
    "ordinal_encode",
    _ORDINAL_SQL.format(d1=D1, segment="case when d1.segment is null then -2 else coalesce(d.code, -1) end", high_card="coalesce(h.code, -1)"),
)
def _(t: Inputs):
    return _fit(t, encode.OrdinalEncoder(("segment", "high_card")), ["segment", "high_card"])


@query(
    "ordinal_encode_keep_missing",
    _ORDINAL_SQL.format(d1=D1, segment="case when d1.segment is null then null else coalesce(d.code, -1) end", high_card="coalesce(h.code, -1)"),
)
def _(t: Inputs):
    return _fit(t, encode.OrdinalEncoder(("segment", "high_card"), missing=None), ["segment", "high_card"])


@query(
    "ordinal_encode_shifted",
    _ORDINAL_SQL.format(d1=D1, segment="case when d1.segment is null then -1 else coalesce(d.code, -1) end + 1", high_card="coalesce(h.code, -1) + 1"),
)
def _(t: Inputs):
    return _fit(t, encode.OrdinalEncoder(("segment", "high_card"), missing=-1, shift=1), ["segment", "high_card"])


@query(
    "one_hot_encode",
    f"""with {D1}
    select row_key, coalesce((segment='AUTOMOBILE')::int,0) as "segment_AUTOMOBILE", coalesce((segment='BUILDING')::int,0) as "segment_BUILDING",
      coalesce((segment='FURNITURE')::int,0) as "segment_FURNITURE", coalesce((segment='HOUSEHOLD')::int,0) as "segment_HOUSEHOLD"
    from d1""",
)
def _(t: Inputs):
    # one segment is kept out of the training rows, so it encodes as all zeros
    rows = t.d1_raw.select("row_key", "segment")
    return encode.OneHotEncoder(("segment",)).fit(rows.filter("segment <> 'MACHINERY'")).transform(rows)


@query(
    "one_hot_sparse",
    f"""with {D1}, cells as (select row_key, 0 as k, high_card as category from d1 union all select row_key, 1, segment from d1
      union all select row_key, 2, prio from d1),
    seen as (select distinct k, category from cells where row_key % 4 <> 0 and category is not null),
    places as (select k, category, row_number() over (order by k, category) - 1 as place from seen)
    select row_key, cast(place as int) as "index", 1.0::double as "value" from cells join places using (k, category)""",
)
def _(t: Inputs):
    rows = t.d1_raw.select("row_key", "high_card", "segment", "prio")
    return encode.SparseOneHotEncoder(("high_card", "segment", "prio")).fit(rows.filter(_TRAIN)).cells(rows, "row_key")


@query(
    "split_encode_by_cardinality",
    f"""with {D1}, h as (select high_card, dense_rank() over (order by high_card) - 1 as code from (select distinct high_card from d1 where row_key % 4 <> 0))
    select row_key, (y_text='F')::int as "y_text_F", (y_text='O')::int as "y_text_O", (y_text='P')::int as "y_text_P",
      cast(coalesce(h.code, -1) as int) as high_card
    from d1 left join h using (high_card)""",
)
def _(t: Inputs):
    return _fit(t, encode.CardinalitySplitEncoder(("y_text", "high_card"), limit=4), ["y_text", "high_card"])


@query(
    "median_impute",
    f"""with {D1}, m as (select median(price) as price, median(mostly_missing) as mm from d1 where row_key % 4 <> 0)
    select row_key, round(coalesce(d1.price, m.price), 6) as price, round(coalesce(d1.mostly_missing, m.mm), 6) as mostly_missing from d1, m""",
)
def _(t: Inputs):
    columns = ["price", "mostly_missing", "all_missing"]
    out = _fit(t, encode.MedianImputer(tuple(columns)), columns)
    return out.select("row_key", F.round("price", 6).alias("price"), F.round("mostly_missing", 6).alias("mostly_missing"))


@query("constant_impute", f"""with {D1} select row_key, coalesce(segment, 'missing_value') as segment from d1""")
def _(t: Inputs):
    return _fit(t, encode.ConstantImputer(("segment",)), ["segment"])


@query("drop_constant_columns", f"""with {D1} select row_key, price, year_num::int as year_num from d1""")
def _(t: Inputs):
    columns = ["price", "constant_num", "year_num"]
    return _fit(t, encode.DropConstantColumns(tuple(columns)), columns)


@query(
    "standard_scale",
    f"""with {D1}, m as (select avg(price) as mu, stddev_pop(price) as sd, avg(year_num) as ym, stddev_pop(year_num) as ys from d1 where row_key % 4 <> 0)
    select row_key, round((price-mu)/sd, 7) as price, round((year_num-ym)/ys, 7) as year_num, round(constant_num - 1, 7) as constant_num from d1, m""",
)
def _(t: Inputs):
    columns = ["price", "year_num", "constant_num"]
    out = _fit(t, encode.StandardScaler(tuple(columns)), columns)
    return out.select("row_key", *[F.round(c, 7).alias(c) for c in columns])


@query(
    "quantile_uniform",
    f"""with {D1}, q as (
      select i, quantile_cont(price, i/8.0::double) as v from d1, (select unnest(range(9)) as i) where row_key % 4 <> 0 group by i, (i/8.0::double)),
    iv as (select a.i as i, a.v as lo, b.v as hi from q a join q b on b.i = a.i + 1),
    ends as (select min(v) as lo, max(v) as hi from q)
    select row_key, round(case when price is null then null when price <= ends.lo then 0 when price >= ends.hi then 1
        else (iv.i + (price - iv.lo)/(iv.hi - iv.lo)) / 8 end, 7) as price
    from d1 cross join ends left join iv on price >= iv.lo and price < iv.hi""".replace(
        "group by i, (i/8.0::double)", "group by i"
    ).replace("quantile_cont(price, i/8.0::double) as v", "case i " + " ".join(f"when {k} then quantile_cont(price, {k / 8})" for k in range(9)) + " end as v"),
)
def _(t: Inputs):
    out = _fit(t, encode.QuantileTransformer(("price",), n_quantiles=9, output="uniform"), ["price"])
    return out.select("row_key", F.round("price", 7).alias("price"))


@query("quantile_normal")
def _(t: Inputs):
    out = _fit(t, encode.QuantileTransformer(("price", "year_num"), n_quantiles=1000), ["price", "year_num"])
    return out.select("row_key", F.round("price", 6).alias("price"), F.round("year_num", 6).alias("year_num"))


_FOLDED = f"""with {D1}, top as (
      select high_card from d1 where row_key % 4 <> 0 and high_card is not null group by 1 order by count(*) desc, high_card limit 254),
    seen as (select distinct high_card from d1 where row_key % 4 <> 0 and high_card is not null),
    folded as (
      select row_key, segment, case when (select count(distinct high_card) from d1) > 255
        and high_card not in (select high_card from top) and high_card in (select high_card from seen) then 'infrequent' else high_card end as high_card
      from d1)"""


def _folded(t: Inputs):
    width = profile.distinct_counts(t.d1_raw, ["high_card"])
    return _fit(t, encode.InfrequentFolder(("high_card", "segment"), widths=width), ["high_card", "segment"])


@query("fold_infrequent", _FOLDED + " select row_key, high_card, segment from folded")
def _(t: Inputs):
    return _folded(t)


@query(
    "fold_then_encode",
    _FOLDED + """, codes as (select high_card, dense_rank() over (order by high_card) - 1 as code
      from (select distinct high_card from folded where row_key % 4 <> 0 and high_card is not null))
    select row_key, cast(case when folded.high_card is null then -1 else coalesce(code, -1) end as int) as code
    from folded left join codes using (high_card)""",
)
def _(t: Inputs):
    folded = _folded(t)
    coded = encode.OrdinalEncoder(("high_card",), missing=-1).fit(folded.filter(_TRAIN)).transform(folded)
    return coded.select("row_key", F.col("high_card").cast("int").alias("code"))


@query(
    "encoder_steps",
    f"""with {D1}, m as (select median(price) as price from d1 where row_key % 4 <> 0),
    f as (select row_key, coalesce(d1.price, m.price) as price, coalesce(segment, 'missing_value') as segment from d1, m),
    s as (select avg(price) as mu, stddev_pop(price) as sd from f where row_key % 4 <> 0),
    c as (select segment, dense_rank() over (order by segment) - 1 as code from (select distinct segment from f where row_key % 4 <> 0))
    select row_key, round((price - mu)/sd, 7) as price, cast(coalesce(code, -1) as int) as segment from f left join c using (segment), s""",
)
def _(t: Inputs):
    steps = encode.Steps(
        (
            encode.ConstantImputer(("segment",)),
            encode.OrdinalEncoder(("segment",)),
            encode.MedianImputer(("price", "all_missing")),
            encode.DropConstantColumns(("constant_num",)),
            encode.StandardScaler(("price",)),
        )
    )
    out = _fit(t, steps, ["price", "all_missing", "constant_num", "segment"])
    return out.withColumn("price", F.round("price", 7))


@query(
    "feature_array",
    f"""with {D1} select row_key, coalesce(round(price*100)::bigint::varchar, '-')||'|'||year_num||'|'||constant_num::int as features from d1""",
)
def _(t: Inputs):
    rows = encode.feature_array(t.d1_raw, "row_key", ["price", "year_num", "constant_num"])
    f = F.col("features")
    text = F.concat(F.coalesce(F.round(f[0] * 100).cast("bigint").cast("string"), F.lit("-")), F.lit("|"), f[1].cast("int"), F.lit("|"), f[2].cast("int"))
    return rows.select("row_key", text.alias("features"))


@query("categories_as_text", """select l_orderkey, l_linenumber::varchar as l_linenumber from lineitem""")
def _(t: Inputs):
    return encode.categories_as_text(t.table("lineitem").select("l_orderkey", "l_linenumber"), ["l_linenumber"])


@query(
    "equal_count_bins",
    """select o_orderkey, o_totalprice, cast(ntile(10) over (order by o_totalprice, o_orderkey) as int) as bin from orders""",
)
def _(t: Inputs):
    return encode.equal_count_bins(t.table("orders"), "o_totalprice", 10, "o_orderkey")


_PARTNER_SQL = """with p as (
      select o_orderkey, o_totalprice as v, o_orderstatus as y, md5('0:'||o_orderkey) as d, substr(md5('0:'||o_orderkey),1,2) as piece from orders),
    q as (select *, coalesce(lead(v) over (partition by piece order by d), first_value(v) over (partition by piece order by d)) as pv,
                 coalesce(lead(y) over (partition by piece order by d), first_value(y) over (partition by piece order by d)) as py from p)"""


@query("mix_rows", _PARTNER_SQL + """ select o_orderkey, round(0.3::double*v + 0.7::double*pv, 6) as o_totalprice, y as o_orderstatus_a, py as o_orderstatus_b from q""")
def _(t: Inputs):
    out = encode.mix_rows(t.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey", ["o_totalprice"], "o_orderstatus", 0.3, digits=2)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


_HIT = "('0x'||substr(md5('0:o_totalprice:'||o_orderkey),1,13))::bigint / 4503599627370496.0::double < 0.25"


@query("noise_cutmix", _PARTNER_SQL + f""" select o_orderkey, case when {_HIT} then pv else v end as o_totalprice from q""")
def _(t: Inputs):
    return encode.noise_cells(t.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"], 0.25, digits=2)


@query("noise_missing", f"""select o_orderkey, case when {_HIT} then 0.0::double else o_totalprice end as o_totalprice from orders""")
def _(t: Inputs):
    return encode.noise_cells(t.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"], 0.25, mode="missing")


# ---- scalar functions ----------------------------------------------------------------------------------------


@query(
    "text_functions",
    r"""with w as (select p_partkey, lower(p_brand||'_'||p_name||'-v'||p_size||'ab') as s from part),
    r as (select p_partkey, s, regexp_replace(regexp_replace(regexp_replace(s, '[_-]+', ' ', 'g'), '([^a-z ])([a-z])', '\1 \2', 'g'), ' +', ' ', 'g') as spaced from w)
    select p_partkey, array_to_string(list_transform(string_split(spaced, ' '), lambda x: upper(x[1])||x[2:]), '') as camel,
           replace(s, '_', '\_') as escaped
    from r""",
)
def _(t: Inputs):
    s = F.lower(F.concat("p_brand", F.lit("_"), "p_name", F.lit("-v"), "p_size", F.lit("ab")))
    return t.table("part").select("p_partkey", X.camel_case(s).alias("camel"), X.escape_underscores(s).alias("escaped"))


@query(
    "citation_style",
    r"""select c_custkey, upper(c_mktsegment[1])||lower(c_mktsegment[2:])||' et al. '||lpad((c_custkey%30)::varchar, 2, '0') as citation from customer""",
)
def _(t: Inputs):
    year = F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0")
    key = F.concat(F.lower("c_mktsegment"), F.lit("-conf"), year, F.lit("a"))
    return t.table("customer").select("c_custkey", X.citation_style(key).alias("citation"))


@query(
    "lookup_name",
    f"""with {D1} select row_key, lower(coalesce(segment, high_card)) as name,
      '\\href{{https://example.org/d/'||row_key||'}}{{'||row_key||'}}' as link from d1""",
)
def _(t: Inputs):
    return t.d1_raw.select(
        "row_key", X.lookup_name("segment", "high_card").alias("name"), X.link_text("row_key", "https://example.org/d/").alias("link")
    )


@query(
    "model_names",
    """select p_partkey, case p_partkey%4 when 0 then 'Xgb Onehot' when 1 then 'Lgbm' when 2 then 'Catboost' else 'Sklearn Mlp' end as shown,
      case p_partkey%4 when 0 then 'xgb' when 1 then 'lgbm' when 2 then 'catboost' else 'sklearn_mlp' end as folder from part""",
)
def _(t: Inputs):
    names = F.array(*map(F.lit, ["xgb_onehot_early_stop_valid", "lgbm_early_stop_valid", "catboost_early_stop_valid", "sklearn_mlp"]))
    name = F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.table("part").select("p_partkey", X.model_display_name(name).alias("shown"), X.model_alias(name).alias("folder"))


@query(
    "parse_years",
    """select s_suppkey, case when s_suppkey%5=0 then null else 1990+s_suppkey%30 end::int as year from supplier where s_suppkey%5<>0""",
)
def _(t: Inputs):
    text = F.when(F.col("s_suppkey") % 5 == 0, "unknown").otherwise((1990 + F.col("s_suppkey") % 30).cast("string"))
    return t.table("supplier").select("s_suppkey", X.year_of(text).alias("year")).na.drop()


@query(
    "keyword_values",
    """select o_orderkey, case o_orderstatus when 'F' then null when 'O' then 'true' else o_orderpriority end as value from orders""",
)
def _(t: Inputs):
    text = F.when(F.col("o_orderstatus") == "F", "None").when(F.col("o_orderstatus") == "O", "True").otherwise(F.col("o_orderpriority"))
    resolved = X.keyword_map(F.create_map(F.lit("k"), text))
    return t.table("orders").select("o_orderkey", resolved["k"].alias("value"))


@query(
    "value_maps",
    f"""with {D1} select row_key, case when year_num%4 > 2 then 1 when year_num%4 > 1 then 0 else 2 end::int as graded,
      coalesce(price, 0) as price, coalesce(segment, 'MissingValue') as segment, (year_num + 1)::int as shifted from d1""",
)
def _(t: Inputs):
    return t.d1_raw.select(
        "row_key", X.graded_value(F.col("year_num") % 4).alias("graded"), X.fill_missing("price", 0.0).alias("price"),
        X.fill_missing("segment", "MissingValue").alias("segment"), X.shift_codes("year_num").alias("shifted"),
    )


@query(
    "seeded_numbers",
    """select o_orderkey, round(('0x'||substr(md5('7:'||o_orderkey),1,13))::bigint / 4503599627370496.0::double, 12) as u,
      md5('7:'||o_orderkey) as digest from orders""",
)
def _(t: Inputs):
    return t.table("orders").select("o_orderkey", F.round(uniform(7, "o_orderkey"), 12).alias("u"), order_key(7, "o_orderkey").alias("digest"))


@query(
    "batch_sizes",
    """with n as (select l_suppkey, count(*)*count(*) as n from lineitem group by 1),
    b as (select l_suppkey, n, case when n<1000 then 16 when n<10000 then 32 when n<50000 then 64 when n<100000 then 128
      when n<200000 then 256 when n<500000 then 512 else 1024 end as b1, case when n<100000 then 512 when n<500000 then 1024 else 2048 end as b2,
      case when n<50000 then 256 when n<100000 then 512 else 1024 end as b3 from n)
    select l_suppkey, b1::int as v1, b2::int as v2, b3::int as v3, cast(ceil(n::double/b1) as bigint) as epoch from b""",
)
def _(t: Inputs):
    n = t.table("lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("n"))
    sized = n.select("l_suppkey", "n", *[X.batch_size("n", v).alias(v) for v in ("v1", "v2", "v3")])
    return sized.select("l_suppkey", "v1", "v2", "v3", X.epoch_size("n", "v1").alias("epoch"))


@query(
    "array_chunks",
    f"""with {BASKETS}, a as (select paper, list(dataset order by dataset) as items from baskets group by 1)
    select paper, i as chunk, array_to_string(items[(i-1)*3+1:i*3], ',') as items
    from (select paper, items, unnest(range(1, (len(items)+2)//3+1)) as i from a)""",
)
def _(t: Inputs):
    arrays = t.baskets.groupBy("paper").agg(F.array_sort(F.collect_set("dataset")).alias("items"))
    chunks = arrays.select("paper", F.posexplode(X.array_chunks("items", 3)).alias("at", "piece"))
    return chunks.select("paper", (F.col("at") + 1).cast("bigint").alias("chunk"), F.concat_ws(",", "piece").alias("items"))


@query(
    "nan_gate",
    """select l_orderkey % 50 as g, count(*) filter (where l_discount > 0) as n,
      round(avg(l_tax / l_discount) filter (where l_discount > 0), 6) as m from lineitem group by 1""",
)
def _(t: Inputs):
    from tabgauge.schema import without_nan

    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan")))
    df = without_nan(t.table("lineitem").select((F.col("l_orderkey") % 50).alias("g"), ratio.alias("r")))
    return df.groupBy("g").agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("m"))


