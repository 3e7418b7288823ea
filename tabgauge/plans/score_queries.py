"""Metric queries over three prediction tables: tied binary, ten-class, unbalanced binary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabgauge.functions import scalars as X
from tabgauge.operators import scoring
from tabgauge.plans.inputs import B1, B2, B3, Inputs
from tabgauge.plans.registry import query

PLACES = 8


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def _label_cells(t: Inputs, name: str, groups):
    df = getattr(t, name)
    if not groups:
        df, groups = df.withColumn("grp", F.lit("all")), ["grp"]
    return scoring.confusion_cells(scoring.with_prediction(df), groups, probs="probs")


_BINARY = """with {cte}, c as (
      select grp, count(*) as n, sum(y*q) as tp, sum((1-y)*q) as fp, sum(y*(1-q)) as fn, sum((1-y)*(1-q)) as tn,
             avg(case when y=q then 1 else 0 end) as acc,
             avg((p-y)*(p-y)) as brier,
             avg(-ln(greatest(least(case when y=1 then p else 1-p end, 1-2.220446049250313e-16::double), 2.220446049250313e-16::double))) as logloss
      from (select grp, y, p, round_even(p, 0)::int as q from {name}) group by 1)"""

_BINARY_COLUMNS = """round(acc, 8) as accuracy,
      round((coalesce(tp::double/nullif(tp+fn,0),0) + coalesce(tn::double/nullif(tn+fp,0),0))/((tp+fn>0)::int+(tn+fp>0)::int), 8) as balanced_accuracy,
      round(coalesce(2.0::double*tp/nullif(2*tp+fp+fn,0),0), 8) as f1, round(coalesce(tp::double/nullif(tp+fp+fn,0),0), 8) as jaccard,
      round(coalesce(tp::double/nullif(tp+fp,0),0), 8) as "precision", round(coalesce(tp::double/nullif(tp+fn,0),0), 8) as recall,
      round(1-acc, 8) as zero_one_loss, round(brier, 8) as brier_score, round(logloss, 8) as log_loss"""

_LABEL_METRICS = ["accuracy", "balanced_accuracy", "f1", "jaccard", "precision", "recall", "zero_one_loss", "brier_score", "log_loss"]


@query("binary_label_scores", _BINARY.format(cte=B1, name="b1") + f" select grp, {_BINARY_COLUMNS} from c")
def _(t: Inputs):
    return _rounded(scoring.label_scores(_label_cells(t, "b1", ["grp"]), ["grp"]).select("grp", *_LABEL_METRICS), *_LABEL_METRICS)


@query("unbalanced_label_scores", _BINARY.format(cte=B3, name="b3") + f" select grp, {_BINARY_COLUMNS} from c")
def _(t: Inputs):
    return _rounded(scoring.label_scores(_label_cells(t, "b3", ["grp"]), ["grp"]).select("grp", *_LABEL_METRICS), *_LABEL_METRICS)


_RANKS = """with {cte}, s as (select grp, p, sum(y) as pos, sum(1-y) as neg from {name} group by 1, 2),
    w as (select grp, p, pos, neg, sum(pos) over u as cp, sum(neg) over u as cn, sum(pos) over (partition by grp) as tp, sum(neg) over (partition by grp) as tn
          from s window u as (partition by grp order by p desc))
    select grp, round(sum(neg*(cp - pos/2.0::double))/(max(tp)*max(tn)), 8) as roc_auc,
           round(sum(neg*(cp - pos/2.0::double))/(max(tp)*max(tn)), 8) as roc_auc_ovr,
           round(sum(pos*(cp::double/(cp+cn)))/max(tp), 8) as average_precision
    from w group by 1"""


@query("binary_rank_scores", _RANKS.format(cte=B1, name="b1"))
def _(t: Inputs):
    return _rounded(scoring.rank_scores(t.b1, ["grp"]), "roc_auc", "roc_auc_ovr", "average_precision")


@query("unbalanced_rank_scores", _RANKS.format(cte=B3, name="b3"))
def _(t: Inputs):
    return _rounded(scoring.rank_scores(t.b3, ["grp"]), "roc_auc", "roc_auc_ovr", "average_precision")


_MULTI = f"""with {B2}, p as (select 'all' as grp, vec_id, y, probs, cast(list_position(probs, list_max(probs)) - 1 as int) as q from b2),
    classes as (select distinct k from (select y as k from p union select q from p)),
    per as (select k, sum((y=k)::int) as support, sum((q=k)::int) as predicted, sum((y=k and q=k)::int) as tp from p, classes group by k),
    m as (select k, support, predicted, tp, coalesce(tp::double/nullif(predicted,0),0) as pr, coalesce(tp::double/nullif(support,0),0) as re,
            coalesce(2.0::double*tp/nullif(support+predicted,0),0) as f1, coalesce(tp::double/nullif(support+predicted-tp,0),0) as ja from per),
    tot as (select sum(tp)::double as tp, sum(support)::double as n from m)"""


@query(
    "multiclass_label_scores",
    _MULTI
    + """ select 'all' as grp, round(max(tot.tp/tot.n), 8) as accuracy, round(avg(re) filter (where support>0), 8) as balanced_accuracy,
      round(max(tot.tp/tot.n), 8) as f1_micro, round(avg(f1), 8) as f1_macro, round(sum(f1*support)/max(tot.n), 8) as f1_weighted,
      round(max(tot.tp/(2*tot.n-tot.tp)), 8) as jaccard_micro, round(avg(ja), 8) as jaccard_macro, round(sum(ja*support)/max(tot.n), 8) as jaccard_weighted,
      round(max(1-tot.tp/tot.n), 8) as zero_one_loss,
      (select round(avg(-ln(greatest(probs[y+1], 2.220446049250313e-16::double))), 8) from p) as log_loss
    from m, tot""",
)
def _(t: Inputs):
    names = ["accuracy", "balanced_accuracy", "f1_micro", "f1_macro", "f1_weighted", "jaccard_micro", "jaccard_macro", "jaccard_weighted", "zero_one_loss", "log_loss"]
    return _rounded(scoring.label_scores(_label_cells(t, "b2", []), ["grp"]).select("grp", *names), *names)


@query(
    "class_report",
    _MULTI
    + """ select 'all' as grp, k::varchar as label, round(pr, 8) as "precision", round(re, 8) as recall, round(f1, 8) as f1, support::double as support from m
    union all select 'all', 'accuracy', round(tp/n, 8), round(tp/n, 8), round(tp/n, 8), n from tot
    union all select 'all', 'macro avg', round(avg(pr), 8), round(avg(re), 8), round(avg(f1), 8), max(n) from m, tot
    union all select 'all', 'weighted avg', round(sum(pr*support)/max(n), 8), round(sum(re*support)/max(n), 8), round(sum(f1*support)/max(n), 8), max(n) from m, tot""",
)
def _(t: Inputs):
    return _rounded(scoring.class_report(_label_cells(t, "b2", []), ["grp"]), "precision", "recall", "f1")


_OVO = """e as (select vec_id, y, unnest(range(10)) as k, unnest(probs) as s from b2 where true {keep}),
    u as (select a.k as a, b.y as b, sum(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0 end)::double as u, count(*) as n
          from e a join e b on a.k = b.k and a.y = a.k and b.y <> b.k group by 1, 2),
    np as (select y, count(*) as n from b2 where true {keep} group by 1)
    select round(avg(ovo), 8) as roc_auc, round(avg(ovr), 8) as roc_auc_ovr from (
      select a, sum(u)/sum(n) as ovr from u group by 1) x join (
      select a, avg(u/n) as ovo from u group by 1) y using (a)"""


@query("multiclass_rank_scores", f"with {B2}, " + _OVO.format(keep=""))
def _(t: Inputs):
    df = t.b2.withColumn("grp", F.lit("all"))
    return _rounded(scoring.rank_scores(df, ["grp"]).select("roc_auc", "roc_auc_ovr"), "roc_auc", "roc_auc_ovr")


@query("absent_class_rank_scores", f"with {B2}, " + _OVO.format(keep="and y <> 3"))
def _(t: Inputs):
    """One class never occurs in the truth: its pairs are left out."""
    df = t.b2.filter("y <> 3").withColumn("grp", F.lit("all"))
    return _rounded(scoring.rank_scores(df, ["grp"]).select("roc_auc", "roc_auc_ovr"), "roc_auc", "roc_auc_ovr")


@query(
    "weighted_label_scores",
    f"""with {B1}, w as (select grp, y, round_even(p,0)::int as q, p, 1+(p*10)::int%3 as w from b1)
    select grp, round(sum(w*(y=q)::int)::double/sum(w), 8) as accuracy, round(sum(w*(p-y)*(p-y))/sum(w), 8) as brier_score,
      round(coalesce(2.0::double*sum(w*y*q)/nullif(sum(w*y)+sum(w*q),0),0), 8) as f1 from w group by 1""",
)
def _(t: Inputs):
    df = scoring.with_prediction(t.b1.withColumn("w", 1 + F.round(F.col("p") * 10).cast("int") % 3))
    cells = scoring.confusion_cells(df, ["grp"], probs="probs", weight="w")
    return _rounded(scoring.label_scores(cells, ["grp"]).select("grp", "accuracy", "brier_score", "f1"), "accuracy", "brier_score", "f1")


@query(
    "multilabel_scores",
    """with s as (select l_orderkey, list(distinct l_returnflag||'') as y, list(distinct l_linestatus||'') as q0, list(distinct case when l_discount>0.05 then l_returnflag else 'N' end) as q
                  from lineitem group by 1)
    select round(avg(case when len(y)+len(q)=0 then 0 else 2.0::double*len(list_intersect(y,q))/(len(y)+len(q)) end), 8) as f1_samples,
           round(avg(len(list_intersect(y,q))::double/len(list_distinct(list_concat(y,q)))), 8) as jaccard_samples from s""",
)
def _(t: Inputs):
    flagged = F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).otherwise("N")
    sets = t.table("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("y"), F.collect_set(flagged).alias("pred"))
    return _rounded(scoring.multilabel_scores(sets, []), "f1_samples", "jaccard_samples")


@query(
    "score_table",
    _BINARY.format(cte=B1, name="b1")
    + f""", wide as (select grp, {_BINARY_COLUMNS} from c),
    r as ({_RANKS.format(cte=B1, name="b1")}),
    multi as (select grp, accuracy as f1_micro, accuracy/(2-accuracy) as jaccard_micro from wide),
    long as (
      select grp, 'accuracy' as metric, accuracy as score, 1.0::double as optimum from wide union all
      select grp, 'balanced_accuracy', balanced_accuracy, 1 from wide union all
      select grp, 'f1', f1, 1 from wide union all select grp, 'jaccard', jaccard, 1 from wide union all
      select grp, 'precision', "precision", 1 from wide union all select grp, 'recall', recall, 1 from wide union all
      select grp, 'zero_one_loss', -zero_one_loss, 0 from wide union all select grp, 'brier_score', -brier_score, 0 from wide union all
      select grp, 'log_loss', -log_loss, 0 from wide union all select grp, 'roc_auc', roc_auc, 1 from r union all
      select grp, 'average_precision', average_precision, 1 from r)
    select grp, metric, round(score, 8) as score, round(optimum - score, 8) as loss from long""",
)
def _(t: Inputs):
    """Long scores with losses: larger is better, losses are optimum minus score."""
    names = [*_LABEL_METRICS, "roc_auc", "average_precision"]
    scored = scoring.with_losses(scoring.score_table(t.b1, ["grp"], metrics=names))
    return scored.withColumns({"score": F.round("score", PLACES), "loss": F.round("loss", PLACES)})


@query(
    "skipped_metrics",
    f"""with {B2} select metric from (values ('accuracy'),('balanced_accuracy'),('roc_auc'),('roc_auc_ovr'),('log_loss'),('f1_micro'),('f1_macro'),
      ('f1_weighted'),('jaccard_micro'),('jaccard_macro'),('jaccard_weighted'),('zero_one_loss')) v(metric) where (select count(*) from b2) > 0""",
)
def _(t: Inputs):
    """For a ten-class target the binary metrics and the multilabel ones give no row."""
    return scoring.score_table(t.b2, []).select("metric")


@query(
    "user_metric",
    f"""with {B1} select grp, round(avg(case when y=1 then p else 0 end), 8) as score from b1 group by 1""",
)
def _(t: Inputs):
    spec = scoring.make_scorer(
        "positive_mass", lambda y, s, w: F.sum(F.when(y == 1, s).otherwise(0.0) * w) / F.sum(w), needs_threshold=True
    )
    scoring.register_scorer(spec)
    try:
        scored = scoring.score_table(t.b1, ["grp"], metrics=["positive_mass"])
    finally:
        del scoring.SCORERS["positive_mass"]
    return scored.select("grp", F.round("score", PLACES).alias("score"))


@query(
    "rmse",
    """select o_orderstatus, round(sqrt(avg((o_totalprice - c_acctbal)^2))*2.5::double, 6) as rmse, round(-sqrt(avg((o_totalprice - c_acctbal)^2))*2.5::double, 6) as score
    from orders join customer on o_custkey=c_custkey group by 1""",
)
def _(t: Inputs):
    joined = t.table("orders").join(t.table("customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    out = scoring.rmse_scores(joined, ["o_orderstatus"], "o_totalprice", "c_acctbal", target_std=2.5)
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "score")})


# ---- probability conversions ----------------------------------------------------------------------------------


@query(
    "softmax_and_labels",
    """with e as (select vec_id, list_transform(embedding[1:4], lambda x: exp(cast(x as double))) as e, embedding[1]::double as z from embeddings)
    select vec_id, round(e[1]/list_sum(e), 9) as p0, round(e[4]/list_sum(e), 9) as p3, cast(list_position(e, list_max(e)) - 1 as int) as label,
      round(1/(1+exp(-z)), 9) as sig, round_even(1/(1+exp(-z)), 0)::int as rounded, (1/(1+exp(-z)) >= 0.5)::int as over from e""",
)
def _(t: Inputs):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    df = t.table("embeddings").select("vec_id", logits.alias("z")).withColumn("probs", X.softmax("z")).withColumn("sig", X.sigmoid(F.col("z")[0]))
    return df.select(
        "vec_id", F.round(F.col("probs")[0], 9).alias("p0"), F.round(F.col("probs")[3], 9).alias("p3"), X.argmax_label("probs").alias("label"),
        F.round("sig", 9).alias("sig"), X.rounded_label("sig").alias("rounded"), X.threshold_label("sig").alias("over"),
    )


@query(
    "binary_probability_columns",
    """select l_orderkey, round(1-l_discount, 6) as p0, round(l_discount, 6) as p1 from lineitem""",
)
def _(t: Inputs):
    p = X.two_column_probs(F.array("l_discount"))
    return t.table("lineitem").select("l_orderkey", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


@query(
    "align_probability_columns",
    f"""with {B2} select vec_id, round(probs[2]/(probs[1]+probs[2]+probs[6]), 9) as kept_1, 3::int as n_kept, 12::int as n_padded, 0.0::double as last_padded from b2""",
)
def _(t: Inputs):
    kept = X.align_probs("probs", F.array(F.lit(0), F.lit(1), F.lit(5)))
    padded = X.align_probs("probs", F.sequence(F.lit(0), F.lit(11)))
    return t.b2.select(
        "vec_id", F.round(kept[1], 9).alias("kept_1"), F.size(kept).alias("n_kept"), F.size(padded).alias("n_padded"),
        F.element_at(padded, -1).alias("last_padded"),
    )


@query(
    "report_summary",
    _MULTI
    + """ select 'score = '||printf('%.3f', max(tot.tp/tot.n))||' | acc = '||round(max(tot.tp/tot.n), 3)||' | mf1 = '||round(avg(f1), 3)||' | wf1 = '||round(sum(f1*support)/max(tot.n), 3) as line
    from m, tot""",
)
def _(t: Inputs):
    wide = scoring.label_scores(_label_cells(t, "b2", []), ["grp"])
    values = {"score": F.col("accuracy"), "acc": F.col("accuracy"), "mf1": F.col("f1_macro"), "wf1": F.col("f1_weighted")}
    return wide.select(X.report_summary(values).alias("line"))
