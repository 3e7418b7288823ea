"""Predictions to scores: one set of grouped aggregates for every metric and every group.

A prediction table has group columns, a label ``y`` (0..k-1) and either ``probs`` (array
of k doubles, or of one for a binary target) or a single ``score``. All label and
pointwise metrics come from one aggregate over ``(groups, y, predicted label)``, which
leaves at most k*k rows per group. The ranking metrics (AUC, average precision) count
equal scores together and then take running sums that are cut into slices, so one group
with most of the rows does not end in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.functions.ordered import running_before
from tabgauge.functions.scalars import argmax_label, rounded_label

MAX_LOSS = 2.0**31 - 1
#: probabilities are clipped to [eps, 1 - eps] before the logarithm
LOG_LOSS_EPS = 2.220446049250313e-16

KINDS = ("label", "proba", "threshold")


@dataclass(frozen=True)
class MetricSpec:
    """Name, input kind, direction and range of a metric; ``aggregate`` only for user metrics."""

    name: str
    kind: str = "label"
    optimum: float = 1.0
    worst: float = 0.0
    sign: int = 1
    binary_only: bool = False
    multilabel_only: bool = False
    aggregate: Callable[[Column, Column, Column], Column] | None = None


def make_scorer(
    name: str,
    aggregate: Callable[[Column, Column, Column], Column] | None = None,
    *,
    optimum: float = 1.0,
    worst: float = 0.0,
    greater_is_better: bool = True,
    needs_proba: bool = False,
    needs_threshold: bool = False,
    binary_only: bool = False,
    multilabel_only: bool = False,
) -> MetricSpec:
    """Describe a metric. A user metric passes ``aggregate(y, prediction, weight)``, an aggregate Column.

    ``prediction`` is the label, or the probability array (``needs_proba``), or the
    positive-class score (``needs_threshold``).
    """
    if needs_proba and needs_threshold:
        raise ValueError("set either needs_proba or needs_threshold, not both")
    kind = "proba" if needs_proba else "threshold" if needs_threshold else "label"
    return MetricSpec(name, kind, optimum, worst, 1 if greater_is_better else -1, binary_only, multilabel_only, aggregate)


SCORERS: dict[str, MetricSpec] = {
    s.name: s
    for s in (
        make_scorer("accuracy"),
        make_scorer("balanced_accuracy"),
        make_scorer("roc_auc", needs_proba=True),
        make_scorer("roc_auc_ovr", needs_proba=True),
        make_scorer("average_precision", needs_threshold=True, binary_only=True),
        make_scorer("brier_score", needs_threshold=True, binary_only=True, optimum=0, worst=1, greater_is_better=False),
        make_scorer("log_loss", needs_proba=True, optimum=0, worst=MAX_LOSS, greater_is_better=False),
        make_scorer("f1", binary_only=True),
        make_scorer("f1_micro"),
        make_scorer("f1_macro"),
        make_scorer("f1_weighted"),
        make_scorer("f1_samples", multilabel_only=True),
        make_scorer("jaccard", binary_only=True),
        make_scorer("jaccard_micro"),
        make_scorer("jaccard_macro"),
        make_scorer("jaccard_weighted"),
        make_scorer("jaccard_samples", multilabel_only=True),
        make_scorer("zero_one_loss", optimum=0, worst=1, greater_is_better=False),
        make_scorer("precision", binary_only=True),
        make_scorer("recall", binary_only=True),
    )
}

BINARY_METRICS = [s.name for s in SCORERS.values() if s.binary_only]
RANK_METRICS = ("roc_auc", "roc_auc_ovr", "average_precision")


def get_scorer(name: str) -> MetricSpec:
    if name not in SCORERS:
        raise ValueError(f"unknown metric: {name}")
    return SCORERS[name]


def register_scorer(spec: MetricSpec) -> MetricSpec:
    SCORERS[spec.name] = spec
    return spec


# ---- label and pointwise metrics -------------------------------------------------------------


def with_prediction(df: DataFrame, probs: str = "probs", output: str = "pred") -> DataFrame:
    """Label from probabilities: rounding for one column, first largest entry otherwise."""
    p = F.col(probs)
    return df.withColumn(output, F.when(F.size(p) == 1, rounded_label(p[0])).otherwise(argmax_label(p)))


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def confusion_cells(
    df: DataFrame, groups: Sequence[str], y: str = "y", pred: str = "pred", probs: str | None = None, weight: str | None = None
) -> DataFrame:
    """``(groups, y, pred, n, brier, log_loss)``: the one shuffle that feeds all label metrics."""
    w = _weight(weight)
    points = []
    if probs is not None:
        p = F.col(probs)
        single = F.size(p) == 1
        positive = F.when(single, p[0]).otherwise(F.try_element_at(p, F.lit(2)))
        own = F.when(single, F.when(F.col(y) == 1, p[0]).otherwise(1 - p[0])).otherwise(
            F.coalesce(F.try_element_at(p, (F.col(y) + 1).cast("int")), F.lit(0.0))
        )
        clipped = F.greatest(F.least(own, F.lit(1 - LOG_LOSS_EPS)), F.lit(LOG_LOSS_EPS))
        points = [
            F.sum(-F.ln(clipped) * w).alias("log_loss"),
            F.sum((positive - F.col(y)) * (positive - F.col(y)) * w).alias("brier"),
            F.max(F.size(p)).alias("width"),
        ]
    cells = df.groupBy(*groups, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.sum(w).alias("n"), *points)
    if probs is None:
        cells = cells.withColumns({c: F.lit(None).cast("double") for c in ("log_loss", "brier")}).withColumn("width", F.lit(None).cast("int"))
    return cells


def class_counts(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups, class, support, predicted, tp)`` for the classes seen in truth or prediction.

    The pointwise sums ride along on the truth side, so their total over the classes is
    the group's total and no join has to bring them back.
    """
    zero, nothing = F.lit(0.0), F.lit(None)
    sides = F.array(
        F.struct(
            F.col("y").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
            F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0.0).alias("tp"), "log_loss", "brier", "width",
        ),
        F.struct(
            F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"),
            nothing.cast("double").alias("log_loss"), nothing.cast("double").alias("brier"), nothing.cast("int").alias("width"),
        ),
    )
    sums = ("support", "predicted", "tp", "log_loss", "brier")
    return (
        cells.select(*groups, F.explode(sides).alias("s"))
        .select(*groups, "s.*")
        .groupBy(*groups, "class")
        .agg(*[F.sum(c).alias(c) for c in sums], F.max("width").alias("width"))
    )


def _ratio(a: Column, b: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_report(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per-class precision, recall, F1, support, plus accuracy, macro and weighted rows."""
    classes = class_counts(cells, groups).select(
        *groups,
        F.col("class").cast("string").alias("label"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
    )
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    summary = classes.groupBy(*groups).agg(
        total.alias("support"),
        (F.sum("tp") / total).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in names],
    )
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(c) for c in names]),
        *[
            F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{c}").alias(c) for c in names])
            for kind in ("macro", "weighted")
        ],
    )
    overall = summary.select(*groups, "support", F.explode(rows).alias("r")).select(
        *groups, "r.label", "r.precision", "r.recall", "r.f1", "support"
    )
    return classes.drop("tp").unionByName(overall)


def label_scores(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One wide row per group with every label and pointwise metric (unsigned)."""
    groups = list(groups)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    f1 = _ratio(2 * tp, support + predicted)
    jaccard = _ratio(tp, support + predicted - tp)
    recall, precision = _ratio(tp, support), _ratio(tp, predicted)
    total, hits = F.sum(support), F.sum(tp)
    one = F.col("class") == 1
    scores = class_counts(cells, groups).groupBy(*groups).agg(
        total.alias("total"),
        F.count(F.lit(1)).alias("n_labels"),
        F.count_if(support > 0).alias("n_true"),
        F.max("class").alias("top_class"),
        (hits / total).alias("accuracy"),
        F.avg(F.when(support > 0, recall)).alias("balanced_accuracy"),
        (2 * hits / (F.sum(support) + F.sum(predicted))).alias("f1_micro"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * support) / total).alias("f1_weighted"),
        (hits / (F.sum(support) + F.sum(predicted) - hits)).alias("jaccard_micro"),
        F.avg(jaccard).alias("jaccard_macro"),
        (F.sum(jaccard * support) / total).alias("jaccard_weighted"),
        (1 - hits / total).alias("zero_one_loss"),
        *[
            F.coalesce(F.max(F.when(one, value)), F.lit(0.0)).alias(name)
            for name, value in (("f1", f1), ("jaccard", jaccard), ("precision", precision), ("recall", recall))
        ],
        (F.sum("log_loss") / total).alias("log_loss"),
        (F.sum("brier") / total).alias("brier_score"),
        F.max("width").alias("width"),
    )
    binary = (F.col("n_labels") <= 2) & (F.col("top_class") <= 1) & F.coalesce(F.col("width") <= 2, F.lit(True))
    only_binary = ("f1", "jaccard", "precision", "recall", "brier_score")
    return scores.withColumns({c: F.when(binary, F.col(c)) for c in only_binary}).withColumn("is_binary", binary)


# ---- ranking metrics ---------------------------------------------------------------------------


def score_counts(
    df: DataFrame, groups: Sequence[str], y: str = "y", probs: str = "probs", weight: str | None = None
) -> DataFrame:
    """``(groups, class, score, pos, neg, negs)``: rows of equal score counted together.

    A binary target needs only the column of class 1; ``negs`` lists the count per other
    class, at most k entries.
    """
    p = F.col(probs)
    cell = lambda k, v: F.struct(k.alias("class"), v.alias("score"))
    wanted = F.when(F.size(p) <= 2, F.array(cell(F.lit(1), F.element_at(p, -1)))).otherwise(
        F.transform(p, lambda v, i: cell(i, v))
    )
    cells = (
        df.select(*groups, F.col(y).alias("y"), _weight(weight).alias("_w"), F.explode(wanted).alias("c"))
        .groupBy(*groups, "c.class", "c.score", "y")
        .agg(F.sum("_w").alias("n"))
    )
    positive = F.col("y") == F.col("class")
    return cells.groupBy(*groups, "class", "score").agg(
        F.sum(F.when(positive, F.col("n")).otherwise(0.0)).alias("pos"),
        F.sum(F.when(~positive, F.col("n")).otherwise(0.0)).alias("neg"),
        F.collect_list(F.when(~positive, F.struct("y", "n"))).alias("negs"),
    )


def rank_scores(
    df: DataFrame, groups: Sequence[str], y: str = "y", probs: str = "probs", weight: str | None = None, bounded: bool = False
) -> DataFrame:
    """One wide row per group: ``roc_auc`` (one-vs-one, macro), ``roc_auc_ovr``, ``average_precision``.

    Of a negative row, the positives above it count 1 and those at its score 1/2. The sum
    of these over all negatives of class j, divided by both class sizes, is the AUC of
    class i against class j. One pass over k score columns thus gives every ordered pair;
    pairs with an absent class are left out. Average precision is for a binary target.
    """
    groups = list(groups)
    counts = score_counts(df, groups, y, probs, weight)
    placed = running_before(
        counts, [*groups, "class"], [F.col("score").desc()], {"pos_above": "pos", "neg_above": "neg"}, bounded=bounded
    )
    upto_pos = F.col("pos_above") + F.col("pos")
    upto_all = upto_pos + F.col("neg_above") + F.col("neg")
    own = F.array(F.struct(F.col("class").alias("y"), F.col("pos").alias("n")))
    parts = placed.select(
        *groups,
        "class",
        (F.col("pos_above") + F.col("pos") / 2).alias("above"),
        _ratio(upto_pos, upto_all).alias("precision_here"),
        F.explode(F.concat("negs", own)).alias("r"),
    )
    pairs = parts.groupBy(*groups, "class", F.col("r.y").alias("rival")).agg(
        F.sum(F.col("r.n") * F.col("above")).alias("u"),
        F.sum(F.col("r.n") * F.col("precision_here")).alias("ap_sum"),
        F.sum("r.n").alias("n"),
    )
    rival = (F.col("rival") != F.col("class")) & (F.col("n") > 0)
    classes = (
        pairs.groupBy(*groups, "class")
        .agg(
            F.max(F.when(F.col("rival") == F.col("class"), F.col("n"))).alias("n_pos"),
            F.max(F.when(F.col("rival") == F.col("class"), F.col("ap_sum"))).alias("ap_sum"),
            F.sum(F.when(rival, F.col("u"))).alias("u"),
            F.sum(F.when(rival, F.col("n"))).alias("n_neg"),
            F.sum(F.when(rival, F.col("u") / F.col("n"))).alias("pair_sum"),
            F.count_if(rival).alias("n_pairs"),
        )
        .filter("n_pos > 0")
    )
    return classes.groupBy(*groups).agg(
        (F.sum(F.col("pair_sum") / F.col("n_pos")) / F.nullif(F.sum("n_pairs"), F.lit(0))).alias("roc_auc"),
        F.avg(F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc_ovr"),
        F.max(F.col("ap_sum") / F.col("n_pos")).alias("average_precision"),
    )


# ---- multilabel ---------------------------------------------------------------------------------


def multilabel_scores(df: DataFrame, groups: Sequence[str], y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """``f1_samples`` and ``jaccard_samples`` for label sets held as arrays; two empty sets score 0."""
    w = _weight(weight)
    both = F.size(F.array_intersect(y, pred))
    either = F.size(F.array_union(F.col(y), F.col(pred)))
    sizes = F.size(F.array_distinct(y)) + F.size(F.array_distinct(pred))
    return df.groupBy(*groups).agg(
        (F.sum(_ratio(2 * both, sizes) * w) / F.sum(w)).alias("f1_samples"),
        (F.sum(_ratio(both, either) * w) / F.sum(w)).alias("jaccard_samples"),
    )


# ---- all scores -----------------------------------------------------------------------------------


def score_table(
    df: DataFrame,
    groups: Sequence[str],
    y: str = "y",
    probs: str = "probs",
    weight: str | None = None,
    metrics: Sequence[str] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Long table ``(groups, metric, score)``, larger is better; metrics that do not apply give no row."""
    if not groups:
        everything = df.withColumn("_all", F.lit(0))
        return score_table(everything, ["_all"], y, probs, weight, metrics, bounded).drop("_all")
    groups = list(groups)
    specs = [get_scorer(m) for m in metrics] if metrics is not None else list(SCORERS.values())
    specs = [s for s in specs if not s.multilabel_only]
    own = [s for s in specs if s.aggregate is None]
    user = [s for s in specs if s.aggregate is not None]
    predicted = with_prediction(df, probs, "_pred")
    ranked = [s.name for s in own if s.name in RANK_METRICS]
    plain = [s.name for s in own if s.name not in RANK_METRICS]
    found = [label_scores(confusion_cells(predicted, groups, y, "_pred", probs, weight), groups).select(*groups, "is_binary", *plain)]
    if ranked:
        found.append(rank_scores(df, groups, y, probs, weight, bounded).select(*groups, *ranked))
    if user:
        w = _weight(weight)
        inputs = {"label": F.col("_pred"), "proba": F.col(probs), "threshold": F.element_at(F.col(probs), -1)}
        found.append(predicted.groupBy(*groups).agg(*[s.aggregate(F.col(y), inputs[s.kind], w).alias(s.name) for s in user]))
    wide = found[0]
    for more in found[1:]:
        wide = wide.unionByName(more, allowMissingColumns=True)
    if len(found) > 1:  # one row per group and source; the maximum picks the one that is there
        wide = wide.groupBy(*groups).agg(*[F.max(c).alias(c) for c in wide.columns if c not in groups])
    binary_only = [s.name for s in specs if s.binary_only]
    wide = wide.withColumns({n: F.when(F.col("is_binary"), F.col(n)) for n in binary_only})
    signed = wide.select(*groups, *[(F.lit(float(s.sign)) * F.col(s.name)).alias(s.name) for s in specs])
    return signed.unpivot(groups, [s.name for s in specs], "metric", "score").filter("score is not null")


def with_losses(scores: DataFrame) -> DataFrame:
    """Add ``loss = optimum - score`` for each metric row."""
    optimum = F.create_map(*[x for s in SCORERS.values() for x in (F.lit(s.name), F.lit(float(s.optimum)))])
    return scores.withColumn("loss", optimum[F.col("metric")] - F.col("score"))


def rmse_scores(df: DataFrame, groups: Sequence[str], y: str, pred: str, target_std: float | None = None) -> DataFrame:
    """Root mean squared error, rescaled by the target's std if given, and its negative as score."""
    rmse = F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2))) * F.lit(1.0 if target_std is None else float(target_std))
    return df.groupBy(*groups).agg(rmse.alias("rmse")).withColumn("score", -F.col("rmse"))
