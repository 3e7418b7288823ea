"""Gradient boosting on histograms: trees grown leaf by leaf, level by level or symmetric, for any number of classes.

Features are cut into bins once; what is kept of a row is one byte for each feature. A round grows one tree for each
class (one for two classes). For the open nodes of a round every task adds up gradients, hessians and rows by (tree,
node, feature, bin); one grouped aggregate adds the tasks' sums, a window over the bins of a node and feature turns
them into split gains, and one row for each node comes back. So what moves grows with nodes x features x bins, never
with rows, and the driver sees a few numbers for each node of the model.

Nodes of one depth are evaluated together, in one job. Growing by best leaf needs the gains of nodes that may not be
chosen in the end: the tree is explored a level at a time, and the order "largest gain first" is replayed over what is
explored until no choice depends on an unknown gain. The result is the tree that one split at a time would give.

Rows carry the sums of finished trees. They are renewed, with the lineage cut by a checkpoint, every ``REFRESH`` rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabgauge.session import ensure_checkpoint_dir

REFRESH = 10
#: sums that a task holds at once; more open nodes than that are evaluated in several jobs
CELLS = 4_000_000
#: the bin of missing values
MISSING = 0
_CELL = "tree int, node int, feature int, bin int, g double, h double, n long"


@dataclass
class Tree:
    """Nodes in arrays; a node without a feature (-1) is a leaf, and ``value`` is what it adds to the score."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, missing_left: bool) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node], self.right[node] = children
        for _ in children:
            for name, value in (("feature", -1), ("bin", 0), ("missing_left", True), ("left", -1), ("right", -1), ("value", 0.0)):
                getattr(self, name).append(value)
            self.depth.append(self.depth[node] + 1)
        return children

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, cut, stay, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        for _ in range(max(self.depth)):
            rows = np.flatnonzero(feature[node] >= 0)
            if not len(rows):
                break
            at = node[rows]
            b = bins[rows, feature[at]]
            goes_left = np.where(b == MISSING, stay[at], b <= cut[at])
            node[rows] = np.where(goes_left, left[at], right[at])
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def probabilities(raw: np.ndarray) -> np.ndarray:
    """Class probabilities of raw scores: logistic for one score, softmax for several."""
    if raw.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))
        return np.hstack([1 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte for each cell: 0 for missing, else 1 and the number of edges below the value."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        column = values[:, j]
        out[:, j] = np.where(np.isnan(column), MISSING, np.searchsorted(e, column, side="left") + 1)
    return out


def _matrix(features: pa.Array, width: int) -> np.ndarray:
    flat = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(features), width)


def bin_edges(df: DataFrame, features: str, max_bins: int) -> list[np.ndarray]:
    """For each feature up to ``max_bins - 1`` increasing cut values, from one sketch of the rows' quantiles."""
    marks = [i / max_bins for i in range(1, max_bins)]
    cells = df.select(F.posexplode(features).alias("feature", "value")).filter("value is not null and not isnan(value)")
    found = cells.groupBy("feature").agg(F.percentile_approx("value", marks, 10_000).alias("edges")).collect()
    width = df.select(F.max(F.size(features))).first()[0] or 0
    by = {r["feature"]: np.unique(r["edges"]) for r in found}  # a row for each feature
    return [by.get(j, np.zeros(0)) for j in range(width)]


def binned(df: DataFrame, features: str, edges: list[np.ndarray], n_scores: int, base: list[float]) -> DataFrame:
    """(row, bins, y, weight, watched, raw): the rows that trees are grown on."""
    width = len(edges)

    @F.arrow_udf("binary")
    def cut(values: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in to_bins(_matrix(values, width), edges)], pa.binary())

    return df.select(
        F.monotonically_increasing_id().alias("row"), cut(F.col(features)).alias("bins"),
        F.col("_y").cast("int").alias("y"), F.col("_weight").cast("double").alias("weight"), F.col("_watched").alias("watched"),
        F.array(*[F.lit(float(b)) for b in base[:n_scores]]).alias("raw"),
    )


def _unit(row: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for rows: the same for any partitioning of the checkpointed rows."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _rows(batch: pa.RecordBatch, width: int, done: list[list[Tree]]) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
    raw = batch.column("raw").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy()
    for trees in done:
        for k, tree in enumerate(trees):
            raw[:, k] += tree.values(bins)
    y, weight, watched, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "watched", "row"))
    return bins, raw, y, weight, watched.astype(bool), row


def gradients(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss by each score."""
    p = probabilities(raw)
    if raw.shape[1] == 1:
        p, hot = p[:, 1:], (y == 1)[:, None]
    else:
        hot = y[:, None] == np.arange(raw.shape[1])
    return weight[:, None] * (p - hot), weight[:, None] * p * (1 - p)


def _sums(width: int, n_bins: int, done, growing: list[Tree], wanted: dict[int, list[int]], features: list[int], share: float, seed: int, loss: bool, dense: bool = False):
    """A task's sums for the wanted nodes of each tree, and, under node -1, the loss of the watched rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((3, len(nodes), len(features), n_bins)) for k, nodes in wanted.items()}
        told = np.zeros(3)
        for batch in batches:
            bins, raw, y, weight, watched, row = _rows(batch, width, done)
            if loss and watched.any():
                p = probabilities(raw)[np.arange(len(y)), np.clip(y, 0, None)]
                told += [-(weight * np.log(np.maximum(p, 1e-15)))[watched].sum(), weight[watched].sum(), watched.sum()]
            use = ~watched if share >= 1 else ~watched & (_unit(row, seed) < share)
            g, h = gradients(raw, y, weight)
            for k, nodes in wanted.items():
                place = np.full(len(growing[k].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[growing[k].nodes(bins)]
                rows = np.flatnonzero(use & (at >= 0))
                size = len(nodes) * n_bins
                for j, f in enumerate(features):
                    cell = at[rows] * n_bins + bins[rows, f]
                    for i, w in enumerate((g[rows, k], h[rows, k], None)):
                        held[k][i, :, j] += np.bincount(cell, w, size).reshape(-1, n_bins)
        for k, nodes in wanted.items():
            node, f, b = np.nonzero(held[k][2] + dense)  # an empty bin splits as the one before, and is needed for totals by bin alone
            yield _cells(k, np.array(nodes)[node], np.array(features)[f], b, held[k][:, node, f, b])
        if told[2]:
            zero = np.zeros(1, np.int64)
            yield _cells(-1, zero - 1, zero, zero, told[:, None])

    return run


def _cells(tree: int, node, feature, b, sums) -> pa.RecordBatch:
    columns = [np.full(len(node), tree, np.int32), *(np.asarray(x, np.int32) for x in (node, feature, b)), sums[0], sums[1], sums[2].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "feature", "bin", "g", "h", "n"])


def best_splits(cells: DataFrame, booster: HistogramBooster) -> DataFrame:
    """(tree, node, g, h, n, best): node totals and, where a split is allowed, the best one.

    ``best`` has gain, feature, bin, missing_left and the sums of the left side. Rows with a bin up to ``bin`` go left.
    Equal gains: the smaller feature, then the smaller bin, then missing to the left. Symmetric trees share the split of
    the largest total gain among the nodes of a tree.
    """
    # one exchange by node and feature serves the sums and the windows; tasks have added up their rows already
    dealt = cells.repartition("tree", "node", "feature")
    sums = dealt.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    side = W.partitionBy("tree", "node", "feature")  # bounded: the bins of a feature
    upto = side.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = sums.select(
        "tree", "node", "feature", "bin",
        *[F.sum(c).over(side).alias(c) for c in ("g", "h", "n")],
        *[F.sum(c).over(upto).alias(f"{c}_left") for c in ("g", "h", "n")],
        *[F.sum(F.when(F.col("bin") == MISSING, F.col(c)).otherwise(0)).over(side).alias(f"{c}_missing") for c in ("g", "h", "n")],
    )
    both = told.withColumn("missing_left", F.explode(F.when(F.col("n_missing") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    left = {c: F.col(f"{c}_left") - F.when(F.col("missing_left"), 0).otherwise(F.col(f"{c}_missing")) for c in ("g", "h", "n")}
    split = both.select("tree", "node", "feature", "bin", "missing_left", "g", "h", "n", *[v.alias(f"{c}_side") for c, v in left.items()])
    gl, hl, nl = (F.col(f"{c}_side") for c in ("g", "h", "n"))
    g, h, n = F.col("g"), F.col("h"), F.col("n")
    gain = 0.5 * (booster.score(gl, hl) + booster.score(g - gl, h - hl) - booster.score(g, h)) - booster.min_gain
    allowed = (nl >= booster.min_rows) & (n - nl >= booster.min_rows) & (hl >= booster.min_hessian) & (h - hl >= booster.min_hessian)
    told = split.withColumn("gain", F.when(allowed, gain))
    if booster.symmetric:
        level = W.partitionBy("tree", "feature", "bin", "missing_left")  # bounded: the nodes of a level
        shared = F.sum(F.coalesce(0.5 * (booster.score(gl, hl) + booster.score(g - gl, h - hl) - booster.score(g, h)), F.lit(0.0))).over(level)
        told = told.filter("missing_left or tree < 0").withColumn("gain", F.when(shared > booster.min_gain, shared))
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "missing_left", gl.alias("gl"), hl.alias("hl"), nl.alias("nl"))
    return told.groupBy("tree", "node").agg(
        *[F.max(c).alias(c) for c in ("g", "h", "n")], F.max(F.when(F.col("gain") > 0, order)).alias("best")
    )


@dataclass(frozen=True)
class BoostedModel:
    edges: list
    base: list[float]
    rounds: list
    features: str = "features"
    losses: tuple[float, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector of class probabilities."""
        edges, base, rounds, width = self.edges, np.array(self.base), self.rounds, len(self.edges)

        @F.arrow_udf("array<double>")
        def score(values: pa.Array) -> pa.Array:
            bins = to_bins(_matrix(values, width), edges)
            raw = np.tile(base, (len(bins), 1))
            for trees in rounds:
                for k, tree in enumerate(trees):
                    raw[:, k] += tree.values(bins)
            return pa.array(list(probabilities(raw)), pa.list_(pa.float64()))

        return df.withColumn("probability", array_to_vector(score(_dense(df, self.features))))


def _dense(df: DataFrame, features: str) -> Column:
    kind = df.schema[features].dataType.typeName()
    return F.col(features) if kind == "array" else vector_to_array(features)


@dataclass(frozen=True)
class HistogramBooster:
    """Boosting with its parameters; ``fit`` takes features (vector or array), label 0..k-1, and optional columns.

    ``max_leaves`` and ``max_depth``: None for no limit. ``symmetric``: one split for a whole level. ``column_share``
    and ``level_column_share``: features drawn for a tree, and of those for a level. ``row_share``: rows drawn for a
    round. ``patience``: stop after so many rounds without a smaller loss on the watched rows, and keep the best round.
    Rows without a label are left out; no rows at all are an error.
    """

    rounds: int = 100
    learning_rate: float = 0.1
    max_leaves: int | None = 31
    max_depth: int | None = None
    min_rows: int = 20
    min_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    level_column_share: float = 1.0
    symmetric: bool = False
    max_bins: int = 255
    patience: int | None = None
    seed: int = 0
    features: str = "features"
    label: str = "label"
    weight: str | None = None
    watched: str | None = None

    def score(self, g: Column, h: Column) -> Column:
        kept = F.greatest(F.abs(g) - self.l1, F.lit(0.0)) if self.l1 else g
        return F.when(h + self.l2 > 0, kept * kept / (h + self.l2)).otherwise(0.0)

    def value(self, g: float, h: float) -> float:
        kept = np.sign(g) * max(abs(g) - self.l1, 0.0)
        return float(-self.learning_rate * kept / (h + self.l2)) if h + self.l2 > 0 else 0.0

    def prepared(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.label).isNotNull()).select(
            _dense(df, self.features).alias("_features"), F.col(self.label).alias("_y"),
            (F.col(self.weight) if self.weight else F.lit(1.0)).alias("_weight"),
            (F.coalesce(self.watched, F.lit(False)) if self.watched else F.lit(False)).alias("_watched"),
        )

    def base(self, df: DataFrame) -> list[float]:
        """Starting scores: the log odds, or the log shares, of the classes."""
        rows = df.filter("not _watched").groupBy(F.col("_y").cast("int").alias("y")).agg(F.sum("_weight").alias("w")).collect()
        share = {r["y"]: r["w"] for r in rows}  # a row for each class
        if not share:
            raise ValueError("no rows to fit on")
        total, n = sum(share.values()), max(2, max(share) + 1)
        p = [min(max(share.get(k, 0.0) / total, 1e-12), 1 - 1e-12) for k in range(n)]
        return [float(np.log(p[1] / (1 - p[1])))] if n == 2 else [float(np.log(x)) for x in p]

    def fit(self, df: DataFrame) -> BoostedModel:
        ensure_checkpoint_dir(df.sparkSession)
        rows = self.prepared(df)
        edges, base = bin_edges(rows.filter("not _watched"), "_features", self.max_bins), self.base(rows)
        table = binned(rows, "_features", edges, len(base), base).checkpoint()
        done: list[list[Tree]] = []
        fresh: list[list[Tree]] = []
        losses: list[float] = []
        best = 0
        for r in range(self.rounds):
            trees, loss = self._round(table, fresh, len(edges), len(base), r)
            if loss is not None:  # of the rounds before this one
                losses.append(loss)
                best = int(np.argmin(losses))
                if self.patience and len(losses) - 1 - best >= self.patience:
                    break
            if all(len(t.feature) == 1 for t in trees):  # nothing left to split
                break
            done.append(trees)
            fresh.append(trees)
            if len(fresh) >= REFRESH:
                table, fresh = _renewed(table, fresh, len(edges)).checkpoint(), []
        if self.patience and losses:
            done = done[:best] if best < len(losses) - 1 else done
        return BoostedModel(edges, base, done, self.features, tuple(losses))

    def opening(self, df: DataFrame) -> DataFrame:
        """The sums of the first round's first node: (tree, node, feature, bin, g, h, n)."""
        rows = self.prepared(df)
        edges, base = bin_edges(rows.filter("not _watched"), "_features", self.max_bins), self.base(rows)
        width = len(edges)
        task = _sums(width, self.max_bins + 1, [], [Tree() for _ in base], {k: [0] for k in range(len(base))}, list(range(width)), 1.0, 0, False)
        table = binned(rows, "_features", edges, len(base), base)
        return table.mapInArrow(task, _CELL).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])

    def _round(self, table: DataFrame, fresh, width: int, n_trees: int, r: int) -> tuple[list[Tree], float | None]:
        rng = np.random.default_rng([self.seed, r])
        drawn = lambda of, share: sorted(rng.choice(of, max(1, round(share * len(of))), replace=False).tolist()) if of else []
        columns = drawn(list(range(width)), self.column_share)
        trees = [Tree() for _ in range(n_trees)]
        facts: list[dict[int, Any]] = [{} for _ in trees]
        wanted, loss, chosen = {k: [0] for k in range(n_trees)}, None, [set() for _ in trees]
        while wanted:
            some = self._evaluated(table, fresh, trees, wanted, width, drawn(columns, self.level_column_share), r, loss is None)
            loss = some.pop((-1, -1), loss)
            wanted = {}
            for k, tree in enumerate(trees):
                facts[k].update({node: row for (t, node), row in some.items() if t == k})
                chosen[k], unknown = self._replay(tree, facts[k])
                if unknown:
                    wanted[k] = sorted(unknown)
        for k, tree in enumerate(trees):
            self._settle(tree, facts[k], chosen[k])
        return trees, (loss["g"] / loss["h"] if loss is not None and loss["h"] else None)

    def _evaluated(self, table, fresh, trees, wanted, width: int, features: list[int], r: int, first: bool) -> dict:
        """Totals and best split of the wanted nodes, a job for each part of them that fits a task."""
        n_bins = self.max_bins + 1
        fits = max(1, CELLS // max(1, 3 * len(features) * n_bins))
        pairs = [(k, node) for k, nodes in wanted.items() for node in nodes]
        out = {}
        parts = [pairs] if self.symmetric else [pairs[i : i + fits] for i in range(0, len(pairs), fits)]
        for i, part in enumerate(parts):
            asked: dict[int, list[int]] = {}
            for k, node in part:
                asked.setdefault(k, []).append(node)
            task = _sums(width, n_bins, fresh, trees, asked, features, self.row_share, self.seed * 1_000_003 + r, first and i == 0 and bool(self.watched), self.symmetric)
            rows = best_splits(table.mapInArrow(task, _CELL), self).collect()  # one row for each open node
            out.update({(x["tree"], x["node"]): x for x in rows})
        for pair in pairs:
            out.setdefault(pair, None)
        return out

    def _replay(self, tree: Tree, facts: dict[int, Any]) -> tuple[set[int], set[int]]:
        """The nodes split in order of gain, and the nodes whose gains are not known yet.

        An unknown gain may come before one that was taken, so the order is final when there is none.
        """

        def gain(node: int) -> float:
            row = facts[node]
            deep = self.max_depth is not None and tree.depth[node] >= self.max_depth
            return 0.0 if deep or row is None or row["best"] is None else row["best"]["gain"]

        heap, chosen, unknown, leaves = [], set(), set(), 1
        heapq.heappush(heap, (-gain(0), 0))
        while heap and (self.max_leaves is None or leaves < self.max_leaves):
            g, node = heapq.heappop(heap)
            if g >= 0:
                break
            if tree.left[node] < 0:
                b = facts[node]["best"]
                tree.split(node, -b["f"], -b["b"], b["missing_left"])
            chosen.add(node)
            leaves += 1
            for child in (tree.left[node], tree.right[node]):
                if child in facts:
                    heapq.heappush(heap, (-gain(child), child))
                elif self.max_depth is None or tree.depth[child] < self.max_depth:
                    unknown.add(child)
        return chosen, unknown

    def _settle(self, tree: Tree, facts: dict[int, Any], chosen: set[int]) -> None:
        """Cut what was explored but not chosen, and give the leaves their values from the sums of their parents."""
        sums = {0: (facts[0]["g"], facts[0]["h"])} if facts.get(0) is not None else {0: (0.0, 0.0)}
        for node in range(len(tree.feature)):
            if node not in sums:
                continue
            g, h = sums[node]
            tree.value[node] = self.value(g, h)
            if node in chosen:
                b = facts[node]["best"]
                sums[tree.left[node]], sums[tree.right[node]] = (b["gl"], b["hl"]), (g - b["gl"], h - b["hl"])
            else:
                tree.feature[node] = tree.left[node] = tree.right[node] = -1


def _renewed(table: DataFrame, fresh: list[list[Tree]], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _rows(batch, width, fresh)[1]
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(list(raw), pa.list_(pa.float64())))

    return table.mapInArrow(run, table.schema)


# ---- the boosted methods of the benchmark ---------------------------------------------------------------


def _number(config: Mapping[str, Any], name: str, default):
    value = config.get(name)
    return default if value in (None, "") else None if value == "None" else float(value)


def _whole(config: Mapping[str, Any], name: str, default):
    value = _number(config, name, default)
    return None if value is None else int(value)


def booster_of(method: str, config: Mapping[str, Any]) -> HistogramBooster:
    """The booster that a method's configuration means; parameters it does not name have the method's defaults.

    ``hgbt`` and ``lgbm`` grow the best leaf, ``xgb`` level by level, ``catboost`` symmetric trees.
    """
    number = lambda name, default: _number(config, name, default)
    whole = lambda name, default: _whole(config, name, default)
    rounds = whole("n_estimators", 100)
    if method == "hgbt":
        return HistogramBooster(
            rounds, number("learning_rate", 0.1), whole("max_leaf_nodes", 31), whole("max_depth", None),
            whole("min_samples_leaf", 20), l2=number("l2_regularization", 0.0), max_bins=whole("max_bins", 255),
        )
    if method == "xgb":
        return HistogramBooster(
            rounds, number("learning_rate", 0.3), None, whole("max_depth", 6), 1, number("min_child_weight", 1.0),
            number("reg_alpha", 0.0), number("reg_lambda", 1.0), number("gamma", 0.0), number("subsample", 1.0),
            number("colsample_bytree", 1.0), number("colsample_bylevel", 1.0),
        )
    if method == "lgbm":
        return HistogramBooster(
            rounds, number("learning_rate", 0.1), whole("num_leaves", 31), whole("max_depth", None),
            whole("min_child_samples", 20), number("min_child_weight", 1e-3), number("lambda_l1", 0.0),
            number("lambda_l2", 0.0), row_share=number("subsample", 1.0), column_share=number("colsample_bytree", 1.0),
        )
    if method == "catboost":
        return HistogramBooster(
            rounds, number("learning_rate", 0.03), None, whole("max_depth", 6), 0, 0.0, l2=number("reg_lambda", 3.0), symmetric=True
        )
    raise ValueError(f"unknown boosted method: {method}")


def with_facts(booster: HistogramBooster, facts: Mapping[str, Any]) -> HistogramBooster:
    """Name the weight and watched columns, and set the seed, of a trial."""
    patience = booster.patience or (20 if facts.get("valid") else None)
    return replace(booster, seed=int(facts["seed"]), weight=facts.get("weight"), watched=facts.get("valid"), patience=patience)
