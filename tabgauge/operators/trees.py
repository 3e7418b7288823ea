"""Classification trees and forests of any depth: large nodes are split by histograms, small ones finished whole.

A node with more than ``handoff`` rows is split as in boosting: every task adds up rows and class weights by (tree, node,
feature, bin), one grouped aggregate adds the tasks' sums, windows over the bins of a feature turn them into impurity
decreases, and one row for each open node comes back. A node of ``handoff`` rows or fewer is handed to a grouped task that
grows its whole subtree from the exact values. So depth costs nothing: the number of jobs grows with the logarithm of the
rows, a task holds ``handoff`` rows, and the driver sees the large nodes alone (rows / handoff of them for each tree). In a
table so large that these nodes would not fit one job, more rows are handed on, up to ``boosting.CELLS`` values a task.

Where a table is larger than ``handoff`` and no bootstrap draws single rows, rows with equal features and label are counted
once and added up: from there on a row carries the number of rows it stands for, and ``handoff`` is about such rows. So a
cell of equal rows, however many, is never parted by histograms.

A large node whose rows share a bin in every feature gets bins of its own; it becomes a leaf only if those, which always
part the smallest value from the others, allow no split either.

A subtree is one row of arrays. A model of up to ``SHIPPED_NODES`` nodes is sent to the rows; a larger one stays a table,
and rows meet their subtrees by (tree, node), in parts of at most about ``handoff`` rows. Both give the same probabilities.

Rules: a node is a leaf if it is pure, has fewer than ``min_split`` rows or reaches ``max_depth``; a split leaves
``min_leaf`` rows and ``min_weight`` of all weight on each side and lowers the weighted impurity by ``min_decrease`` of all
weight. A split that lowers nothing is taken where ``min_decrease`` is 0, so a tree without limits ends in leaves of one
class or of equal rows. ``draw`` features are looked at in each node, and more until one can be split. Equal decreases: the
smaller feature, then the smaller cut. Missing values are smaller than all others. Rows of weight 0 or less, and rows
without a label, are left out; no rows at all are an error. A bootstrap counts each row Poisson(1) times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabgauge.operators import boosting
from tabgauge.session import ensure_checkpoint_dir

SHIPPED_NODES = 1_000_000
#: trees whose rows are dealt to subtrees in one job
TREES_AT_ONCE = 16
#: numbers that a subtree task compares at once
BLOCK = 2_000_000
_SUBTREE = "tree int, node int, feature array<int>, cut array<double>, left array<int>, right array<int>, share array<double>"
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


@dataclass
class Nodes:
    """A tree in arrays: values up to ``cut`` go left; feature -1 is a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def add(self, weights: np.ndarray, depth: int) -> int:
        for name, value in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("depth", depth), ("weights", weights)):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        children = tuple(self.add(side, self.depth[node] + 1) for side in (left, right))
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = children
        return children

    def shares(self) -> np.ndarray:
        w = np.array(self.weights)
        return w / w.sum(axis=1, keepdims=True)


def leaves(x: np.ndarray, feature, cut, left, right) -> np.ndarray:
    """The leaf of every row of ``x``."""
    feature, cut, left, right = (np.asarray(v) for v in (feature, cut, left, right))
    node = np.zeros(len(x), np.int64)
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        at = node[rows]
        node[rows] = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
        rows = rows[feature[node[rows]] >= 0]
    return node


@dataclass(frozen=True)
class Rules:
    """When a node may be split, in rows and weights of one table."""

    criterion: str
    random_cut: bool
    max_depth: int | None
    min_split: int
    min_leaf: int
    min_weight: float
    min_gain: float
    draw: int

    def impurity(self, w: np.ndarray) -> np.ndarray:
        """Weight times impurity, from class weights on the last axis."""
        total = w.sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.criterion == "gini":
                return np.where(total > 0, total - (w * w).sum(axis=-1) / total, 0.0)
            logs = lambda v: np.where(v > 0, v * np.log2(v), 0.0)
            return logs(total) - logs(w).sum(axis=-1)

    def impurity_column(self, ws: list[Column]) -> Column:
        total = reduce(add, ws)
        if self.criterion == "gini":
            return F.when(total > 0, total - reduce(add, [w * w for w in ws]) / total).otherwise(0.0)
        logs = lambda v: F.when(v > 0, v * F.log2(v)).otherwise(0.0)
        return logs(total) - reduce(add, [logs(w) for w in ws])

    def closed(self, n: int, weights: np.ndarray, depth: int) -> bool:
        total = weights.sum()
        return (
            n < max(self.min_split, 2 * self.min_leaf)
            or total < 2 * self.min_weight
            or (self.max_depth is not None and depth >= self.max_depth)
            or float(self.impurity(weights)) <= 1e-12 * total
        )


def _column_splits(v: np.ndarray, hot: np.ndarray, times: np.ndarray, rules: Rules, rng) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of the best split of each column; -inf where none is allowed."""
    n, whole = times.sum(), hot.sum(axis=0)
    order = v.argsort(axis=0, kind="stable")
    s = np.take_along_axis(v, order, 0)
    left = hot[order].cumsum(axis=0)[:-1]
    right = whole - left
    n_left = times[order].cumsum(axis=0)[:-1]
    ok = (s[:-1] < s[1:]) & (n_left >= rules.min_leaf) & (n - n_left >= rules.min_leaf)
    if rules.min_weight > 0:
        ok &= (left.sum(axis=-1) >= rules.min_weight) & (right.sum(axis=-1) >= rules.min_weight)
    gain = np.where(ok, rules.impurity(whole) - rules.impurity(left) - rules.impurity(right), -np.inf)
    at = np.where(ok, rng.random(ok.shape), -1.0).argmax(axis=0) if rules.random_cut else gain.round(9).argmax(axis=0)
    columns = np.arange(v.shape[1])
    lo, hi = s[at, columns], s[at + 1, columns]
    with np.errstate(invalid="ignore", over="ignore"):
        middle = lo + (hi - lo) / 2
    return gain[at, columns], np.where(np.isfinite(middle) & (middle < hi), middle, lo)


def best_split(x: np.ndarray, hot: np.ndarray, times: np.ndarray, rules: Rules, rng) -> tuple[int, float] | None:
    """The feature and cut of a node, or None. Features are drawn until ``draw`` were seen and one can be split."""
    width = x.shape[1]
    order = rng.permutation(width) if rules.draw < width else np.arange(width)
    gains, cuts = np.full(width, -np.inf), np.zeros(width)
    block = max(1, BLOCK // (len(x) * hot.shape[1]))
    begin = 0
    while begin < width and (begin < rules.draw or not np.isfinite(gains).any()):
        end = min(width, begin + block, rules.draw if begin < rules.draw else begin + 1)
        some = order[begin:end]
        gains[some], cuts[some] = _column_splits(x[:, some], hot, times, rules, rng)
        begin = end
    f = int(gains.round(9).argmax())
    return (f, float(cuts[f])) if gains[f] >= rules.min_gain - 1e-9 * hot.sum() else None


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray, n_classes: int, rules: Rules, depth: int, rng) -> Nodes:
    """The whole subtree below a node of that depth; a row stands for ``times`` rows of weight ``w`` together."""
    hot = np.zeros((len(y), n_classes))
    hot[np.arange(len(y)), y] = w
    tree = Nodes()
    todo = [(tree.add(hot.sum(axis=0), depth), np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        if rules.closed(times[rows].sum(), tree.weights[node], tree.depth[node]):
            continue
        found = best_split(x[rows], hot[rows], times[rows], rules, rng)
        if found is None:
            continue
        left = x[rows, found[0]] <= found[1]
        sides = rows[left], rows[~left]
        todo += zip(tree.split(node, *found, *[hot[side].sum(axis=0) for side in sides]), sides)
    return tree


def _copies(row: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often the bootstrap of a tree takes each row."""
    return np.searchsorted(_POISSON, boosting._unit(row, seed * 1_000_003 + tree), side="right")


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    x = boosting._matrix(batch.column("x"), width)
    row, y, weight, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "weight", "times"))
    return row, x, y, weight, times


def _joined_up(top: Nodes, below: dict[int, tuple], n_classes: int) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, right, share) of a whole tree: each leaf of the upper tree becomes the root of its subtree."""
    feature, cut, left, right = ([np.array(v)] for v in (top.feature, top.cut, top.left, top.right))
    share, size = [np.zeros((len(top.feature), n_classes))], len(top.feature)
    for node, (f, c, low, high, p) in below.items():
        low, high = (np.where(f >= 0, v + size, -1) for v in (low, high))
        for held, part in ((feature, f), (cut, c), (left, low), (right, high), (share, p.reshape(-1, n_classes))):
            held[0][node] = part[0]
            held.append(part)
        size += len(f)
    return tuple(np.concatenate(v) for v in (feature, cut, left, right, share))


@dataclass(frozen=True)
class ForestModel:
    tops: list
    subtrees: DataFrame
    n_classes: int
    width: int
    handoff: int
    features: str
    n_nodes: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector of class probabilities, averaged over the trees."""
        return self.shipped(df) if self.n_nodes <= SHIPPED_NODES else self.joined(df)

    def shipped(self, df: DataFrame) -> DataFrame:
        """By sending the trees to the rows; for models of a checked number of nodes."""
        below: dict[int, dict[int, Any]] = {}
        for r in self.subtrees.collect():  # at most SHIPPED_NODES nodes
            below.setdefault(r["tree"], {})[r["node"]] = tuple(np.array(r[c]) for c in ("feature", "cut", "left", "right", "share"))
        k, width = self.n_classes, self.width
        whole = [_joined_up(top, below[t], k) for t, top in enumerate(self.tops)]

        @F.arrow_udf("array<double>")
        def score(values: pa.Array) -> pa.Array:
            x = _known(boosting._matrix(values, width))
            p = np.zeros((len(x), k))
            for *tree, share in whole:
                p += share[leaves(x, *tree)]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array((p / len(whole)).ravel()))

        return df.withColumn("probability", array_to_vector(score(boosting._dense(df, self.features))))

    def joined(self, df: DataFrame) -> DataFrame:
        """By bringing rows and subtrees together; for models of any size."""
        ensure_checkpoint_dir(df.sparkSession)
        tops = [tuple(np.array(v) for v in (t.feature, t.cut, t.left, t.right)) for t in self.tops]
        k, width = self.n_classes, self.width
        at = "_row"
        while at.lower() in {c.lower() for c in df.columns}:
            at = f"_{at}"
        held = df.withColumn(at, F.monotonically_increasing_id()).checkpoint()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _known(boosting._matrix(batch.column("x"), width))
                for t, top in enumerate(tops):
                    columns = [batch.column("row"), pa.array(np.full(len(x), t, np.int32)), pa.array(leaves(x, *top).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "tree", "node", "x"])

        def walk(key: tuple[pa.Scalar, ...], rows: pa.Table, subtree: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table({"row": pa.array([], pa.int64()), "p": pa.array([], pa.list_(pa.float64()))})
            x = boosting._matrix(rows.column("x").combine_chunks(), width)
            *tree, share = (np.array(subtree.column(c)[0].as_py()) for c in ("feature", "cut", "left", "right", "share"))
            return pa.table({"row": rows.column("row"), "p": pa.array(list(share.reshape(-1, k)[leaves(x, *tree)]), pa.list_(pa.float64()))})

        rows = held.select(F.col(at).alias("row"), boosting._dense(held, self.features).alias("x"))
        placed = rows.mapInArrow(place, "row long, tree int, node int, x array<double>")
        parts = placed.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / self.handoff).alias("parts"))
        dealt = placed.join(parts, ["tree", "node"]).select("row", "tree", "node", "x", F.pmod(F.xxhash64("row"), "parts").alias("part"))
        copies = self.subtrees.join(parts, ["tree", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        keys = ["tree", "node", "part"]
        found = dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(walk, "row long, p array<double>")
        mean = found.groupBy(F.col("row").alias(at)).agg(F.array(*[F.sum(F.col("p")[i]) / len(tops) for i in range(k)]).alias("_p"))
        return held.join(mean, at).withColumn("probability", array_to_vector("_p")).drop(at, "_p")


def _known(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), -np.inf, x)


def _share(value: float, n: int, least: int) -> int:
    """A number of rows, given as such or, below 1, as a share of all rows."""
    return max(least, math.ceil(value * n) if value < 1 else int(value))


@dataclass(frozen=True)
class Forest:
    """A tree, or ``trees`` bootstrapped ones, with parameters; ``fit`` takes features (vector or array) and label 0..k-1.

    ``min_split`` and ``min_leaf``: rows, or below 1 a share of all rows. ``draw``: features looked at in a node, a number, a
    share below 1, ``sqrt``, ``log2``, or None for all. ``random_cut``: a cut drawn for each feature, in place of the best.
    """

    trees: int = 1
    criterion: str = "gini"
    random_cut: bool = False
    max_depth: int | None = None
    min_split: float = 2
    min_leaf: float = 1
    min_weight: float = 0.0
    min_decrease: float = 0.0
    draw: str | float | None = None
    bootstrap: bool = False
    max_bins: int = 255
    handoff: int = 20_000
    seed: int = 0
    features: str = "features"
    label: str = "label"
    weight: str | None = None

    def __post_init__(self):
        if self.criterion not in ("gini", "entropy"):
            raise ValueError(f"criterion is gini or entropy, not {self.criterion}")

    def prepared(self, df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(df.sparkSession)
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        values = F.transform(boosting._dense(df, self.features), lambda v: F.when(v.isNull() | F.isnan(v), F.lit(float("-inf"))).otherwise(v.cast("double")))
        rows = df.filter(F.col(self.label).isNotNull() & (weight > 0))
        return rows.select(F.monotonically_increasing_id().alias("row"), values.alias("x"), F.col(self.label).cast("int").alias("y"), weight.alias("weight"), F.lit(1).cast("long").alias("times"))

    def counted(self, rows: DataFrame) -> DataFrame:
        """Prepared rows of equal features and label as one, with their number and their weight together."""
        equal = rows.groupBy("x", "y").agg(F.sum("weight").alias("weight"), F.sum("times").alias("times"))
        return equal.select(F.xxhash64("x", "y").alias("row"), "x", "y", "weight", "times")

    def rules(self, n: int, total: float, width: int) -> Rules:
        d = self.draw
        if d == "sqrt":
            drawn = int(math.sqrt(width))
        elif d == "log2":
            drawn = int(math.log2(width)) if width else 0
        elif d is None:
            drawn = width
        else:
            drawn = int(float(d) * width) if float(d) < 1 else int(float(d))
        return Rules(
            self.criterion, self.random_cut, self.max_depth, _share(self.min_split, n, 2), _share(self.min_leaf, n, 1),
            self.min_weight * total, self.min_decrease * total, min(max(drawn, 1), max(width, 1)),
        )

    def fit(self, df: DataFrame) -> ForestModel:
        rows = self.prepared(df)
        single = self.bootstrap or rows.count() <= self.handoff
        table = (rows if single else self.counted(rows)).checkpoint()
        told = table.groupBy("y").agg(
            F.sum("times").alias("n"), F.count(F.lit(1)).alias("m"), F.sum("weight").alias("w"), F.max(F.size("x")).alias("width")
        ).collect()
        if not told:  # a row for each class
            raise ValueError("no rows to fit on")
        n, width, k = sum(r["n"] for r in told), max(r["width"] for r in told), max(2, max(r["y"] for r in told) + 1)
        weights = np.zeros(k)
        for r in told:
            weights[r["y"]] = r["w"]
        rules = self.rules(n, float(weights.sum()), width)
        tops = [Nodes() for _ in range(self.trees)]
        for top in tops:
            top.add(weights, 0)
        handed: dict[int, set[int]] = {t: set() for t in range(self.trees)}
        m = sum(r["m"] for r in told)
        if m <= self.handoff:
            handed = {t: {0} for t in handed}
        else:
            self._split_large(table if single else rows, table, tops, handed, rules, width, k, m)
        subtrees = self._finished(table, tops, handed, rules, width, k)
        size = subtrees.agg(F.sum(F.size("feature"))).first()[0]
        return ForestModel(tops, subtrees, k, width, self.handoff, self.features, size + sum(len(t.feature) for t in tops))

    def root_split(self, df: DataFrame) -> DataFrame:
        """(feature, cut, gain, n_left) of the first node by histograms; one row, or none."""
        table = self.prepared(df).checkpoint()
        n, total, width, top = table.agg(F.count(F.lit(1)), F.sum("weight"), F.max(F.size("x")), F.max("y")).first()
        edges = self._edges(table.select(F.lit(0).alias("tree"), F.lit(0).alias("node"), "x"), width)[(0, 0)]
        k = max(2, top + 1)
        top_tree = Nodes()
        top_tree.add(np.ones(k), 0)
        cells = table.mapInArrow(self._sums([top_tree], {(0, 0): 0}, [edges], width, k), _cell(k))
        best = self._best(cells, self.rules(n, total, width), width, k).select(F.col("best.*")).filter("feature is not null")
        cuts = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])
        return best.select("feature", F.get(F.get(cuts, F.col("feature")), F.col("bin") - 1).alias("cut"), "gain", F.col("nl").alias("n_left"))

    def _edges(self, placed: DataFrame, width: int) -> dict[tuple[int, int], list[np.ndarray]]:
        """Cut values of every feature for the nodes of ``placed``: quantiles, and the smallest value."""
        marks = [i / self.max_bins for i in range(1, self.max_bins)]
        cells = placed.select("tree", "node", F.posexplode("x").alias("feature", "value"))
        found = cells.groupBy("tree", "node", "feature").agg(F.percentile_approx("value", marks, 10_000).alias("marks"), F.min("value").alias("least"))
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        for r in found.collect():  # a row for each large node and feature
            out.setdefault((r["tree"], r["node"]), [np.zeros(0)] * width)[r["feature"]] = np.unique([r["least"], *r["marks"]])
        return out

    def _weights(self, row: np.ndarray, weight: np.ndarray, tree: int) -> np.ndarray:
        return weight * _copies(row, self.seed, tree) if self.bootstrap else weight

    def _sums(self, tops: list[Nodes], wanted: dict[tuple[int, int], int], edges: list, width: int, k: int):
        """A task's rows, counted rows and class weights by (tree, node, feature, bin), for nodes with the number of their edges."""
        n_bins = self.max_bins + 2
        by_tree: dict[int, dict[int, list[int]]] = {}
        for (t, node), e in wanted.items():
            by_tree.setdefault(t, {}).setdefault(e, []).append(node)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {(t, e): np.zeros((len(nodes), width, n_bins, k + 2)) for t, of in by_tree.items() for e, nodes in of.items()}
            for batch in batches:
                row, x, y, weight, times = _read(batch, width)
                for t, of in by_tree.items():
                    top = tops[t]
                    w, at = self._weights(row, weight, t), leaves(x, top.feature, top.cut, top.left, top.right)
                    for e, nodes in of.items():
                        place = np.full(len(top.feature), -1)
                        place[nodes] = np.arange(len(nodes))
                        rows = np.flatnonzero((place[at] >= 0) & (w > 0))
                        bins, spot = boosting.to_bins(x[rows], edges[e]).astype(np.int64), place[at[rows]]
                        for j in range(width):
                            cell = spot * n_bins + bins[:, j]
                            for i, number in enumerate((times[rows], None)):
                                held[t, e][:, j, :, i] += np.bincount(cell, number, len(nodes) * n_bins).reshape(-1, n_bins)
                            sums = np.bincount(cell * k + y[rows], w[rows], len(nodes) * n_bins * k)
                            held[t, e][:, j, :, 2:] += sums.reshape(len(nodes), n_bins, k)
            for (t, e), sums in held.items():
                node, f, b = np.nonzero(sums[..., 0])
                whole = [np.full(len(node), t), np.array(by_tree[t][e])[node], f, b]
                told = sums[node, f, b]
                columns = [*(np.asarray(v, np.int32) for v in whole), *told[:, :2].T.astype(np.int64), *told[:, 2:].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "feature", "bin", "n", "m", *[f"w{i}" for i in range(k)]])

        return run

    def _best(self, cells: DataFrame, rules: Rules, width: int, k: int) -> DataFrame:
        """(tree, node, n, m, w, best): totals of every node and, where a split is allowed, the best one."""
        names = ["n", "m", *[f"w{i}" for i in range(k)]]
        keys = ["tree", "node", "feature"]
        sums = cells.repartition(*keys).groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in names])
        side = W.partitionBy(*keys)  # bounded: the bins of a feature
        upto = side.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        told = sums.select(*keys, "bin", *[F.sum(c).over(side).alias(c) for c in names], *[F.sum(c).over(upto).alias(f"{c}_left") for c in names])
        left, whole = ([F.col(f"w{i}{s}") for i in range(k)] for s in ("_left", ""))
        right = [a - b for a, b in zip(whole, left)]
        gain = F.round(rules.impurity_column(whole) - rules.impurity_column(left) - rules.impurity_column(right), 9)
        nl, n = F.col("n_left"), F.col("n")
        allowed = (nl >= rules.min_leaf) & (n - nl >= rules.min_leaf)
        for ws in (left, right):
            allowed &= reduce(add, ws) >= rules.min_weight
        hashed = F.xxhash64(*keys, "bin", F.lit(self.seed))
        order = F.struct((hashed if rules.random_cut else gain).alias("first"), (-F.col("bin")).alias("b"), gain.alias("gain"), nl.alias("nl"), F.col("m_left").alias("ml"), F.array(*left).alias("wl"))
        found = told.groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.array(*[F.max(f"w{i}") for i in range(k)]).alias("w"), F.max(F.when(allowed, order)).alias("top"))
        drawn = W.partitionBy("tree", "node").orderBy(F.xxhash64(*keys, F.lit(self.seed)), "feature")  # bounded: the features
        ranked = found.withColumn("rank", F.row_number().over(drawn))
        first = F.min(F.when(F.col("top").isNotNull(), F.col("rank"))).over(W.partitionBy("tree", "node"))
        seen = ranked.withColumn("seen", F.col("rank") <= F.greatest(F.lit(rules.draw), first))
        choice = F.struct(F.col("top.gain").alias("gain"), (-F.col("feature")).alias("f"), "feature", (-F.col("top.b")).alias("bin"), F.col("top.nl").alias("nl"), F.col("top.ml").alias("ml"), F.col("top.wl").alias("wl"))
        good = F.col("seen") & F.col("top").isNotNull() & (F.col("top.gain") >= rules.min_gain - 1e-9)
        return seen.groupBy("tree", "node").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("w").alias("w"), F.max(F.when(good, choice)).alias("best"))

    def _split_large(self, rows: DataFrame, table: DataFrame, tops: list[Nodes], handed: dict[int, set[int]], rules: Rules, width: int, k: int, size: int) -> None:
        """Split nodes until all open ones are small enough to be handed on. The first bins are quantiles of all ``rows``."""
        edges = [self._edges(rows.select(F.lit(0).alias("tree"), F.lit(0).alias("node"), "x"), width)[(0, 0)]]
        wanted, rebinned = {(t, 0): 0 for t in range(len(tops))}, set()
        fits = max(1, boosting.CELLS // ((k + 2) * width * (self.max_bins + 2)))
        handoff = max(self.handoff, min(size // fits, boosting.CELLS // (width + k)))
        while wanted:
            pairs, wanted, stuck = list(wanted.items()), {}, []
            for i in range(0, len(pairs), fits):
                asked = dict(pairs[i : i + fits])
                cells = table.mapInArrow(self._sums(tops, asked, edges, width, k), _cell(k))
                for r in self._best(cells, rules, width, k).collect():  # one row for each open node
                    t, node, e, best = r["tree"], r["node"], asked[r["tree"], r["node"]], r["best"]
                    tops[t].weights[node] = np.array(r["w"])
                    if best is None:
                        if (t, node) not in rebinned and not rules.closed(r["n"], tops[t].weights[node], tops[t].depth[node]):
                            stuck.append((t, node))
                        continue
                    left = np.array(best["wl"])
                    children = tops[t].split(node, best["feature"], float(edges[e][best["feature"]][best["bin"] - 1]), left, tops[t].weights[node] - left)
                    for child, n, m in zip(children, (best["nl"], r["n"] - best["nl"]), (best["ml"], r["m"] - best["ml"])):
                        if rules.closed(n, tops[t].weights[child], tops[t].depth[child]):
                            continue
                        if m <= handoff:
                            handed[t].add(child)
                        else:
                            wanted[t, child] = e
            if stuck:
                rebinned |= set(stuck)
                own = self._edges(self._placed(table, tops, {t: {b for a, b in stuck if a == t} for t, _ in stuck}, width), width)
                for pair in stuck:
                    edges.append(own[pair])
                    wanted[pair] = len(edges) - 1

    def _placed(self, table: DataFrame, tops: list[Nodes], handed: dict[int, set[int]], width: int) -> DataFrame:
        """(tree, node, row, x, y, weight, times): the rows of the given nodes, once for each tree that takes them."""
        nodes = {t: np.array(sorted(of)) for t, of in handed.items() if of}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, x, y, weight, times = _read(batch, width)
                for t, of in nodes.items():
                    top = tops[t]
                    w, at = self._weights(row, weight, t), leaves(x, top.feature, top.cut, top.left, top.right)
                    rows = np.flatnonzero(np.isin(at, of) & (w > 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(at[rows].astype(np.int32)), pa.array(row[rows]),
                         pa.array(list(x[rows]), pa.list_(pa.float64())), pa.array(y[rows]), pa.array(w[rows]), pa.array(times[rows])],
                        names=["tree", "node", "row", "x", "y", "weight", "times"],
                    )

        return table.mapInArrow(run, "tree int, node int, row long, x array<double>, y int, weight double, times long")

    def _finished(self, table: DataFrame, tops: list[Nodes], handed: dict[int, set[int]], rules: Rules, width: int, k: int) -> DataFrame:
        """A subtree for each leaf of the upper trees, checkpointed in the shared folder."""
        spark, seed = table.sparkSession, self.seed
        depths = {(t, node): tops[t].depth[node] for t, of in handed.items() for node in of}

        def subtree(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            t, node = (v.as_py() for v in key)
            rows = rows.sort_by("row")
            x = boosting._matrix(rows.column("x").combine_chunks(), width)
            y, w, times = (rows.column(c).to_numpy() for c in ("y", "weight", "times"))
            tree = grow(x, y, w, times, k, rules, depths[t, node], np.random.default_rng([seed % (1 << 63), t, node]))
            return _row(t, node, tree)

        parts = []
        for begin in range(0, len(tops), TREES_AT_ONCE):
            some = {t: handed[t] for t in range(begin, min(begin + TREES_AT_ONCE, len(tops))) if handed[t]}
            if some:
                placed = self._placed(table, tops, some, width)
                parts.append(placed.groupBy("tree", "node").applyInArrow(subtree, _SUBTREE).checkpoint())
        single = []
        for t, top in enumerate(tops):
            for node, f in enumerate(top.feature):
                if f < 0 and node not in handed[t]:
                    share = top.weights[node] / top.weights[node].sum()
                    single.append((t, node, [-1], [0.0], [-1], [-1], [float(v) for v in share]))
        if single or not parts:
            parts.append(spark.createDataFrame(single, _SUBTREE))
        return reduce(DataFrame.unionByName, parts)


def _cell(k: int) -> str:
    return "tree int, node int, feature int, bin int, n long, m long, " + ", ".join(f"w{i} double" for i in range(k))


def _row(t: int, node: int, tree: Nodes) -> pa.Table:
    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    columns = [pa.array([t], pa.int32()), pa.array([node], pa.int32())]
    for values, kind in ((tree.feature, ints), (tree.cut, doubles), (tree.left, ints), (tree.right, ints), (tree.shares().ravel().tolist(), doubles)):
        columns.append(pa.array([values], kind))
    return pa.table(columns, names=["tree", "node", "feature", "cut", "left", "right", "share"])


def tree_of(config: dict, seed: int, weight: str | None) -> Forest:
    """A tree with the parameters of a drawn configuration."""
    return Forest(**_common(config), random_cut=config.get("splitter") == "random", min_weight=_given(config, "min_weight_fraction_leaf", 0.0), seed=seed, weight=weight)


def forest_of(config: dict, seed: int, weight: str | None) -> Forest:
    """A bootstrapped forest with the parameters of a drawn configuration."""
    drawn = config.get("max_features", "sqrt")
    return Forest(
        **_common(config), trees=int(_given(config, "n_estimators", 250)), draw=None if drawn in (None, "None") else drawn,
        bootstrap=str(config.get("bootstrap", True)).lower() == "true", seed=seed, weight=weight,
    )


def _given(config: dict, name: str, default):
    value = config.get(name)
    return default if value in (None, "None", "") else float(value)


def _common(config: dict) -> dict:
    depth = _given(config, "max_depth", None)
    return {
        "criterion": str(config.get("criterion", "gini")),
        "max_depth": None if depth is None else int(depth),
        "min_split": _given(config, "min_samples_split", 2),
        "min_leaf": _given(config, "min_samples_leaf", 1),
        "min_decrease": _given(config, "min_impurity_decrease", 0.0),
    }
