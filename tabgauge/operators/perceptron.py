"""A multilayer perceptron trained by summed gradients.

The weights are small and go out with every step; rows stay where they are. A task runs its rows through the network
and returns one row: the gradient of its weighted loss, the loss, and the weight it stands for. Those rows are added in
two levels, first among about the square root of all tasks, then on the driver, which so sees a bounded number of
vectors of the network's size. The driver takes one step of the Adam rule. The same rows give the loss of the watched
part, for early stopping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tabgauge.session import ensure_checkpoint_dir

#: fixed values: the usual constants of the Adam rule
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
#: up to so many tasks their rows go straight to the driver
DIRECT = 16
Layers = list[tuple[np.ndarray, np.ndarray]]


def unpacked(flat: np.ndarray, sizes: list[int]) -> Layers:
    """(weights, offsets) of every layer in one flat vector; writing to them writes to it."""
    out, at = [], 0
    for m, n in zip(sizes, sizes[1:]):
        out.append((flat[at : at + m * n].reshape(m, n), flat[at + m * n : at + m * n + n]))
        at += m * n + n
    return out


def parameters(sizes: list[int]) -> int:
    return sum((m + 1) * n for m, n in zip(sizes, sizes[1:]))


def start(sizes: list[int], activation: str, seed: int) -> np.ndarray:
    """Uniform weights whose spread follows the layer's width."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(parameters(sizes))
    for (w, b), m, n in zip(unpacked(flat, sizes), sizes, sizes[1:]):
        bound = math.sqrt((2.0 if activation == "sigmoid" else 6.0) / (m + n))
        w[:] = rng.uniform(-bound, bound, w.shape)
        b[:] = rng.uniform(-bound, bound, b.shape)
    return flat


def forward(x: np.ndarray, layers: Layers, activation: str) -> list[np.ndarray]:
    """Outputs of every layer, the input first, class probabilities last."""
    outs = [x]
    for w, b in layers[:-1]:
        z = outs[-1] @ w + b
        outs.append(np.maximum(z, 0.0) if activation == "relu" else np.tanh(z))
    w, b = layers[-1]
    z = outs[-1] @ w + b
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return [*outs, e / e.sum(axis=1, keepdims=True)]


def gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, flat: np.ndarray, sizes: list[int], activation: str) -> tuple[np.ndarray, float]:
    """Sum over the rows of the weighted loss' gradient, and the sum of the loss."""
    layers, out = unpacked(flat, sizes), np.zeros_like(flat)
    outs = forward(x, layers, activation)
    p = outs[-1]
    loss = float(-(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))).sum())
    delta = (p - (y[:, None] == np.arange(p.shape[1]))) * weight[:, None]
    for k, (gw, gb) in reversed(list(enumerate(unpacked(out, sizes)))):
        gw[:], gb[:] = outs[k].T @ delta, delta.sum(axis=0)
        if k:
            slope = outs[k] > 0 if activation == "relu" else 1 - outs[k] ** 2
            delta = (delta @ layers[k][0].T) * slope
    return out, loss


def _matrix(features: pa.Array, width: int) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(features), width)


_PART = "gradient binary, loss double, weight double, watched_loss double, watched_weight double"


def _part(values: tuple) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PART.split(", ")]
    return pa.RecordBatch.from_pydict({n: [v.tobytes() if n == "gradient" else float(v)] for n, v in zip(names, values)})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up rows of partial gradients: the step between tasks and driver."""
    total, rest = None, np.zeros(4)
    for batch in batches:
        for r in batch.to_pylist():
            g = np.frombuffer(r["gradient"])
            total = g.copy() if total is None else total + g
            rest += [r["loss"], r["weight"], r["watched_loss"], r["watched_weight"]]
    if total is not None:
        yield _part((total, *rest))


def summed_gradient(table: DataFrame, flat: np.ndarray, sizes: list[int], activation: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient summed over all rows that are not watched, and (loss, weight, watched loss, watched weight).

    ``table``: x (array), y, weight, watched.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest, seen = np.zeros_like(flat), np.zeros(4), False
        for batch in batches:
            x = _matrix(batch.column("x"), sizes[0])
            y, weight, watched = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "watched"))
            watched = watched.astype(bool)
            seen = True
            fit = ~watched
            g, loss = gradient(x[fit], y[fit], weight[fit], flat, sizes, activation)
            total += g
            rest[:2] += [loss, weight[fit].sum()]
            if watched.any():
                p = forward(x[watched], unpacked(flat, sizes), activation)[-1][np.arange(watched.sum()), y[watched]]
                rest[2:] += [-(weight[watched] * np.log(np.maximum(p, 1e-15))).sum(), weight[watched].sum()]
        if seen:
            yield _part((total, *rest))

    parts = table.mapInArrow(task, _PART)
    n = table.rdd.getNumPartitions()
    if n > DIRECT:
        parts = parts.repartition(math.isqrt(n)).mapInArrow(_summed, _PART)
    rows = parts.collect()  # at most the square root of the number of tasks
    total, rest = np.zeros_like(flat), np.zeros(4)
    for r in rows:
        total += np.frombuffer(r["gradient"])
        rest += [r["loss"], r["weight"], r["watched_loss"], r["watched_weight"]]
    return total, rest


@dataclass(frozen=True)
class PerceptronModel:
    flat: np.ndarray
    sizes: list[int]
    activation: str
    features: str
    losses: tuple[float, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector of class probabilities."""
        flat, sizes, activation = self.flat, self.sizes, self.activation

        @F.arrow_udf("array<double>")
        def score(values: pa.Array) -> pa.Array:
            p = forward(_matrix(values, sizes[0]), unpacked(flat, sizes), activation)[-1]
            return pa.array(list(p), pa.list_(pa.float64()))

        return df.withColumn("probability", array_to_vector(score(_dense(df, self.features))))


def _dense(df: DataFrame, features: str) -> Column:
    return F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)


@dataclass(frozen=True)
class Perceptron:
    """``hidden`` layer sizes, ``relu`` or ``tanh``, a penalty ``alpha`` on weights (not offsets), and Adam steps.

    ``schedule``: ``constant``; ``invscaling`` divides the step by the root of its number; ``adaptive`` by 5 whenever the
    loss failed twice to fall by ``tolerance``. Training ends after ``steps``, or after ``patience`` steps without a fall
    of the loss by ``tolerance``: of the watched rows with ``early_stopping`` (a column ``watched``, or a seeded tenth
    of the rows), whose best weights are kept, else of the training rows. Rows without a label are left out; no rows at
    all are an error.
    """

    hidden: tuple[int, ...] = (32,)
    activation: str = "relu"
    alpha: float = 1e-4
    step_size: float = 1e-3
    schedule: str = "constant"
    early_stopping: bool = True
    steps: int = 200
    patience: int = 10
    tolerance: float = 1e-4
    seed: int = 0
    features: str = "features"
    label: str = "label"
    weight: str | None = None
    watched: str | None = None

    def prepared(self, df: DataFrame) -> DataFrame:
        tenth = F.pmod(F.xxhash64(_dense(df, self.features), F.lit(self.seed)), F.lit(10)) == 0
        watched = F.coalesce(self.watched, F.lit(False)) if self.watched else tenth if self.early_stopping else F.lit(False)
        return df.filter(F.col(self.label).isNotNull()).select(
            _dense(df, self.features).alias("x"), F.col(self.label).cast("int").alias("y"),
            (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("weight"), watched.alias("watched"),
        )

    def fit(self, df: DataFrame) -> PerceptronModel:
        ensure_checkpoint_dir(df.sparkSession)
        table = self.prepared(df).checkpoint()
        facts = table.agg(F.max(F.size("x")).alias("width"), F.max("y").alias("last")).first()
        if facts["width"] is None:
            raise ValueError("no rows to fit on")
        sizes = [facts["width"], *self.hidden, max(2, facts["last"] + 1)]
        flat = start(sizes, self.activation, self.seed)
        m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
        decayed = np.concatenate([np.r_[np.ones(m * n), np.zeros(n)] for m, n in zip(sizes, sizes[1:])])
        losses: list[float] = []
        least, kept, failed, slow, rate = math.inf, flat, 0, 0, self.step_size
        for t in range(1, self.steps + 1):
            total, (loss, weight, watched_loss, watched_weight) = summed_gradient(table, flat, sizes, self.activation)
            told = watched_loss / watched_weight if watched_weight else loss / max(weight, 1e-12)
            losses.append(told)
            if told < least - self.tolerance:
                failed = slow = 0
            else:
                failed, slow = failed + 1, slow + 1
            if told < least:
                least, kept = told, flat.copy()
            if failed >= self.patience:
                break
            if self.schedule == "adaptive" and slow >= 2:
                rate, slow = rate / 5, 0
            g = (total + self.alpha * flat * decayed) / max(weight, 1e-12)
            m1, m2 = BETA1 * m1 + (1 - BETA1) * g, BETA2 * m2 + (1 - BETA2) * g * g
            size = rate / math.sqrt(t) if self.schedule == "invscaling" else rate
            flat = flat - size * (m1 / (1 - BETA1**t)) / (np.sqrt(m2 / (1 - BETA2**t)) + EPSILON)
        return PerceptronModel(kept, sizes, self.activation, self.features, tuple(losses))
