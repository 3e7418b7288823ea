"""k nearest neighbours: a search over all rows in blocks, and a classifier over a bounded training sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabgauge.functions.digest import order_key
from tabgauge.functions.ordered import first_by_digest

#: fixed value: training rows that the classifier keeps
MAX_TRAIN_ROWS = 10_000
#: rows of queries and of candidates whose distances are in memory at once
TILE_ROWS = 2_048
#: blocks that a table is cut into, unless they would be smaller than a tile or larger than LARGEST_BLOCK_ROWS
BLOCKS = 16
LARGEST_BLOCK_ROWS = 65_536


def _block_rows(n: int) -> int:
    return min(LARGEST_BLOCK_ROWS, max(TILE_ROWS, -(-n // BLOCKS)))


def _first(k: int, row: np.ndarray, distance: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the ``k`` smallest distances of every row, ties by key."""
    order = np.lexsort((keys, distance, row))
    row = row[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return order[place < k]


def _closest(k: int, key: str, features: str, payload: str | None, exclude_self: bool):
    def tile(own, own_keys, points, keys) -> tuple[np.ndarray, ...]:
        size = (own**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :]
        rough = size - 2.0 * own @ points.T
        if exclude_self:
            rough[own_keys[:, None] == keys[None, :]] = np.inf
        at = min(k, len(points)) - 1
        # the k-th by rounded squares, with room for their rounding: whatever may be as near stays in
        bound = np.partition(rough, at, axis=1)[:, at : at + 1] + 1e-12 * size
        row, column = np.nonzero((rough <= bound) & np.isfinite(rough))
        exact = np.sqrt(((points[column] - own[row]) ** 2).sum(axis=1))
        first = _first(k, row, exact, keys[column])
        return row[first], column[first], exact[first]

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "neighbour", "distance"] + ([payload] if payload else [])
        if not len(queries) or not len(candidates):
            return pd.DataFrame(columns=columns)
        own = np.stack(queries[features].to_numpy())
        points = np.stack(candidates[features].to_numpy())
        own_keys, keys = queries[key].to_numpy(), candidates[key].to_numpy()
        found = []
        for q in range(0, len(own), TILE_ROWS):
            asked, nearest = slice(q, q + TILE_ROWS), []
            some = own[asked].astype("float64")
            for c in range(0, len(points), TILE_ROWS):
                known = slice(c, c + TILE_ROWS)
                row, column, exact = tile(some, own_keys[asked], points[known].astype("float64"), keys[known])
                nearest.append((row + q, column + c, exact))
            row, column, exact = (np.concatenate(v) for v in zip(*nearest))
            first = _first(k, row, exact, keys[column])
            found.append((row[first], column[first], exact[first]))
        row, column, exact = (np.concatenate(v) for v in zip(*found))
        out = pd.DataFrame({key: own_keys[row], "neighbour": keys[column], "distance": exact})
        if payload:
            out[payload] = candidates[payload].to_numpy()[column]
        return out[columns]

    return search


def nearest_neighbours(
    queries: DataFrame,
    train: DataFrame,
    key: str,
    features: str,
    k: int = 5,
    exclude_self: bool = False,
    payload: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``(key, neighbour, rank, distance[, payload])``; Euclidean, over all of ``train``, ties by neighbour key.

    Every block of queries meets every block of candidates in one task, which compares them tile by tile and keeps its
    ``k`` nearest with all ties resolved; the lists of a query's blocks are merged. The work is queries times candidates by
    definition of an exact search. What is shuffled is each table once for every block of the other: both are cut into
    ``BLOCKS`` blocks, so it grows as the tables do, up to a million rows, where blocks stop growing so that two of them
    fit a task, and their number grows. ``block_rows`` sets their size. Nothing is gathered.
    """
    columns = [key, features] + ([payload] if payload else [])
    left, right = (1 + max(0, n - 1) // (block_rows or _block_rows(n)) for n in (queries.count(), train.count()))

    def block(n: int, of: int, name: str):
        return F.pmod(F.xxhash64(F.col(key), F.lit(of)), F.lit(n)).cast("int").alias(name)

    asked = queries.select(key, features, block(left, 1, "_q"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("_c"))
    known = train.select(*columns, block(right, 2, "_c"), F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("_q"))
    types = dict(train.select(*columns).dtypes)
    schema = f"{key} {dict(queries.dtypes)[key]}, neighbour {types[key]}, distance double"
    if payload:
        schema += f", {payload} {types[payload]}"
    near = asked.groupBy("_q", "_c").cogroup(known.groupBy("_q", "_c")).applyInPandas(
        _closest(k, key, features, payload, exclude_self), schema
    )
    found = F.struct("distance", "neighbour", *([payload] if payload else []))
    merged = near.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(found)), 1, k).alias("found"))
    placed = merged.select(key, F.posexplode("found").alias("_at", "_found"))
    return placed.select(
        key, F.col("_found.neighbour"), (F.col("_at") + 1).alias("rank"), F.col("_found.distance"),
        *([F.col(f"_found.{payload}")] if payload else []),
    )


def knn_classify(
    queries: DataFrame,
    train: DataFrame,
    key: str,
    features: str,
    label: str,
    k: int = 5,
    exclude_self: bool = False,
    max_train: int = MAX_TRAIN_ROWS,
    seed: int = 0,
) -> DataFrame:
    """``(key, prediction, share)``: majority label of the k nearest, ties to the lower label.

    The classifier is fitted on at most ``max_train`` labelled rows, those with the smallest seeded digests of their key.
    """
    fitted = first_by_digest(
        train.select(key, features, label).withColumn("_digest", order_key(seed, key)), max_train, "_digest"
    ).drop("_digest")
    near = nearest_neighbours(queries, fitted, key, features, k, exclude_self, payload=label)
    votes = near.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(F.col(label).alias("label"), F.col("n")), F.struct("n", -F.col(label)))
    return votes.groupBy(key).agg(best.alias("b"), F.sum("n").alias("_all")).select(
        key, F.col("b.label").alias("prediction"), (F.col("b.n") / F.col("_all")).alias("share")
    )
