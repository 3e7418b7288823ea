"""Seeded choices that do not depend on partitioning.

Every "random" choice orders rows, or draws a number, from an md5 digest of the seed and
the row key. The same rows are chosen for any cluster size, and plain SQL can repeat it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: hex digits turned into a uniform number; 16**13 < 2**53, so the double is exact
UNIFORM_DIGITS = 13


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def order_key(seed: int, *keys) -> Column:
    """Digest of ``seed:key1:key2...``; sort by it for a seeded permutation."""
    parts = [F.lit(str(seed))] + [_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed: int, *keys) -> Column:
    """Uniform double in [0, 1) for each key."""
    head = F.substring(order_key(seed, *keys), 1, UNIFORM_DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**UNIFORM_DIGITS))


def child_seed(seed: int, name) -> Column:
    """Named child seed: an unsigned 32-bit number for each name."""
    return F.conv(F.substring(order_key(seed, name), 1, 8), 16, 10).cast("bigint")


def child_seed_value(seed: int, name: str) -> int:
    """Driver-side twin of :func:`child_seed`, for estimator seeds."""
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
