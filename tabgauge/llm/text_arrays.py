"""Words of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Sequences:
    """64-bit hashes of many slices of one array: polynomial hashes from running sums."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def hashes(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        need = len(values) + 1
        if len(self.up) < need:
            self.up, self.down = (np.cumprod(np.r_[U(1), np.full(need - 1, b, U)]) for b in (BASE, BASE_INVERSE))
        sums = np.zeros(need, U)
        np.cumsum(values * self.up[: need - 1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * self.down[begin])

    def words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, byte after the last, hash) of every word of a text that ends in white space."""
        raw = np.frombuffer(joined, np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[True, SPACE[raw]].astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        return begin, end, self.hashes(raw.astype(U) + U(1), begin, end)
