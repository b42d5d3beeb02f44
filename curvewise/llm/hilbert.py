"""Positions along a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of integer points (one row each, entries below 2^bits).

    The points' bits are turned into the transposed Gray form by exchanging and inverting
    low bits, from the coarsest cell to the finest; interleaving them gives the position.
    Points x bits must fit in 63 bits, so that keys are non-negative longs.
    """
    dims = cells.shape[1]
    if dims * bits > 63:
        raise ValueError("dimensions times bits must be at most 63")
    x = [cells[:, i].astype(np.int64) for i in range(dims)]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ flip) >> level) & 1)
    return key


def cells_of(points: np.ndarray, bits: int, reach: float) -> np.ndarray:
    """Coordinates in [-reach, reach] as integers below 2^bits; what lies outside goes to the rim."""
    return np.clip(np.floor((points / reach + 1) * (1 << (bits - 1))), 0, (1 << bits) - 1).astype(np.int64)
