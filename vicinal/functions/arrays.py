"""Arrow columns as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(col: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 0))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled so that each bit depends on all others (a public finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, width: int, *salt: int) -> np.ndarray:
    """(ids, width): numbers in [0, 1) that follow from the id, the column and the salt alone, wherever they are asked for."""
    key = np.zeros(1, np.uint64)
    for s in salt:
        key = mixed(key + np.uint64(s % 2**64) + np.uint64(0x9E3779B97F4A7C15))
    rows = mixed(ids.astype(np.int64).view(np.uint64) ^ key)
    cols = mixed(np.arange(1, width + 1, dtype=np.uint64))
    return (mixed(rows[:, None] + cols[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def at_least(share: float, ids: np.ndarray, width: int, *salt: int) -> np.ndarray:
    """uniform(ids, width, *salt) >= share for a share under 1, from the whole numbers and without as many arrays."""
    key = np.zeros(1, np.uint64)
    for s in salt:
        key = mixed(key + np.uint64(s % 2**64) + np.uint64(0x9E3779B97F4A7C15))
    h = mixed(ids.astype(np.int64).view(np.uint64) ^ key)[:, None] + mixed(np.arange(1, width + 1, dtype=np.uint64))
    shifted = np.empty_like(h)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        np.right_shift(h, np.uint64(by), out=shifted)
        h ^= shifted
        if times:
            h *= np.uint64(times)
    return h >= np.uint64(-int(-share * 2**53 // 1) << 11)
