"""Texts of an Arrow batch as flat numpy arrays: no Python object per text or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of a public 64-bit hash: each bit depends on all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def parts(batch: pa.RecordBatch, text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to `limit` bytes of text each, at least a row: what is held at once follows the longest text."""
    col = batch.column(text)
    if not len(col):
        return
    sizes = np.diff(offsets(col))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def offsets(col: pa.StringArray) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offsets of the texts in them (one more than texts); null counts as empty."""
    at = offsets(col)
    if col.null_count:  # what lies under a null isn't defined
        col = col.fill_null("")
        at = offsets(col)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def word_bounds(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words up to each text's start (one more than texts)."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], solid[:-1]]) if len(buf) else solid
    after = np.concatenate([solid[1:], [False]]) if len(buf) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[tuple[int, str], np.ndarray] = {}
#: A random number for each byte; A-Z count as a-z.
_LETTER = numbers(256, 11)
_LETTER[65:91] = _LETTER[97:123]


def _powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get((base, "up"), ())) < n + 1:
        size = 1 << int(n + 1).bit_length()
        for name, x in (("up", base), ("down", pow(base, -1, 2**64))):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            _POWERS[base, name] = np.multiply.accumulate(out)
    return _POWERS[base, "up"], _POWERS[base, "down"]


#: Bytes of a word whose numbers are looked up; those of later bytes are computed.
_NEAR = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NUMBER = mix64(_LETTER[None, :] + (np.arange(_NEAR, dtype=np.uint64) * _STEP)[:, None]).ravel()


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, lower-cased (A-Z); none may be empty. Each byte gives a scrambled number of its own for each place
    in a word, so no pattern of letters, however regular, makes sums agree; length and sum are scrambled once more."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    letter = buf[place + np.repeat(starts, size)]
    x = _NUMBER[np.minimum(place, _NEAR - 1) * 256 + letter]
    late = np.flatnonzero(place >= _NEAR)
    if len(late):
        x[late] = mix64(_LETTER[letter[late]] + place[late].astype(np.uint64) * _STEP)
    return mix64(np.add.reduceat(x, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(buf: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's word shingles, ascending, and where each text's begin (one more than texts).

    A text with fewer words than `width` has its whole sequence as its one shingle; one without words has none.
    """
    starts, ends, first = word_bounds(buf, at)
    w = word_hashes(buf, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    prime = np.uint64(0xD6E8FEB86659FD93)
    g = np.zeros(len(w), np.uint64)
    if len(w) >= width:
        g[: len(w) - width + 1] = w[: len(w) - width + 1]
        for j in range(1, width):
            g[: len(w) - width + 1] = g[: len(w) - width + 1] * prime + w[j : len(w) - width + 1 + j]
    full = np.arange(len(w)) + width <= first[doc + 1] if len(w) else np.zeros(0, bool)
    few = np.flatnonzero((n > 0) & (n < width))
    for i in few.tolist():
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in w[first[i] : first[i + 1]]:
                h = h * prime + x
            g[first[i]] = h + np.uint64(n[i]) * np.uint64(0xA0761D6478BD642F)
        full[first[i]] = True
    g, doc = mix64(g[full]), doc[full]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(n) + 1))


def list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values cut at `at`, as an Arrow list column of longs."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
