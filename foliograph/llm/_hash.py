"""Hashes of words and word shingles for whole Arrow columns at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


#: Powers that a worker keeps of each base; longer texts have theirs made anew, so they don't stay in memory.
KEPT_POWERS = 1 << 19


@functools.cache
def _kept(base: int) -> np.ndarray:
    return _powers(base, KEPT_POWERS)


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(base: int, size: int) -> np.ndarray:
    """base to the power 0, 1, ... size - 1, modulo 2 to the 64."""
    return _kept(base)[:size] if size <= KEPT_POWERS else _powers(base, size)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, bounds of each text's words); words are runs without ASCII white space."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    black = ~SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True  # a text's end ends its last word
    begins = np.flatnonzero(black & (edge[:-1] | ~np.concatenate([[False], black[:-1]])))
    stops = np.flatnonzero(black & (edge[1:] | ~np.append(black[1:], False))) + 1
    sums = np.cumsum(BYTES[raw] * powers(int(BASE), len(raw)))
    before = np.where(begins > 0, sums[begins - 1], np.uint64(0))
    hashes = mixed((sums[stops - 1] - before) * powers(int(INVERSE), len(raw))[begins] + (stops - begins).astype(np.uint64))
    return hashes, np.searchsorted(begins, ends)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle of `size` words, bounds of each text's shingles).

    A text of fewer words has one shingle of all its words, a text without words has none.
    """
    w, bounds = words(column)
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    left = np.minimum(np.repeat(bounds[1:], counts) - at, size)  # words of this shingle
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = k < left
        h = np.where(inside, h * BASE + w[np.where(inside, at + k, 0)], h) if not inside.all() else h * BASE + w[at + k]
    return mixed(h + left.astype(np.uint64)), out_bounds
