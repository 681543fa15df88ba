"""Hashes of words and of windows of tokens, computed for a whole run of texts at once with numpy.

A token run's hash is a polynomial over its tokens taken from prefix sums, so every window costs the same
whatever its length. Equal content gives equal hashes wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once; a longer text is handled whole.
RUN_BYTES = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LETTER = np.random.default_rng(20_24).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    power, inverse = _upto(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of values[i:i + size] for every i that has so many."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _upto(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverse[:n])


def least_places(grams: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of grams[i:i + span], the leftmost of equals."""
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    n, reach = len(grams) - span + 1, 1
    if n <= 0:
        return np.zeros(0, np.int64)
    while reach * 2 <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < span:
        key = np.minimum(key[:n], key[span - reach: span - reach + n])
    return (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: (first row, bytes, offsets of its texts within the bytes)."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words between bytes marked in ``apart``; none crosses a text."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
