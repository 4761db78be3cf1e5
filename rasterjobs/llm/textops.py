"""Vectorised helpers on Arrow text batches: words, lines and their 64-bit hashes, in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2^64
_INV = pow(_BASE, -1, 1 << 64)

#: A slice of a batch ends after so many bytes of text (or one document, if that is longer).
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_TABLE = mix(np.arange(256, dtype=U), 77)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = {"p": np.ones(1, U), "i": np.ones(1, U)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POW[kind]
    if len(have) < n:
        base = np.full(max(n, SLICE_BYTES + 1), U(_BASE if kind == "p" else _INV))
        base[0] = U(1)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(base)
        if n <= 8 * SLICE_BYTES:
            _POW[kind] = have
    return have[:n]


class Texts:
    """A slice of documents as one byte array with document offsets; a null text is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges [start, end), in any order, overlapping or not."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U)
            np.cumsum((_LOWER if lower else _TABLE)[self.data] * _powers("p", n), out=sums[1:])
            h = (sums[end] - sums[start]) * _powers("i", n + 1)[start]
            return mix(h ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)), seed)

    def _ranges(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal ranges without separators that don't cross a document's edge."""
        n = len(self.data)
        inside = np.empty(n + 1, bool)
        inside[:n] = ~separator
        inside[n] = False
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside[:n]
        start = np.flatnonzero(inside & (~before | cut))
        end = np.flatnonzero(before & (~inside | cut))
        return start, end

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, bounds): byte ranges of words ``[^\\x20\\x09-\\x0D]+``; document i has words bounds[i]:bounds[i + 1]."""
        start, end = self._ranges(_SPACE[self.data])
        return start, end, np.searchsorted(start, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, bounds): every document splits at \\n, so an empty one has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        doc = np.searchsorted(self.offsets, breaks, "right") - 1
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        end = np.concatenate([self.offsets[1:], breaks])
        owner = np.concatenate([np.arange(self.n), doc])
        start = start[np.lexsort((start, owner))]
        end = end[np.lexsort((end, owner))]
        counts = np.bincount(owner, minlength=self.n)
        return start, end, np.concatenate([[0], np.cumsum(counts)])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Sub-batches of bounded bytes with their texts."""
    at = batch.schema.get_field_index(column)
    begin, rows = 0, batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + SLICE_BYTES, "right")) - 1)
        part = batch.slice(begin, end - begin)
        col = part.column(at).cast(pa.large_binary()).fill_null(b"")
        col = pa.concat_arrays([col])
        buffers = col.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        yield part, Texts(data, offsets - offsets[0], begin)
        begin = end


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every window of k consecutive word hashes (over the whole array; callers drop windows that cross documents)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for i in range(1, k):
            h = h * U(_BASE) + words[i : i + n]
    return mix(h, 3)


def shingle_sets(texts: Texts, k: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles (A-Z lower-cased).

    With fewer than k words the whole sequence is the one shingle; without words the set is empty.
    """
    start, end, bounds = texts.words()
    w = texts.hashes(start, end, lower=True)
    windows = window_hashes(w, k)
    for i in range(texts.n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= k:
            yield np.unique(windows[a : b - k + 1])
        elif b > a:
            yield window_hashes(w[a:b], int(b - a)) ^ U(b - a)
        else:
            yield np.zeros(0, U)


def code_points(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of code points in byte ranges."""
    heads = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    return heads[end] - heads[start]
