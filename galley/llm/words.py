"""Words and word shingles of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Texts are read straight from
Arrow's buffers, 256 KB at a time (a longer text alone), so memory does not follow the size of a batch.
Hashes are 64 bits wide: two different shingles meet with a chance of 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BYTES = np.random.default_rng(20_260).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_Q = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def lean(run: Callable) -> Callable:
    """``run``, after which a worker returns freed memory to the system: workers are used again by later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^n modulo 2^64; kept up to a slice's length."""
    if n <= SLICE and base in _powers:
        return _powers[base]
    full = np.full(max(n, SLICE) + 1, base, np.uint64)
    full[0] = 1
    out = np.multiply.accumulate(full)
    if n <= SLICE:
        _powers[base] = out
    return out


@dataclass
class Words:
    """Words of consecutive texts: text i has words first[i] to first[i + 1]."""

    hashes: np.ndarray  # uint64
    start: np.ndarray  # byte offset in data
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray  # uint8, not lower-cased
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    row: int  # of the first text in its batch

    def __len__(self) -> int:
        return len(self.first) - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether they end within the text)."""
        n = len(self.hashes)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            q = np.uint64(1)
            for j in range(k):
                out[: n - k + 1] += self.hashes[j : n - k + 1 + j] * q
                q = q * _Q
            left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
            ok = left >= k
        return mix(out + np.uint64(k)), ok

    def sets(self, k: int) -> Iterator[np.ndarray]:
        """For each text its sorted distinct k-word shingles; fewer words are one shingle together."""
        sh, ok = self.shingles(k)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(sh[a : b - k + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:
                whole, q = np.uint64(0), np.uint64(1)
                for h in self.hashes[a:b]:
                    whole, q = whole + h * q, q * _Q
                yield mix(np.array([whole + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray, row: int = 0) -> Words:
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's beginning ends the word before
    before = np.concatenate([[True], space[:-1]]) if n else space
    start = np.flatnonzero(~space & (before | edge[:n]))
    after = np.concatenate([space[1:], [True]]) if n else space
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[data]] * _power(_P, n)[:n], out=sums[1:])
        raw = (sums[end] - sums[start]) * _power(_P_INV, n)[start]
        hashes = mix(raw + (end - start).astype(np.uint64))
    return Words(hashes, start, end, np.searchsorted(start, offsets), data, offsets, row)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) of whole texts of about ``size`` bytes together."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i
        i = j


def words(column: pa.Array) -> Iterator[Words]:
    """The words of every text of an Arrow column."""
    for data, offsets, row in slices(column):
        with np.errstate(over="ignore"):
            yield words_of(data, offsets, row)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them; a group may span batches. Keys are numbers, never null."""
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if kept and key != last:
                yield pa.concat_tables(kept)
                kept = []
            kept.append(table.slice(a, b - a))
            last = key
    if kept:
        yield pa.concat_tables(kept)
