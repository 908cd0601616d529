"""Vectorised words and shingle fingerprints over the bytes of Arrow strings.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``. These are ASCII,
so cutting UTF-8 bytes there equals cutting code points. A word's fingerprint is a polynomial
over its bytes modulo 2**64 with a fixed odd base, then mixed; words over ``LONG`` bytes take
xxh3 instead, where such polynomials have known weak inputs. Memory stays near 60 bytes for each byte of
a block (``BLOCK`` bytes, or one longer text).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20
LONG = 200
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_NEG = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a block stay, longer ones (of one long text) don't."""
    global _POW, _NEG
    if len(_POW) >= n:
        return _POW, _NEG
    both = []
    for base in (_BASE, _INV):
        x = np.full(max(n, BLOCK + 1), base, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x))
    if n <= BLOCK + 1:
        _POW, _NEG = both
    return both[0], both[1]


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's call that returns freed memory to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def freeing(run: Callable) -> Callable:
    """A ``mapInArrow`` function that hands unused memory back when its task ends, as workers are reused."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def blocks(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of ``limit`` bytes at most, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; ``offs`` counts from buf's first byte."""
    ink = np.zeros(len(buf) + 2, np.int8)
    ink[1:-1] = ~SPACE[buf]
    step = np.diff(ink)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offs[1:-1]
    if len(inner):  # a row's end parts words as a space does
        inner = np.unique(inner[(inner > 0) & (inner < len(buf))])
        split = inner[(ink[inner] == 1) & (ink[inner + 1] == 1)]
        if len(split):
            starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def fingerprints(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint for each word."""
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG):
        h[k] = np.uint64(xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes()))
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n consecutive values of h (over row ends too)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int, lower: bool = True) -> list[np.ndarray]:
    """For each row its distinct n-word shingles as ascending 64-bit tokens.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    A token's top 6 bits hold the inverted length of the shingle's words, so that long ones, which
    are rarer, come first; the other 58 bits are its fingerprint. White space has no part in either.
    """
    if lower:
        buf = LOWER[buf]
    starts, ends, row = cut(buf, offs)
    h = fingerprints(buf, starts, ends)
    first = np.searchsorted(row, np.arange(len(offs)))
    ink = np.concatenate([[0], np.cumsum(ends - starts)])
    g = grams(h, n)
    if len(g):
        g = _token(g, ink[n:] - ink[: len(g)])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(_token(grams(h[a:b], int(b - a)) ^ np.uint64(b - a), ink[b : b + 1] - ink[a : a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _token(g: np.ndarray, ink: np.ndarray) -> np.ndarray:
    return ((np.uint64(63) - np.minimum(ink >> 1, 63).astype(np.uint64)) << np.uint64(58)) | (g >> np.uint64(6))
