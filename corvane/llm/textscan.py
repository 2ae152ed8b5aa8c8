"""Whole-text scanning over Arrow buffers, without a Python object per document.

A chunk is a run of rows: its texts' UTF-8 bytes joined in ``buf`` and the rows'
bounds in ``off``. Chunks hold about ``limit`` bytes, or one longer text, so that
memory follows the longest text rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
PRIME = (1 << 31) - 1
#: Bases of the two hashes of a span, modulo PRIME, and their inverses.
BASES = (0x2C3F5A17, 0x51B3E8D9)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
_RESIDUES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * _MUL)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lowered()


def powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, for few terms of words hashed before."""
    return np.multiply.accumulate(np.array([1] + [base] * (n - 1), U64))


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers under 2**62 modulo PRIME, as one of two values where that is 0."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    return (x & U64(PRIME)) + (x >> U64(31))


def residues(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo PRIME."""
    have = _RESIDUES.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint32) if have is None else have
        while len(have) < max(n, 1 << 18):
            have = np.concatenate([have, reduced(have * U64(pow(base, len(have), PRIME))).astype(np.uint32)])
        _RESIDUES[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the rows' bounds of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return buf, off


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds from 0) of each chunk."""
    buf, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_hash(buf: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """H with H[k, i] the k-th polynomial hash of the first i bytes: sums of residues, not reduced."""
    h = np.zeros((2, len(buf) + 1), U64)
    for k, base in enumerate(BASES):
        digit = reduced(table >> U64(2 + 16 * k))
        np.cumsum(reduced(digit[buf] * residues(len(buf), base)), out=h[k, 1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans by content and length, from prefix_hash's H.

    Two polynomials modulo a prime: no text of regular structure collides, as it
    does modulo a power of two whatever the base.
    """
    out = (end - start).astype(U64) * _MUL
    for k, inverse in enumerate(INVERSES):
        x = reduced(reduced(h[k][end] - h[k][start]) * residues(h.shape[1], inverse)[start])
        x[x == U64(PRIME)] = 0
        out = mix(out + x + U64(k))
    return out


def runs(inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses a bound of ``cut``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if cut is not None:
        c = cut[(cut > 0) & (cut < n)]
        first[c] |= inside[c]
        last[c - 1] |= inside[c - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of other bytes than ASCII white space."""
    s, e = runs(~SPACE[buf], off)
    return s, e, owner(s, off)


def owner(pos: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.searchsorted(off, pos, "right") - 1


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a position-wise array over each row."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: found twice or more; found earlier in the array."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, earlier = np.empty(len(k), bool), np.empty(len(k), bool)
    earlier[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, earlier


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
