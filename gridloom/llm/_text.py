"""Vectorised views of text columns: bytes, words and 64-bit content hashes.

Arrow string columns are read as one byte array plus offsets, in slices of half
a megabyte, so a task's memory does not follow the size of its batch.  Nulls read
as empty texts.  A text longer than the slice size forms a slice of its own:
texts are never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Words are runs of bytes other than these: space, and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, of the base or its inverse; kept while the worker lives."""
    have = _powers[kind]
    if len(have) < n:
        size = max(n, min(2 * len(have), SLICE_BYTES + 2), 1 << 16)
        have = np.full(size, _U(_BASE if kind == "up" else _INVERSE))
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of consecutive rows of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True that stay within one row's bytes."""
    n = len(member)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] |= member[edges]
    last[edges - 1] |= member[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words."""
    return runs(~SPACES[data], offsets)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span's content and length: a polynomial of random byte values modulo 2**64, then mixed."""
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each run of `size` consecutive words of one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _U(_BASE)
        out += hashes[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(out[at]), at


def counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many entries, or what sum of whole-number weights, each of n rows has."""
    found = np.bincount(rows, weights, n)
    return found.astype(np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def release() -> None:
    """Gives memory that ended work has freed back to the machine, as workers live on between tasks, beside other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
