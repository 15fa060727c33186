"""Vectorised word work on Arrow string columns, shared by the operators of this subpackage.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``; this splits UTF-8 safely,
since those bytes never occur inside a multi-byte character.  Null texts hold no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once: keeps the temporary arrays in cache and memory small.  A longer text is one block.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.Generator(np.random.PCG64(20240613))
_PLAIN = _RNG.integers(0, 2**64, 256, dtype=U64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64; kept for the next call."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public MurmurHash3 constants)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of whole texts of about ``size`` bytes."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word (with the total at the end)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = solid[inner]
    finishes[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word (A-Z count as a-z with ``lower``)."""
    if not len(starts):
        return np.zeros(0, U64)
    terms = (_LOWER if lower else _PLAIN)[raw]
    terms *= _power(_P, len(raw) + 1)[: len(raw)]
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(terms, out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_P_INV, len(raw) + 1)[starts])


def grams(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, and for each text the index of its first shingle.

    A text of fewer words (but one at least) has a single shingle of all its words; an empty one has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    position = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], n)
    stop = np.repeat(first[1:], n)
    out = np.zeros(at[-1], U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for k in range(size):
        here = padded[position + k]
        here[position + k >= stop] = U64(0)
        out = out * _P + here
    return mix(out), at
