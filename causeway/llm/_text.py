"""Words and rolling hashes of whole Arrow batches in numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these are the matches of
``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials modulo 2**64 over a random table of 64-bit values for the bytes,
finished by a mixing step; the same string has the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from causeway.llm._common import SLICE_BYTES

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**64, size=256, dtype=U)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = int(_rng.integers(1, 2**63, dtype=U)) * 2 + 1 & (2**64 - 1)
WORD_BASE = U(int(_rng.integers(1, 2**63, dtype=U)) * 2 + 1 & (2**64 - 1))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1024)
        _powers[:] = [np.cumprod(np.concatenate(([U(1)], np.full(size, U(b), dtype=U))), dtype=U) for b in (BASE, pow(BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the input moves every bit of the output."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after another, and the offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most limit bytes of text (or one row), with their bytes and offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        n, i = batch.num_rows, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = inside[first]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def prefix(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any part of data."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], dtype=U, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n word hashes in a row, without regard to where texts end."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = out * WORD_BASE + hashes[k : len(hashes) - n + 1 + k]
    return mix(out + U(n))
