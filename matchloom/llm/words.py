"""Vectorised word handling over Arrow string buffers.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; words never cross a document.  All
functions work on whole Arrow arrays in slices of a bounded number of bytes, so that the memory of
a task depends on the longest single document and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of documents: byte bounds in `data`, and for each document its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    first_row: int

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes; with `lower`, of its bytes with A-Z lowered."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(n)
        value = (_BYTE_LOWER if lower else _BYTE)[self.data]
        value *= up[:n]
        total = np.cumsum(value)
        got = total[self.ends - 1] - total[self.starts] + value[self.starts]
        got *= down[self.starts]
        return mix(got)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of at most `limit` bytes, or of one row."""
    if not len(column):
        return
    at, data = string_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, at[row : stop + 1] - at[row], data[at[row] : at[stop]]
        row = stop


def split_words(column: pa.Array, limit: int = SLICE_BYTES, outside: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words of slices of the column; `outside` says which bytes are not part of a word."""
    for row, at, data in slices(column, limit):
        n = len(data)
        if not n:
            yield Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64), row)
            continue
        inside = ~outside[data]
        cut = np.zeros(n + 1, bool)  # a document starts here
        cut[at] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, ~inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, ~inside[1:]
        starts = np.flatnonzero(inside & (before | cut[:-1]))
        ends = np.flatnonzero(inside & (after | cut[1:])) + 1
        yield Words(data, starts, ends, np.searchsorted(starts, at), row)


def rolling(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each `width` consecutive values, by doubling; those that cross documents are the caller's to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(mix(np.array([seed], np.uint64))[0]) | 1
    parts: dict[int, np.ndarray] = {1: hashes if seed == 1 else mix(hashes + np.uint64(base))}
    size = 1
    while size * 2 <= width:
        factor, h = np.uint64(pow(base, size, 1 << 64)), parts[size]
        parts[size * 2] = h[: len(h) - size] * factor + h[size:]
        size *= 2
    out, done = parts[size][:n].copy(), size
    while done < width:
        step = 1 << ((width - done).bit_length() - 1)
        out *= np.uint64(pow(base, step, 1 << 64))
        out += parts[step][done : done + n]
        done += step
    return mix(out)


def window_rows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs of `width` words within one document: the index of the first word, and the document's index."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    return first, docs


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lowered_words(text: str | None) -> list[str]:
    """The words of one text with A-Z lowered, one at a time: the plain definition, for small inputs and tests."""
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)
