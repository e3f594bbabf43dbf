"""Words and word hashes of whole text columns, one numpy pass per block of bytes.

Words are runs of bytes other than space and 0x09-0x0D. UTF-8 continuation bytes never fall in that
set, so splitting bytes equals splitting code points. Hashes depend on the bytes of the word alone
and on fixed multipliers: they agree across batches, tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BLOCK = 256 << 10  # bytes of text handled at once; one longer text is a block of its own
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_PLACE = _multipliers(4096, 11)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    flat = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset:flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw[:0], at - at[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, row offsets)`` for runs of rows of about ``BLOCK`` bytes."""
    raw, at = buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


class Words:
    """Word bounds and hashes of one block: ``start``/``end`` byte positions, ``row`` of each word,
    ``bounds`` giving each row's first word (one more entry than rows)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, *, lower: bool = False):
        self.raw, self.at = raw, at
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        cut = inside[1:] != inside[:-1]
        # a row border splits a word that would run across it
        inner = at[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
        joined = inner[inside[inner + 1] & inside[inner]]
        edges = np.flatnonzero(cut)
        starts, ends = edges[::2], edges[1::2]
        if len(joined):
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
        self.start, self.end = starts, ends
        self.bounds = np.searchsorted(starts, at, "left")
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.bounds))
        self.lower = lower

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        data = self.raw
        if self.lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        keep = ~_SPACE[data]
        body = data[keep].astype(np.uint64)
        first = np.cumsum(size) - size
        place = np.arange(len(body)) - np.repeat(first, size)
        longest = int(size.max())
        by = _PLACE if longest <= len(_PLACE) else _multipliers(longest, 11)
        body += np.uint64(1)
        body *= by[place]
        return mix(np.add.reduceat(body, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (runs over row borders included)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    by = _multipliers(n, 1000 + salt)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i:i + len(out)] * by[i]
    return mix(out)


def inside_rows(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for runs of ``n`` words that stay inside one row."""
    if total < n:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return row[n - 1:] == row[:total - n + 1]


def list_array(values: np.ndarray, counts: Sequence[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
