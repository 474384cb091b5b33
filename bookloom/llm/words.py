"""Words of Arrow text columns as byte ranges, and their hashes, for operators that run in Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses these bytes inside a character. Work goes through
slices of bounded size, so memory does not follow the batch; one text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the polynomial base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1)
            self.up, self.down = (np.full(size, b, np.uint64) for b in (BASE, INVERSE))
            for p in (self.up, self.down):
                p[0] = 1
                np.multiply.accumulate(p, out=p)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """``out[i]``: polynomial hash of the first i values."""
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range; equal contents give equal hashes wherever they stand."""
    _, down = _POWERS.get(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Slice:
    """Some rows of a batch: their bytes, the words in them and the row of each word."""

    first: int  # row of the batch
    rows: int
    data: np.ndarray  # uint8
    ends: np.ndarray  # end of each row's bytes
    start: np.ndarray  # of each word
    end: np.ndarray
    counts: np.ndarray  # words of each row

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:
            data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
        return range_hash(prefix_hash(data), self.start, self.end)


def slices(column: pa.Array, is_word: np.ndarray | None = None) -> Iterator[Slice]:
    """Slices of a string column in row order; null is an empty text. ``is_word`` (256 booleans) can name other word bytes."""
    if is_word is None:
        is_word = np.ones(256, bool)
        is_word[[0x20, *range(0x09, 0x0E)]] = False
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        part = data[bounds[i] : bounds[j]]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = is_word[part]
        change = np.diff(inside)
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        ends = bounds[i + 1 : j + 1] - bounds[i]
        # a word never spans two texts: split the runs that touch a text border from both sides
        cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(part))]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        upto = np.searchsorted(start, ends, "left")
        yield Slice(i, j - i, part, ends, start, end, np.diff(np.concatenate([[0], upto])))
        i = j
