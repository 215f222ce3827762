"""Words, windows and hashes of Arrow text columns, computed with numpy inside Spark tasks.

Texts are handled as UTF-8 bytes. Work goes slice by slice, a slice being whole documents of about one
megabyte, so that memory follows the longest document and not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Odd multipliers of the polynomial hashes modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93

BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: Words of [^\x20\x09-\x0D]+.
SPACED = ~BLANKS
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE * 2)
            self.up, self.down = (_series(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTES, WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near sums do not stay near."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hash(values: np.ndarray, size: int, powers: _Powers) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; one shorter than the values by size - 1."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every run of ``size`` values, by doubling."""
    if len(values) < size:
        return values[:0]
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < size:
        values = np.minimum(values[: len(values) - (size - span)], values[size - span :])
    return values


@dataclass
class Slice:
    """Whole documents ``first`` to ``last`` of a batch; ``bounds`` are their byte limits in ``data``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def docs(self) -> int:
        return self.last - self.first


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """Byte slices of a string column in order; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunks
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield Slice(i, j, body[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


@dataclass
class Words:
    """The words of a slice: byte limits, and for each document the range of its words."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # words before each document, and in all

    def hashes(self, data: np.ndarray) -> np.ndarray:
        _, down = BYTES.get(len(data) + 1)
        up = BYTES.up[: len(data)]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))

    def starts_of(self, size: int) -> np.ndarray:
        """Words at which a window of ``size`` words of one document starts."""
        room = np.repeat(self.doc[1:], np.diff(self.doc)) - np.arange(len(self.start))
        return np.flatnonzero(room >= size)


def words(data: np.ndarray, bounds: np.ndarray, alphabet: np.ndarray) -> Words:
    """Maximal runs of bytes of the alphabet; a run ends at the end of its document."""
    inside = alphabet[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = bounds[:-1]
    cuts = cuts[cuts < len(data)]
    fresh = inside & ~before
    fresh[cuts] = inside[cuts]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = inside & ~after
    ends = bounds[1:-1]
    ends = ends[ends > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, bounds))


def pieces(limits: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Number of covered items per range of ``limits``."""
    total = np.zeros(len(covered) + 1, np.int64)
    np.cumsum(covered, out=total[1:])
    return total[limits[1:]] - total[limits[:-1]]


def cover(length: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of ``length`` items lie in a run of ``size`` items from any of ``starts``."""
    if not len(starts):
        return np.zeros(length, bool)
    change = np.bincount(starts, minlength=length + 1)
    change -= np.bincount(starts + size, minlength=length + 1)
    return np.cumsum(change[:-1]) > 0


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of a byte matrix."""
    up, _ = BYTES.get(rows.shape[1] + 1)
    return mix(((rows.astype(np.uint64) + np.uint64(1)) * up[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


def give_back() -> None:
    """Return free memory to the system: workers stay between tasks, and the next stage needs what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(function: Callable) -> Callable:
    """A task function over batches that gives memory back when it is through."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run
