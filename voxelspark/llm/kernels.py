"""Numpy kernels over the buffers of an Arrow text column.

A kernel sees one slice of a record batch: the UTF-8 bytes of some whole texts,
laid end to end, with the offset of each text.  Slices hold about ``SLICE_BYTES``
(one text at least), so the memory of a task does not depend on the batch size.

Every hash is the same polynomial over 2**64 with random byte values: from a
prefix sum, the hash of any stretch takes one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

U64 = np.uint64
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, kept up to ``KEPT`` and computed anew for what is longer."""

    KEPT = 1 << 20

    def __init__(self) -> None:
        self._held = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._held[0]) > n:
            return self._held
        made = []
        with np.errstate(over="ignore"):
            for base in (_BASE, _BASE_INVERSE):
                values = np.full(max(n + 1, 1 << 16), base, U64)
                values[0] = 1
                made.append(np.multiply.accumulate(values))
        if n < self.KEPT:
            self._held = made[0], made[1]
        return made[0], made[1]


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all others."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U64(33))
        h = h * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


class Prefix:
    """Prefix sums over bytes or over hashes; ``of`` hashes stretches [start, end)."""

    def __init__(self, values: np.ndarray) -> None:
        values = _BYTE_VALUES[values] if values.dtype == np.uint8 else values
        up, self._down = _POWERS.get(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def sliding(self, width: int) -> np.ndarray:
        """Hash of every stretch of ``width`` items."""
        n = len(self._sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


class Slice(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts; offsets[0] == 0

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column (null: empty) into slices of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield Slice(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``, and of words of lower-cased ASCII letters, digits and all beyond ASCII.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    doc: np.ndarray  # row in the slice
    first: np.ndarray  # first word of each row, and the number of words


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> Words:
    """Maximal runs of the bytes in ``of``, never across texts."""
    inside = of[data]
    n = len(data)
    edge = offsets[(offsets > 0) & (offsets < n)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, doc, first)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first - (np.cumsum(count) - count), count)
    return shift + np.arange(total)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of the items in [start, start + width) of any start."""
    delta = np.zeros(size + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, size), -1)
    return np.cumsum(delta[:size]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[width - have : width - have + n])
