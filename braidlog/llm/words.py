"""Words of many texts at once: spans and hashes over the bytes of an Arrow string column, without a loop over texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Of a block of texts: data bytes; start and end of each word in it; the text each word is in; number of texts; where in data each text ends."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    texts: int
    ends: np.ndarray

    def first_of_text(self) -> np.ndarray:
        """For each text, the index of its first word, and at last the number of words."""
        return np.searchsorted(self.text, np.arange(self.texts + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = 1 << max(10, int(len(self.data)).bit_length())
        sums = np.append(np.uint64(0), np.cumsum(_byte_values()[self.data] * _powers(size, _ODD)[: len(self.data)]))
        return mix((sums[self.end] - sums[self.start]) * _powers(size, _INVERSE)[self.start] + (self.end - self.start).astype(np.uint64))


def words_of(texts: pa.Array) -> Words:
    """Words are runs of other characters than [\\x20\\x09-\\x0D]; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if len(data):  # texts end words too
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(bounds, start, side="right") - 1, len(texts), bounds[1:])


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 text with ASCII and Latin-1 letters lower-cased."""
    out = _LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[latin] += 32
    return out


def blocks_of(column: pa.Array, most_bytes: int = 1 << 19, most_texts: int = 4096) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of runs of about most_bytes, so that memory doesn't follow the batch."""
    sizes = np.cumsum(np.append(0, np.asarray(pa.compute.binary_length(column).fill_null(0)))) if len(column) else np.zeros(1)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(sizes, sizes[at] + most_bytes, side="left"))
        to = min(len(column), max(at + 1, to), at + most_texts)
        yield at, column.slice(at, to - at)
        at = to
