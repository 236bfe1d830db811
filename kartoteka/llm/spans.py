"""Words, lines and hashes of many texts at once, as arrays over their bytes.

A slice holds whole texts only, at most `SLICE` bytes unless one text alone is longer, so that
the memory of a task follows its longest text and not the size of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

# White space is \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(characters: str) -> np.ndarray:
    """Which bytes are one of the given ASCII characters."""
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the rolling base, kept for the longest slice so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, SLICE + 1)
            cls.up, cls.down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        return cls.up[:n], cls.down[:n]


@dataclass
class Texts:
    """Texts `first` to `last` of a batch: text i has the bytes offsets[i] to offsets[i + 1]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def lowered(self) -> Texts:
        """With A-Z in lower case; other letters stay."""
        return Texts(self.first, self.last, _LOWER[self.data], self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, by text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def _in_word(self) -> np.ndarray:
        return ~_SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words; no word reaches over the end of its text."""
        inside = self._in_word
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Text i has the words bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def word_owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.word_bounds))

    def cut_after(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts that positions (just past a part) cut all bytes into."""
        at = np.unique(np.concatenate([ends, self.offsets]))
        return at[:-1], at[1:]

    @cached_property
    def _rolling(self) -> np.ndarray:
        up, _ = _Powers.of(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they are."""
        _, down = _Powers.of(len(self.data) + 1)
        raw = (self._rolling[ends] - self._rolling[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.words)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of `size` words that lies in one text."""
        count = len(self.word_hashes) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owner = self.word_owner
        first = np.flatnonzero(owner[:count] == owner[size - 1:])
        return first, run_hashes(self.word_hashes, first, size)


def run_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` hashes in a row, from each of the given places on."""
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[first + k]
    return mix(out + np.uint64(size))


def whole_hash(hashes: np.ndarray) -> int:
    """Hash of a sequence of hashes shorter than a window."""
    return int(run_hashes(hashes, np.zeros(1, np.int64), len(hashes))[0])


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of a column in slices of whole texts."""
    column = as_strings(column)
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Texts(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last
