"""Runs of letters of many texts at once, lower-cased, as arrays over code points."""

from __future__ import annotations

import unicodedata
from typing import Any

import numpy as np
from pyspark import Broadcast

from kartoteka.llm.spans import Texts, mix


def letter_tables() -> np.ndarray:
    """For every code point its lower-case form if that is one code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def tables(shared: Broadcast) -> dict[str, Any]:
    """The broadcast values, with the letter table, which each worker process makes once."""
    if "letters" not in shared.value:
        shared.value["letters"] = letter_tables()
    return shared.value


class LetterRuns:
    """Maximal runs of letters; run r of text i is at starts[r] to ends[r] of `points`."""

    def __init__(self, texts: Texts, letters: np.ndarray, longest: int | None = None):
        """`longest` cuts longer runs into parts of that many letters."""
        raw = texts.data
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        points = raw if len(at) == len(raw) else np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        lowered = letters[points]
        bounds = np.searchsorted(at, texts.offsets)
        inside = lowered > 0
        n = len(points)
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        first = inside & (np.concatenate([[False], ~inside[:-1]]) | cut[:-1]) if n else np.zeros(0, bool)
        if n:
            first[0] = inside[0]
        last = inside & (np.concatenate([~inside[1:], [True]]) | cut[1:]) if n else np.zeros(0, bool)
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if longest is not None and len(starts) and (ends - starts).max() > longest:
            parts = -(-(ends - starts) // longest)
            place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = np.repeat(starts, parts) + place * longest
            ends = np.minimum(np.repeat(ends, parts), starts + longest)
        self.points = lowered
        self.view = Texts(texts.first, texts.last, lowered, bounds)
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(starts, bounds)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Hash of each run, or of its first letters."""
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        return self.view.hashes(self.starts, ends)


class HashTable:
    """Open addressing from 64-bit hashes to their place in the list that was given."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (3 * len(keys) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo, keys = np.arange(len(keys)), np.asarray(keys, np.uint64)
        slots = self._slot(keys)
        while len(todo):
            _, chosen = np.unique(slots, return_index=True)
            chosen = chosen[self.values[slots[chosen]] < 0]
            self.keys[slots[chosen]], self.values[slots[chosen]] = keys[todo[chosen]], todo[chosen]
            left = np.ones(len(todo), bool)
            left[chosen] = False
            todo, slots = todo[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        slots = self._slot(keys)
        out = self.values[slots]
        todo = np.flatnonzero((out >= 0) & (self.keys[slots] != keys))
        while len(todo):
            at = slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.values[at]
            todo = todo[(out[todo] >= 0) & (self.keys[at] != keys[todo])]
        return out
