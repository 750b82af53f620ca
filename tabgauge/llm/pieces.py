"""Token ids of whole texts from the ids of their pieces, each distinct piece encoded once.

A piece is a run of bytes other than white space, cut between an ASCII letter and a mark
after it; if wanted, with the white space before it. White space is space and tab to
carriage return here, so that bytes decide.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

from . import words

#: Distinct pieces that a process remembers before it starts anew; some 60 bytes each.
REMEMBERED = 1_500_000


class PieceIds:
    """Ids by piece. ``encode`` takes a list of pieces and gives the ids of each."""

    def __init__(
        self, encode: Callable[[list[bytes]], Iterable[list[int]]], with_space: bool, lower: bool, remembered: int = REMEMBERED
    ) -> None:
        self.encode, self.with_space, self.lower, self.remembered = encode, with_space, lower, remembered
        self._clear()

    def _clear(self) -> None:
        self.known = words.Known()
        self.count = self.used = 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _add(self, found: Iterable[list[int]]) -> np.ndarray:
        # One list at a time: many of them at once keep Python's garbage collector busy.
        sizes, flat = array("q"), array("I")
        for ids in found:
            sizes.append(len(ids))
            flat.extend(ids)
        places = np.arange(self.count, self.count + len(sizes))
        self.count += len(sizes)
        if self.count > len(self.first):
            self.first.resize(2 * self.count, refcheck=False)
            self.size.resize(2 * self.count, refcheck=False)
        sizes, total = np.array(sizes, np.int64), len(flat)
        if self.used + total > len(self.ids):
            self.ids.resize(2 * (self.used + total), refcheck=False)
        self.ids[self.used : self.used + total] = flat
        self.first[places] = self.used + np.cumsum(sizes) - sizes
        self.size[places] = sizes
        self.used += total
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        found = words.split(texts, words.NOT_SPACE, lower=self.lower, cut=True)
        if self.with_space:
            found = _with_space(found)
        distinct, at, back = words.distinct(found.hashes())
        if self.count > self.remembered:
            self._clear()
        places = self.known.places(distinct, lambda new: self._add(self.encode(found.listed(at[new]))))[back]
        size, first = self.size[places].astype(np.int64), self.first[places]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first - ends + size, size) + np.arange(total)]
        return ids, np.r_[0, ends][found.bounds]


def _with_space(found: words.Words) -> words.Words:
    """Each word with the white space before it; what follows the last word of a text stands alone."""
    lo, hi = found.bounds[:-1], found.bounds[1:]
    some = hi > lo
    before = np.empty_like(found.starts)
    before[1:] = found.ends[:-1]
    before[lo[some]] = found.offsets[:-1][some]
    last = np.where(some, 0, found.offsets[:-1])
    last[some] = found.ends[hi[some] - 1]
    tail = last < found.offsets[1:]
    starts = np.insert(before, hi[tail], last[tail])
    ends = np.insert(found.ends, hi[tail], found.offsets[1:][tail])
    bounds = found.bounds + np.r_[0, np.cumsum(tail)]
    return words.Words(found.data, starts, ends, bounds, found.offsets)
