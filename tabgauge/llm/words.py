"""Words of whole Arrow columns of text, split and hashed with array operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, or one text if it is longer.
SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_table(inside: str) -> np.ndarray:
    """True for the bytes of the ASCII characters in ``inside`` and for all bytes above 127."""
    table = np.zeros(256, bool)
    table[128:] = True
    table[np.frombuffer(inside.encode("ascii"), np.uint8)] = True
    return table


#: Bytes that are no white space (space, and tab to carriage return).
NOT_SPACE = byte_table("".join(chr(b) for b in range(128) if b != 0x20 and not 9 <= b <= 13))
#: Letters, digits and everything beyond ASCII, after lower-casing.
WORD_CHARS = byte_table("0123456789abcdefghijklmnopqrstuvwxyz")

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))  # a copy, worked on in place
    x *= _FIRST
    x ^= x >> np.uint64(27)
    x *= _SECOND
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    start = np.uint64(seed * 2654435761 % (1 << 63))
    return mix((np.arange(1, n + 1, dtype=np.uint64) + start) * np.uint64(_ODD))


_BYTE_VALUES = seeded(256, 11)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@dataclass
class Words:
    """Words of a slice of texts. ``bounds[i]:bounds[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the same wherever the word stands."""
        size = 1 << max(20, int(len(self.data)).bit_length())
        power, inverse = _powers(size)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def listed(self, at: np.ndarray) -> list[bytes]:
        """The words at some places."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each stands first, and the place of every value among them.

    As ``np.unique`` gives them, but only distinct values are sorted; the others are looked up in Arrow's table.
    """
    found = pa.array(values).dictionary_encode()
    codes = found.indices.to_numpy()
    # Arrow lists values in the order in which they are first met.
    most = np.maximum.accumulate(codes)
    first = np.flatnonzero(np.r_[True, most[1:] != most[:-1]]) if len(codes) else np.zeros(0, np.int64)
    order = np.argsort(values[first])
    first = first[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[first], first, rank[codes]


class Known:
    """Places by hash, as two sorted arrays; 16 bytes each."""

    def __init__(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, distinct: np.ndarray, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Places of sorted distinct hashes. ``add`` takes a mask of the new ones and gives their places."""
        where = np.searchsorted(self.keys, distinct)
        old = np.zeros(len(distinct), bool)
        if len(self.keys):
            old = self.keys[np.minimum(where, len(self.keys) - 1)] == distinct
        out = np.empty(len(distinct), np.int64)
        out[old] = self.at[where[old]]
        if not old.all():
            out[~old] = add(~old)
            self.keys = np.insert(self.keys, where[~old], distinct[~old])
            self.at = np.insert(self.at, where[~old], out[~old])
        return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    offsets = _offsets(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def texts_of(column: pa.Array) -> pa.Array:
    """The column as text without nulls, whatever its type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[1], np.int32)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins."""
    offsets = _offsets(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_with(texts: pa.Array, sign: bytes) -> list[int]:
    """Texts that hold ``sign``, two bytes or more."""
    data, offsets = raw_bytes(texts)
    at = np.flatnonzero((data[:-1] == sign[0]) & (data[1:] == sign[1]))
    at = at[[data[i : i + len(sign)].tobytes() == sign for i in at.tolist()]] if len(sign) > 2 and len(at) else at
    inside = np.searchsorted(offsets, at, side="right") - 1
    return np.unique(inside[at + len(sign) <= offsets[inside + 1]]).tolist()


def split(texts: pa.Array, inside: np.ndarray, lower: bool = True, cut: bool = False) -> Words:
    """Maximal runs of bytes that ``inside`` marks; no word spans two texts.

    With ``cut``, runs also end between an ASCII letter and an ASCII mark after it.
    """
    data, offsets = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    mask = inside[data]
    n = len(mask)
    begins, ends = mask.copy(), mask.copy()
    if n:
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begins[1:] &= ~mask[:-1]
        begins[cuts] = mask[cuts]
        ends[:-1] &= ~mask[1:]
        ends[cuts - 1] = mask[cuts - 1]
        if cut:
            at = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]])
            ends[at] = True
            begins[at + 1] = True
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets), offsets)
