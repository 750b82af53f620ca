"""Co-moments of all pairs of columns over the rows where both are present, in one scan.

Every task turns its Arrow batches into matrix products of values and presence masks, tile by
tile, and merges the results; it holds each pair of columns once, and few rows at a time. Tasks hand
over one packed row per tile of columns. Tiles are merged in groups of ``FAN`` tasks, groups in
groups again, in as many levels as the tasks need, so that no group grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.tasks import FAN, tasks_of

#: Columns per side of a tile.
TILE = 64
#: Values of a slice of rows at most; some six arrays of this size are held at once.
SLICE_VALUES = 1 << 23
# Share of the raw squares below which the difference has lost too many digits.
_LOST = 1e-8
# Spread against the mean, per value, up to which a column counts as constant.
_CONSTANT = 1e-13


@dataclass
class Moments:
    """Of every pair ``(i, j)``: rows, mean and squared deviations of ``i`` and of ``j``, and products.

    Means are relative to ``ref_a`` and ``ref_b``; ``odd`` counts rows with an infinity.
    """

    ref_a: np.ndarray
    ref_b: np.ndarray
    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    m_a: np.ndarray
    m_b: np.ndarray
    c: np.ndarray
    odd: np.ndarray

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        safe = np.maximum(n, 1)
        share = other.n / safe
        shift_a = other.mean_a + (other.ref_a - self.ref_a)[:, None]
        shift_b = other.mean_b + (other.ref_b - self.ref_b)[None, :]
        # An empty side has no mean to differ from.
        both = (self.n > 0) & (other.n > 0)
        d_a, d_b = np.where(both, shift_a - self.mean_a, 0.0), np.where(both, shift_b - self.mean_b, 0.0)
        weight = self.n * share
        first = self.n > 0
        return Moments(
            self.ref_a,
            self.ref_b,
            n,
            np.where(first, self.mean_a + d_a * share, np.where(other.n > 0, shift_a, 0.0)),
            np.where(first, self.mean_b + d_b * share, np.where(other.n > 0, shift_b, 0.0)),
            self.m_a + other.m_a + d_a * d_a * weight,
            self.m_b + other.m_b + d_b * d_b * weight,
            self.c + other.c + d_a * d_b * weight,
            self.odd + other.odd,
        )

    def pack(self) -> bytes:
        grids = (self.n, self.mean_a, self.mean_b, self.m_a, self.m_b, self.c, self.odd)
        shape = np.array(self.n.shape, np.float64)
        return b"".join(np.ascontiguousarray(x, np.float64).tobytes() for x in (shape, self.ref_a, self.ref_b, *grids))

    @staticmethod
    def unpack(data: bytes) -> Moments:
        values = np.frombuffer(data, np.float64)
        a, b = int(values[0]), int(values[1])
        grids = values[2 + a + b :].reshape(7, a, b)
        return Moments(values[2 : 2 + a], values[2 + a : 2 + a + b], *grids)

    def correlation(self) -> np.ndarray:
        """Pearson's r; NaN where a side is constant on the pair's rows or an infinity is among them."""
        least_a, least_b = self.n * (_CONSTANT * self.mean_a) ** 2, self.n * (_CONSTANT * self.mean_b) ** 2
        varied = (self.m_a > least_a) & (self.m_b > least_b) & (self.odd == 0) & (self.n > 1)
        spread = np.sqrt(np.where(varied, self.m_a, 1.0)) * np.sqrt(np.where(varied, self.m_b, 1.0))
        return np.where(varied & (spread > 0), np.clip(self.c / np.where(spread > 0, spread, 1.0), -1.0, 1.0), np.nan)


class Slice:
    """A few rows, centred; moments of any two ranges of columns. NaN is missing."""

    def __init__(self, values: np.ndarray) -> None:
        here = ~np.isnan(values)
        infinite = np.isinf(values)
        self.usable = here & ~infinite
        some = self.usable.any(0)
        self.centre = np.zeros(values.shape[1])
        if some.any():
            # The median keeps a far value from taking the digits of the others.
            self.centre[some] = np.nanmedian(np.where(self.usable[:, some], values[:, some], np.nan), axis=0)
        self.x = np.where(self.usable, values - self.centre, 0.0)
        self.mask = self.usable.astype(np.float64)
        self.odd = (infinite.astype(np.float64), here.astype(np.float64)) if infinite.any() else None

    def moments(self, a: slice, b: slice) -> Moments:
        x_a, x_b, in_a, in_b = self.x[:, a], self.x[:, b], self.mask[:, a], self.mask[:, b]
        n = in_a.T @ in_b
        safe = np.maximum(n, 1)
        sums_a, sums_b = x_a.T @ in_b, in_a.T @ x_b
        squares_a, squares_b = (x_a * x_a).T @ in_b, in_a.T @ (x_b * x_b)
        mean_a, mean_b = sums_a / safe, sums_b / safe
        m_a, m_b = np.maximum(squares_a - sums_a * mean_a, 0.0), np.maximum(squares_b - sums_b * mean_b, 0.0)
        c = x_a.T @ x_b - sums_a * mean_b
        lost = (m_a < _LOST * squares_a) | (m_b < _LOST * squares_b)
        for i, j in zip(*np.nonzero(lost), strict=True):
            rows = self.usable[:, a][:, i] & self.usable[:, b][:, j]
            own, other = x_a[rows, i], x_b[rows, j]
            own, other = own - own[0], other - other[0]
            own, other = own - own.mean(), other - other.mean()
            m_a[i, j], m_b[i, j], c[i, j] = own @ own, other @ other, own @ other
        odd = np.zeros_like(n)
        if self.odd:
            bad, present = self.odd
            odd = bad[:, a].T @ present[:, b] + present[:, a].T @ bad[:, b]
        return Moments(self.centre[a], self.centre[b], n, mean_a, mean_b, m_a, m_b, c, odd)


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            width = batch.num_columns
            cuts = [slice(i, min(i + size, width)) for i in range(0, width, size)]
            rows = max(1, SLICE_VALUES // width)
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                with np.errstate(all="ignore"):
                    own = Slice(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns]))
                    for i in range(len(cuts)):
                        for j in range(i, len(cuts)):
                            tile = own.moments(cuts[i], cuts[j])
                            found[i, j] = found[i, j].merge(tile) if (i, j) in found else tile
        for i, j in list(found):
            data = found.pop((i, j)).pack()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([data], pa.binary())], names=["i", "j", "data"])

    return run


def _merged(table: pa.Table) -> Moments:
    found = None
    for data in table.column("data").to_pylist():
        own = Moments.unpack(data)
        with np.errstate(all="ignore"):
            found = own if found is None else found.merge(own)
    return found


def _together(table: pa.Table) -> pa.Table:
    keys = {c: table.column(c)[:1] for c in ("i", "j", "part")}
    return pa.table({**keys, "data": pa.array([_merged(table).pack()], pa.binary())})


def correlations(frame: DataFrame, scales: Sequence[float]) -> DataFrame:
    """``pos_1, pos_2, r`` of the columns of ``frame`` (doubles), with ``pos_1 <= pos_2``.

    Each column is multiplied by its scale first, a power of two, so that squares of large
    numbers do not overflow and no digit changes.
    """
    size = TILE
    scaled = frame.select(*[(F.col(f"`{c}`") * F.lit(s)).alias(f"x{i}") for i, (c, s) in enumerate(zip(frame.columns, scales, strict=True))])
    groups = -(-tasks_of(scaled) // FAN)
    tiles = scaled.mapInArrow(_scan(size), "i int, j int, data binary").withColumn("part", F.expr(f"bigint(spark_partition_id() div {FAN})"))
    while groups > 1:
        merged = tiles.groupBy("i", "j", "part").applyInArrow(_together, "i int, j int, part bigint, data binary")
        tiles = merged.withColumn("part", F.expr(f"part div {FAN}"))
        groups = -(-groups // FAN)

    def last(table: pa.Table) -> pa.Table:
        r = _merged(table).correlation()
        i, j = table.column("i")[0].as_py() * size, table.column("j")[0].as_py() * size
        a, b = (x.ravel() for x in np.indices(r.shape))
        keep = (a + i) <= (b + j)
        return pa.table({"pos_1": (a + i)[keep].astype(np.int32), "pos_2": (b + j)[keep].astype(np.int32), "r": r.ravel()[keep]})

    return tiles.groupBy("i", "j").applyInArrow(last, "pos_1 int, pos_2 int, r double")
