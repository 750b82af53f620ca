"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Entries become whole numbers, so counts and sums are exact. The fit list holds each distinct
vector once. One pass adds up its entries, a second one its centred products; tasks send one
row per pair of dimensions, which Spark adds up. The covariance, whose size depends on the
dimensions alone, comes to the driver. There a shift splits its spectrum: the polar factor
``U`` of the shifted matrix has the eigenvectors above the shift at +1 and the others at -1, so
``(U + 1) / 2`` projects on the former. A basis of either invariant subspace gives a smaller
symmetric matrix, and so on down to single components. The polar factors come from the
dynamically weighted Halley iteration in its QR form. Centre and components then go to
every task with the code, and one pass whitens all rows.

Defined results: rows whose vector is null or holds a null or a value that is not finite are
left out. A fit list without rows gives no rows. Components without variance have a null
``whitened`` and stand out of the identity error. An entry beyond 64 bits counts as the
nearest 64-bit number; a deviation beyond them is null. Vectors of several lengths raise
``ValueError``, as they share no space. Empty vectors have no components and give no rows.
Null and repeated ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import shared

#: Whole numbers per unit of an entry.
SCALE = 256.0
COMPONENTS = 4
_EPS = float(np.finfo(float).eps)
_LONG = 1 << 63


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix, by QDWH iterations with QR factors."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = _EPS / 8  # below every singular value that is not zero to working precision
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        last, x = x, (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:n] @ q[n:].T)
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if 1 - low < 10 * _EPS and np.linalg.norm(x - last) < _EPS ** (1 / 3):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvectors above a shift; None if all eigenvalues are equal."""
    n, centre = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - centre * np.eye(n)) / np.sqrt(n)
    size = max(np.linalg.norm(a), _EPS)
    if spread <= 4 * _EPS * size:
        return None
    best, rng = None, np.random.default_rng(1)
    # The mean of the eigenvalues lies between them; the others serve where it meets one of them.
    for off in (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.59):
        u = polar(a - (centre + off * spread) * np.eye(n))
        p = (u + u.T) / 4 + np.eye(n) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        basis = rng.standard_normal((n, k))
        for _ in range(3):
            basis, _ = np.linalg.qr(p @ basis)
        basis, _ = np.linalg.qr(basis, mode="complete")
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = (left, basis, k)
        if left <= 8 * n * _EPS * size:
            break
    return best and best[1:]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; the largest entry of each is positive."""

    def parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = _split(a) if len(a) > 1 else None
        if found is None:
            return np.diag(a).copy(), np.eye(len(a))
        basis, k = found
        sides = [parts((s + s.T) / 2) for s in (b.T @ a @ b for b in (basis[:, :k], basis[:, k:]))]
        return np.concatenate([e for e, _ in sides]), np.hstack([basis[:, :k] @ sides[0][1], basis[:, k:] @ sides[1][1]])

    values, vectors = parts((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    at = np.abs(vectors).argmax(axis=0) if len(a) else []
    return values, vectors * np.where(vectors[at, np.arange(len(a))] < 0, -1.0, 1.0)


@dataclass
class Model:
    """What whitening needs. ``sums`` are exact; ``weights`` has a column per component, zero where it has no variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    weights: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` with the whole part taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s % n, n)) for s in sums])
    near = np.abs(whole) < 1 << 61
    small = not len(x) or (near.all() and np.abs(x.astype(float)).max(initial=0) < 1 << 61)
    return (x - whole if small else x.astype(float) - whole) - rest


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python numbers; halves are added apart, so that nothing overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(h << 32) + v for h, v in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per dimension with the task's sum, and one at -1 with its rows."""
    n, total = 0, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            found = _exact_sums(x)
            n, total = n + len(x), found if total is None else [a + b for a, b in zip(total, found, strict=True)]
    if total is not None:
        values = [Decimal(v) for v in (n, *total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "total"]
        )


def _products(n: int, sums: list[int], weights: np.ndarray | None = None, centre: np.ndarray | None = None):
    """Per task the sums of products of centred (and whitened) columns at ``i <= j``, and of the columns at ``j = -1``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _centred(_matrix(batch.column("x")), n, sums)
            y = y if weights is None else y @ weights - centre
            found = np.vstack([y.T @ y, y.sum(axis=0)])
            total = found if total is None else total + found
        if total is not None:
            d = total.shape[1]
            i, j = np.triu_indices(d)
            i, j, v = np.r_[i, np.arange(d)], np.r_[j, np.full(d, -1)], np.r_[total[i, j], total[d]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], names=["i", "j", "total"])

    return work


def _covariance(fit_list: DataFrame, n: int, sums: list[int], size: int, **more) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and mean of the centred columns. One row per pair of dimensions comes to the driver."""
    parts = fit_list.mapInArrow(_products(n, sums, **more), "i int, j int, total double")
    out, mean = np.zeros((size, size)), np.zeros(size)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("total")).collect():
        if j < 0:
            mean[i] = v / n
        else:
            out[i, j] = out[j, i] = v / n
    return out, mean


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, x`` of the rows whose vector is complete and finite."""
    entries = F.col(vec_col).cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(vec_col).isNotNull() & ~odd).select(
        F.col(id_col).alias("id"), F.transform(entries, lambda c: F.floor(c * F.lit(SCALE))).alias("x")
    )


def fit(numbers: DataFrame, components: int = COMPONENTS) -> Model | None:
    """Model of the distinct ``x`` of ``numbers``; None if there are none or they are empty."""
    fit_list = shared.written(numbers.select("x").distinct(), "fit-list")
    low, high = fit_list.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} entries")
    if not high:
        return None
    # One row per dimension.
    totals = dict(fit_list.mapInArrow(_sums, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").cast("decimal(38,0)")).collect())
    n, sums = int(totals[-1]), [int(totals[i]) for i in range(high)]
    covariance, mean = _covariance(fit_list, n, sums, high)
    values, vectors = eigenvectors(covariance)
    k = min(components, high)
    some = values[:k] > high * 8 * _EPS * max(values[0], 0)
    weights = np.where(some, vectors[:, :k] / np.sqrt(np.where(some, values[:k], 1.0)), 0.0)
    trace = np.trace(covariance)
    model = Model(n, sums, values, vectors, values[:k] / trace if trace > 0 else np.full(k, np.nan), weights)
    seen, _ = _covariance(fit_list, n, sums, k, weights=weights, centre=mean @ weights)
    model.identity_error = float(np.abs(seen - np.diag(some.astype(float))).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """``sum((n * x - S) ** 2)`` per row, exact; in Python numbers where 64 bits might not do."""
    most = n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, sums))
    if most * most * x.shape[1] < _LONG:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(axis=1), pa.int64())
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return pa.array([v if v < _LONG else None for v in exact], pa.int64())


def _whitened(model: Model, kind: pa.DataType):
    names = ("id", "component", "n", "deviation", "whitened", "explained", "identity_error")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.weights.shape[1]
        none = ~model.weights.any(axis=0)
        for batch in batches:
            x = _matrix(batch.column("x"))
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), k))
            whitened = (model.centred(x) @ model.weights).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(kind).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    _deviations(x, model.n, model.sums).take(each),
                    pa.array(whitened, mask=np.tile(none, rows)),
                    pa.array(np.tile(model.explained, rows), from_pandas=True),
                    pa.array(np.full(rows * k, model.identity_error)),
                ],
                names=list(names),
            )

    return work


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors, then a row per vector and component."""
    numbers = whole_numbers(vectors, id_col, vec_col)
    model = fit(numbers, components)
    kind = numbers.schema["id"].dataType
    schema = f"id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return numbers.mapInArrow(_whitened(model, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``."""
    return whitened(shared.table(spark, sf_dir, "embeddings"))
