"""Whitening: the eigenvectors against numpy's, the query against exact sums and numpy, odd inputs."""

from __future__ import annotations

import math
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from tabgauge.llm import whitening

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [3.0, 1.0],
        [1.0] * 7,
        [4.0, 4.0, 4.0, 1.0, 1.0, 0.0],
        [0.0] * 4,
        [1e9, 1.0, 1e-9, 0.0, 0.0],
        [-3.0, -1.0, 0.0, 1.0, 3.0],
        list(np.linspace(1, 2, 64)),
        list(np.geomspace(1e-8, 1, 40)),
        [1.0 + 1e-13 * i for i in range(20)],
    ],
)
def test_eigenvectors(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    size = max(np.abs(values).max(), 1e-300)
    found, vectors = whitening.eigenvectors(a)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * len(values) * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13 * len(values)
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * len(values) * size


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((30, 30))
    u, _, v = np.linalg.svd(a)
    assert np.abs(whitening.polar(a) - u @ v).max() < 1e-12


def expected(rows, k=4):
    """Per row its exact deviation; the fit list's size, eigenvalues and eigenvectors by numpy."""
    kept = [(i, [math.floor(256.0 * float(c)) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        y = np.array([float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)])
        out.append((i, n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), [y @ vectors[:, c] / math.sqrt(values[c]) for c in range(k)]))
    return out, values / values.sum()


def same(found, rows, k=4):
    wanted, explained = expected(rows, k)
    signs = {}
    per_row = {}
    for r in found:
        per_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert len(found) == k * len(wanted)
    for i, n, deviation, whitened in wanted:
        mine = [r for r in per_row[i, deviation] if r["n"] == n]
        assert {r["component"] for r in mine} == set(range(1, k + 1))
        for r in mine:
            c = r["component"] - 1
            sign = signs.setdefault(c, 1 if r["whitened"] * whitened[c] >= 0 else -1)
            near = [abs(r["whitened"] * sign - w[c]) for j, _, d, w in wanted if (j, d) == (i, deviation)]
            assert min(near) < 1e-8
            assert abs(r["explained"] - explained[c]) <= 1e-9 * explained[c]
            assert r["identity_error"] < 1e-9


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are absent")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(str(DATA / "embeddings.parquet")).select("vec_id", "embedding").collect()]
    found = whitening.query(spark, str(DATA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(found.collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(200)]
    rows += [(900 + i, rows[3][1]) for i in range(80)] + [(None, rows[4][1]), (None, rows[5][1]), (7, rows[8][1])]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [math.nan] * 6), (1003, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, x string, component int")
    same(whitening.whitened(frame).collect(), rows)
    assert whitening.whitened(frame.filter("vec_id >= 1000")).collect() == []
    assert whitening.whitened(frame.limit(0)).columns[0] == "vec_id"


def test_no_variance_long_numbers_and_lengths(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 4
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0, -0.0]) for i in range(3)], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert all(r["identity_error"] < 1e-12 for r in flat)
    far = whitening.whitened(spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 3.0])], schema)).collect()
    assert {r["deviation"] for r in far if r["vec_id"] == 1} == {None}
    assert {r["deviation"] for r in far if r["vec_id"] == 3} == {(3 * 768 - 1024) ** 2}
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))
    assert whitening.whitened(spark.createDataFrame([(1, [])], schema)).collect() == []
