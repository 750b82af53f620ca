from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import tabgauge as tg
from tabgauge.operators import comoments, correlation, report


def matrix(df):
    return {(r["col_1"], r["col_2"]): r["r"] for r in df.collect()}


def test_linear_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 10.0 * i) for i in range(1, 5)], "target double, a double, b double")
    found = matrix(tg.pearson_long(df))
    assert len(found) == 9
    assert all(r == pytest.approx(1.0) for r in found.values())
    long = tg.pearson_long(df)
    assert tg.pearson_value(long, "target", "a") == pytest.approx(1.0)
    with pytest.warns(UserWarning, match="not found"):
        assert tg.pearson_value(long, "target", "not_a_col") is None


@pytest.mark.parametrize("limit", [3, 1])
def test_constant_columns_are_nan_on_the_diagonal_too(spark, limit):
    df = spark.createDataFrame([(1, 2, 3)] * limit, "a bigint, b bigint, c bigint")
    assert all(math.isnan(r) for r in matrix(tg.pearson_long(df)).values())


def test_empty_table(spark):
    found = matrix(tg.pearson_long(spark.createDataFrame([], "a double, b double")))
    assert len(found) == 4 and all(math.isnan(r) for r in found.values())


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("x",)], "s string")
    with pytest.warns(UserWarning, match="No numeric features"):
        assert tg.pearson_long(df).count() == 0
    info = tg.profile_table(df).table.first()["info"]
    assert "No correlation matrix available." in info


def test_many_columns_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(comoments, "TILE", 3)
    generator = np.random.default_rng(2)
    data = generator.normal(size=(200, 7)) @ generator.normal(size=(7, 7)) * 1e3 + 1e5
    df = spark.createDataFrame(data.tolist(), ", ".join(f"c{i} double" for i in range(7)))
    found = matrix(tg.pearson_long(df))
    expected = np.corrcoef(data.T)
    assert len(found) == 49
    for i in range(7):
        for j in range(7):
            assert found[f"c{i}", f"c{j}"] == pytest.approx(expected[i, j], abs=1e-9)


def test_missing_values(spark):
    values = [(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (4.0, float("nan"), 7.0), (5.0, 1.0, 1.0)]
    df = spark.createDataFrame(values, "a double, b double, c double")
    pairwise = matrix(tg.pearson_long(df))
    assert pairwise["a", "b"] == pytest.approx(np.corrcoef([1, 3, 5], [2, 5, 1])[0, 1])
    # c is constant on the rows where b is present.
    assert math.isnan(pairwise["c", "b"])
    strict = matrix(tg.pearson_long(df, missing="propagate"))
    assert math.isnan(strict["a", "b"]) and math.isnan(strict["b", "b"])
    assert strict["a", "c"] == pytest.approx(pairwise["a", "c"])
    with pytest.raises(ValueError, match="pairwise"):
        tg.pearson_long(df, missing="drop")


def test_wide_and_strong(spark):
    df = spark.range(10).selectExpr("id as a", "id * 2 as b", "-id as c", "id % 2 as d")
    long = tg.pearson_long(df)
    wide = tg.pearson_wide(long, ["a", "b", "c", "d"])
    assert wide.columns == ["index", "a", "b", "c", "d"]
    assert [r["index"] for r in wide.collect()] == ["a", "b", "c", "d"]
    strong = tg.strong_correlations(long).collect()
    assert [(r["col_1"], r["col_2"]) for r in strong] == [("a", "b"), ("a", "c"), ("b", "c")]


@pytest.mark.parametrize("far", [1e12, 1e18, 1e100])
def test_a_far_value_outside_the_rows_of_a_pair(spark, far):
    df = spark.range(1000).selectExpr(
        "if(id = 999, null, double(id)) as a", f"if(id = 999, {far}D, id * 2D) as b", "pmod(hash(id), 1000) as c"
    )
    found = matrix(tg.pearson_long(df))
    assert found["a", "b"] == pytest.approx(1.0, abs=1e-12)
    rows = df.filter("a is not null")
    assert found["a", "c"] == pytest.approx(rows.selectExpr("corr(a, c)").first()[0], abs=1e-9)
    assert found["b", "c"] == pytest.approx(df.selectExpr("corr(b, c)").first()[0], abs=1e-9)


def test_infinities_touch_only_pairs_that_hold_them(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, inf, 1.0), (4.0, 5.0, 3.0), (3.0, 1.0, 9.0)], "a double, b double, c double")
    found = matrix(tg.pearson_long(df))
    assert math.isnan(found["a", "b"]) and math.isnan(found["b", "b"])
    assert found["a", "c"] == pytest.approx(np.corrcoef([2, 4, 3], [1, 3, 9])[0, 1])


@pytest.mark.parametrize("columns", [12, 100])
def test_one_scan_for_any_number_of_columns(spark, columns):
    df = spark.range(50).selectExpr(*(f"if(id % {i + 3} = 0, null, double(hash(id, {i}))) as c{i}" for i in range(columns)))
    long = tg.pearson_long(df)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    found = matrix(long)
    data = np.array([[np.nan if v is None else v for v in row] for row in df.collect()])
    for i, j in ((0, 1), (3, 11), (0, columns - 1)):
        rows = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
        assert found[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(data[rows, i], data[rows, j])[0, 1], abs=1e-9)


@pytest.mark.parametrize("tasks", [1, 2, 9])
def test_tiles_merge_in_as_many_levels_as_tasks_need(spark, monkeypatch, tasks):
    monkeypatch.setattr(comoments, "FAN", 2)
    df = spark.range(0, 900, 1, tasks).selectExpr(*(f"if(id % {i + 3} = 0, null, double(hash(id, {i}))) as c{i}" for i in range(5)))
    long = tg.pearson_long(df)
    # One group-wise step per level: 9 tasks make 5 groups, then 3, 2 and 1.
    assert long._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == {1: 1, 2: 1, 9: 4}[tasks]
    found = matrix(long)
    data = np.array([[np.nan if v is None else v for v in row] for row in df.collect()])
    for i in range(5):
        for j in range(5):
            rows = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            assert found[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(data[rows, i], data[rows, j])[0, 1], abs=1e-9)


def test_five_thousand_columns_in_two_gigabytes(monkeypatch):
    generator = np.random.default_rng(3)
    data = generator.normal(size=(60, 5000))
    data[::7, ::11] = np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in data.T], names=[f"x{i}" for i in range(5000)])
    monkeypatch.setattr(comoments, "SLICE_VALUES", 5000 * 40)
    tracemalloc.start()
    checked = 0
    for out in comoments._scan(comoments.TILE)(iter([batch])):
        i, j = out.column("i")[0].as_py(), out.column("j")[0].as_py()
        if (i, j) in ((0, 0), (0, 78), (40, 41)):
            r = comoments.Moments.unpack(out.column("data")[0].as_py()).correlation()
            a, b = data[:, 64 * i], data[:, 64 * j + 5]
            rows = ~np.isnan(a) & ~np.isnan(b)
            assert r[0, 5] == pytest.approx(np.corrcoef(a[rows], b[rows])[0, 1], abs=1e-9)
            checked += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert checked == 3 and peak < 2 << 30


def test_equal_pairs_come_by_position_whatever_the_order_of_sums(spark):
    rows = [("a", "d", 0, 3, 1.0 - 2**-53), ("b", "c", 1, 2, -1.0), ("b", "d", 1, 3, 0.9)]
    long = spark.createDataFrame(rows, correlation.PEARSON_SCHEMA)
    strong = tg.strong_correlations(long).collect()
    assert [(r["col_1"], r["col_2"]) for r in strong] == [("a", "d"), ("b", "c"), ("b", "d")]
    listed = report.correlation_text(long).first()["correlation_text"]
    assert listed.split("\n")[1:] == ["- a & d: r = 1.00", "- b & c: r = -1.00", "- b & d: r = 0.90"]
