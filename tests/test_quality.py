from __future__ import annotations

from datetime import date, datetime

import pytest

import tabgauge as tg

NAN, INF = float("nan"), float("inf")


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"col {kind}")


def test_nan_is_an_outlier_and_all_rows_count(spark, rows):
    df = column(spark, [1.0, None, 2.0, NAN, 3.0, 999.0, None], "double")
    found = rows(tg.outliers_zscore(df))["col"]
    assert found["outlier_count"] == 1
    assert found["outlier_rate"] == pytest.approx(1 / 7)
    assert found["has_low_variation"] is False


def test_thresholds(spark, rows):
    df = column(spark, [1.0, 1.0, 1.0, 10.0], "double")
    found = rows(tg.outliers_zscore(df, zscore=1.0, variance=1.0))["col"]
    assert (found["outlier_count"], found["outlier_rate"]) == (1, 0.25)
    assert found["has_low_variation"] is False
    with pytest.raises(ValueError, match="negative"):
        tg.outliers_zscore(df, zscore=-1.0)
    with pytest.raises(ValueError, match="0..1"):
        tg.outliers_zscore(df, variance=2.0)


def test_given_stats_are_used_and_strict(spark, rows):
    df = column(spark, [2.0, 3.0], "double")
    given = spark.createDataFrame([("col", 2.5, 0.5)], "column string, mean double, std double")
    found = rows(tg.outliers_zscore(df, zscore=1.0, variance=0.1, stats=given))["col"]
    assert (found["outlier_count"], found["has_low_variation"]) == (0, False)


def test_constant_number_has_no_outliers(spark, rows):
    found = rows(tg.outliers_zscore(column(spark, [4.0] * 5, "double")))["col"]
    assert (found["outlier_count"], found["has_low_variation"]) == (0, True)


def test_infinity_makes_every_distance_undefined(spark, rows):
    found = rows(tg.outliers_zscore(column(spark, [1.0, 2.0, INF, None], "double")))["col"]
    assert found["outlier_count"] == 3
    profile = rows(tg.profile_table(column(spark, [1.0, 2.0, INF, None], "double")).columns)["col"]
    assert profile["outlier_count"] == 3


@pytest.mark.parametrize(
    ("values", "low"),
    [
        (["a"] * 8 + ["b"] * 2, False),
        (["x"] * 10, True),
        (["a", "b", "c", "a"], False),
        (["a", None, "a", "a", None, "c", "a", "b"] + ["a"] * 50, True),
        ([None] * 9 + ["a"], True),
    ],
)
def test_dominant_category(spark, rows, values, low):
    found = rows(tg.low_variation_categorical(column(spark, values, "string")))["col"]
    assert (found["outlier_count"], found["outlier_rate"]) == (0, 0.0)
    assert found["has_low_variation"] is low


@pytest.mark.parametrize(
    ("values", "low"),
    [([True] * 9 + [False], True), ([True] * 8 + [False] * 2, False), ([None] * 9 + [True], True)],
)
def test_dominant_flag(spark, rows, values, low):
    found = rows(tg.low_variation_boolean(column(spark, values, "boolean")))["col"]
    assert found["has_low_variation"] is low


DAYS = [date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 3), date(2030, 10, 10)]


@pytest.mark.parametrize(
    ("values", "kind", "outliers", "low"),
    [
        (DAYS, "date", 1, False),
        ([*DAYS, None, None], "date", 1, False),
        ([datetime(d.year, d.month, d.day, 12) for d in DAYS], "timestamp", 1, False),
        ([datetime(d.year, d.month, d.day, 12) for d in DAYS], "timestamp_ntz", 1, False),
        ([date(2021, 6, 1)] * 5, "date", 0, True),
        ([date(2021, 6, 1)] * 5 + [None], "date", 0, False),
        ([None, None], "date", 0, True),
        ([datetime(1950, 1, 1), *[datetime(1969, 12, 31, 23, 59, s) for s in range(9)]], "timestamp", 1, False),
    ],
)
def test_temporal_fences(spark, rows, values, kind, outliers, low):
    found = rows(tg.outliers_iqr_temporal(column(spark, values, kind)))["col"]
    assert found["outlier_count"] == outliers
    assert found["outlier_rate"] == pytest.approx(outliers / len(values))
    assert found["has_low_variation"] is low


def test_all_missing_has_defaults(spark, rows):
    df = spark.sql("select cast(null as double) x, cast(null as string) s, cast(null as boolean) b, cast(null as date) d, null as v from range(3)")
    found = rows(tg.data_quality(df))
    for name in "xsbd":
        assert tuple(found[name])[1:] == (0, 0.0, True)
    assert tuple(found["v"])[1:] == (None, None, None)


def test_dispatch_covers_every_type(spark, rows):
    df = spark.sql("select double(id) num, if(id < 2, 'a', 'b') cat, id = 1 flag, timestamp_seconds(id) dt from range(3)")
    found = rows(tg.data_quality(df))
    assert set(found) == {"num", "cat", "flag", "dt"}
    assert found == rows(tg.profile_table(df).columns.select("column", "outlier_count", "outlier_rate", "has_low_variation"))
