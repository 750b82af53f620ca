from __future__ import annotations

from datetime import date, datetime

import pytest

import tabgauge as tg
from tabgauge.functions import dtypes


@pytest.fixture
def all_types(spark):
    stamp = datetime(2023, 1, 1, 12)
    return spark.createDataFrame(
        [
            (i % 2 == 0, i, i / 2, "abcd"[i], date(2023, 1, 1 + i), stamp, stamp)
            for i in range(4)
        ],
        "bool_col boolean, int_col bigint, float_col double, str_col string, "
        "date_col date, datetime_col timestamp_ntz, zoned_col timestamp",
    )


def test_types_follow_the_schema(all_types, rows):
    found = rows(tg.column_types(all_types))
    assert {name: row["type"] for name, row in found.items()} == {
        "bool_col": "boolean",
        "int_col": "integer",
        "float_col": "float",
        "str_col": "text",
        "date_col": "date",
        "datetime_col": "datetime",
        "zoned_col": "datetime",
    }
    assert found["bool_col"]["is_categorical"]
    assert found["int_col"]["is_numeric"] and found["int_col"]["is_categorical"]
    assert found["date_col"]["is_temporal"] and not found["date_col"]["is_categorical"]


def test_time_zone_of_instants_only(all_types, rows, spark):
    zone = "spark.sql.session.timeZone"
    spark.conf.set(zone, "Antarctica/Troll")
    try:
        found = rows(tg.column_types(all_types))
        assert found["zoned_col"]["timezone"] == "Antarctica/Troll"
        assert found["datetime_col"]["timezone"] is None
    finally:
        spark.conf.set(zone, "UTC")


def test_time_type(spark, rows):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.sql(
        "select cast(t as time) as t from values ('08:00:00'), ('09:30:00'), ('08:15:00') as v(t)"
    )
    found = rows(tg.column_types(df))["t"]
    assert (found["type"], found["is_temporal"], found["cardinality"]) == ("time", True, 3)
    span = rows(tg.temporal_stats(df))["t"]
    assert span["temporal_diff_seconds"] == 5400
    quality = rows(tg.outliers_iqr_temporal(df))["t"]
    assert (quality["outlier_count"], quality["has_low_variation"]) == (0, False)


def test_all_null_and_empty(spark, rows):
    df = spark.createDataFrame([(None,)] * 3, "col void")
    found = rows(tg.column_types(df))["col"]
    assert found["type"] == "unknown"
    assert found["cardinality"] == 1
    assert found["unique_rate"] == pytest.approx(1 / 3)
    empty = rows(tg.column_types(df.limit(0)))["col"]
    assert (empty["cardinality"], empty["unique_rate"]) == (0, 0.0)


def test_categorical_threshold(spark, rows):
    df = spark.range(1000).selectExpr("id as many", "id % 10 as ten", "id % 11 as eleven")
    found = rows(tg.column_types(df))
    assert [found[n]["is_categorical"] for n in ("many", "ten", "eleven")] == [
        False,
        True,
        False,
    ]


def test_unknown_types(spark, rows):
    df = spark.sql("select array(1, 2) as a, struct(1 as x) as s, x'0102' as b, map('k', 1) as m")
    found = rows(tg.column_types(df))
    assert {row["type"] for row in found.values()} == {"unknown"}
    assert {row["cardinality"] for row in found.values()} == {1}


def test_declared_type(spark, rows):
    df = spark.range(30).selectExpr("concat('c', id) as name")
    found = rows(tg.column_types(df, declared={"name": "categorical"}))["name"]
    assert (found["type"], found["is_categorical"]) == ("categorical", True)
    with pytest.raises(ValueError, match="Unknown semantic type"):
        tg.column_types(df, declared={"name": "colour"})


def test_roles(all_types):
    roles = tg.column_roles(all_types, "float_col", ["int_col", "str_col"]).collect()
    assert [tuple(r) for r in roles] == [
        ("float_col", 0, True, False),
        ("int_col", 1, False, True),
        ("str_col", 2, False, True),
    ]
    assert tg.column_roles(all_types, "int_col").count() == len(all_types.columns)
    with pytest.raises(ValueError, match="'nope'"):
        tg.column_roles(all_types, "nope")


def test_selection_by_type(all_types):
    assert dtypes.select_by_type(all_types, *dtypes.NUMERIC) == ["int_col", "float_col"]
    assert dtypes.numeric_columns(all_types, ["float_col", "str_col", "int_col"]) == [
        "float_col",
        "int_col",
    ]


def test_groups_of_types(all_types):
    types = tg.column_types(all_types)
    groups = {r["type"]: r["columns"] for r in tg.columns_by_type(types).collect()}
    assert groups["datetime"] == ["datetime_col", "zoned_col"]
    assert {r["type"]: r["n"] for r in tg.type_counts(types).collect()}["datetime"] == 2


def test_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("name,age,score,born\nAda,36,1.5,1815-12-10\nBob,,2.5,1990-01-01\n")
    df = tg.read_csv(spark, str(path))
    assert [kind for _, kind in df.dtypes] == ["string", "int", "double", "date"]
    assert tuple(tg.table_shape(df).first()) == (2, 4)
    typed = tg.read_csv(spark, str(path), "name string, age double, score double, born string")
    assert dict(typed.dtypes)["age"] == "double"


def test_odd_column_names(spark, rows):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], ["a.b `c`", "it's {odd}"])
    profile = tg.profile_table(df)
    found = rows(profile.columns)
    assert found["a.b `c`"]["mean"] == 1.5
    assert found["it's {odd}"]["cardinality"] == 2
