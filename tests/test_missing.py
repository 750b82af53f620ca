from __future__ import annotations

import pytest

import tabgauge as tg

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("values", "kind", "left"),
    [
        ([None, None], "bigint", 0),
        ([1, 2, 3], "bigint", 3),
        ([1.0, None, 3.0, NAN], "double", 2),
        (["a", None, "b"], "string", 2),
        ([NAN, NAN], "double", 0),
    ],
)
def test_drop_missing(spark, values, kind, left):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"x {kind}, row int")
    kept = tg.drop_missing(df, "x")
    assert kept.count() == left
    assert kept.columns == ["x", "row"]


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="Column 'y' not found"):
        tg.drop_missing(spark.range(1), "y")


def test_missing_and_infinite(spark, rows):
    values = [None, None, None, 3.1415926, 2.7182818, INF]
    df = spark.createDataFrame([(v,) for v in values], "col double")
    found = rows(tg.missing_counts(df))["col"]
    assert (found["missing_count"], found["missing_rate"], found["inf_count"]) == (3, 0.5, 1)
    assert tg.keep_infinite(df, "col").count() == 1


def test_empty_table_has_no_rate(spark, rows):
    df = spark.createDataFrame([], "col double")
    assert rows(tg.missing_counts(df))["col"]["missing_rate"] is None


def test_lists_of_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1, "b")], "a int, b int, c string")
    counts = tg.missing_counts(df)
    assert {r["column"] for r in tg.missing_columns(counts).collect()} == {"b", "c"}
    assert {r["column"] for r in tg.high_missing_columns(counts).collect()} == {"b", "c"}
    assert {r["column"] for r in tg.high_missing_columns(counts, 0.5).collect()} == {"b"}
    percents = {r["column"]: r["missing_percent"] for r in tg.missing_rate_table(counts).collect()}
    assert percents == {"b": "66.6667%", "c": "33.3333%"}


def test_markdown(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    columns = tg.profile_table(df, sections={"missing"}).columns
    assert tg.missing_rate_markdown(columns).first()[0] == (
        "| Column | Missing Rate |\n| ------ | ----------- |\n| b | 50.0000% |"
    )
    none = tg.profile_table(df.select("a"), sections={"missing"}).columns
    assert tg.missing_rate_markdown(none).first()[0].endswith("| No missing values found | 0% |")
