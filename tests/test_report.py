from __future__ import annotations

import pytest

import tabgauge as tg
from tabgauge.functions.text import bin_key, fixed, float_text, quoted, span_text
from tabgauge.operators.histogram import HISTOGRAM_SCHEMA
from tabgauge.plans.profile import CATEGORY_SCHEMA, COLUMN_FIELDS

NUMBERS = [0.0, -0.0, 1.0, 0.1, 123456.789, 1e7, 12345678.5, 1.5e15, 1e16, 1e22, 0.001, 0.0001234, 0.00001, 1e-07, 5e-324, -2.5e-05, 1e100, float("inf"), float("-inf"), float("nan")]


def test_float_text_is_python_repr(spark):
    df = spark.createDataFrame([(v,) for v in NUMBERS if v != 5e-324], "x double")
    for row in df.selectExpr("x", f"{float_text('x')} as t").collect():
        assert row["t"] == repr(row["x"])


def test_fixed_rounds_the_binary_value(spark):
    values = [0.125, 2.5, 2.675, 1.00005, 1234567.891, -0.5, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4):
        for row in df.selectExpr("x", f"{fixed('x', digits)} as t").collect():
            assert row["t"] == f"{row['x']:.{digits}f}"


def test_fixed_shows_the_digits_of_large_values(spark):
    values = [8099999.100000001, 2699999.7, 611999.32, 450359.9, 524288.5 + 2**-11, 524288.5 + 3 * 2**-11, 1048575.99999999994]
    values += [9007199254740993.0, 4503599627370496.5, 2.0**62, 2.0**63, 1e19, 1e25, 1.2345678901234567e36, 99999999999.99999]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4, 10):
        for row in df.selectExpr("x", f"{fixed('x', digits)} as t").collect():
            assert row["t"] == f"{row['x']:.{digits}f}"


def test_quoted_is_python_repr(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "two\nlines", "tab\t"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for row in df.selectExpr("s", f"{quoted('s')} as t").collect():
        assert row["t"] == repr(row["s"])


def test_bin_key(spark):
    df = spark.sql("select double(1) a, double(2) b, double('-inf') c, double('inf') d")
    row = df.selectExpr(bin_key("a", "b"), bin_key("c", "d")).first()
    assert tuple(row) == ("[1.0000000000,2.0000000000]", "[-inf,inf]")


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (3661, "1 hours, 1 minutes, 1 seconds"),
        (2 * 86400 + 3600, "2 days, 1 hours"),
        (0, "0 hours, 0 minutes, 0 seconds"),
        (365 * 86400, "365 days, 0 hours"),
        (800 * 86400, f"{800 / 365.2425} years, {800 % 365.2425} days"),
    ],
)
def test_span_text(spark, seconds, text):
    df = spark.sql(f"select bigint({seconds}) as s")
    assert df.selectExpr(span_text("s")).first()[0] == text


def report(spark, categories=(), bins=(), **fields):
    record = {"column": "col", "position": 0, "is_target": False, "is_feature": True, "type": "unknown", "is_categorical": False, "is_numeric": False, "is_temporal": False} | fields
    columns = spark.createDataFrame(
        [tuple(record.get(f) for f in COLUMN_FIELDS)],
        ", ".join(f"{f} {k}" for f, k in COLUMN_FIELDS.items()),
    )
    listed = spark.createDataFrame(list(categories), CATEGORY_SCHEMA)
    binned = spark.createDataFrame(list(bins), HISTOGRAM_SCHEMA)
    return tg.column_report(columns, listed, binned).first()["info"]


def test_plain_report(spark):
    assert report(spark) == "## Analysis of column: col  \n**Type**: unknown (Feature)  \nNo missing values"
    assert "**Type**: integer (Target Variable)" in report(spark, type="integer", is_target=True, is_feature=False)
    assert "Missing values: 3 (25.00%)" in report(spark, missing_count=3, missing_rate=0.25)


def test_category_sections(spark):
    few = report(spark, [("col", "a", 2, 1, 2, None), ("col", "b", 1, 2, 2, None)], is_categorical=True)
    assert few.endswith("Unique categories #: 2\nCategory distribution: {'a': 2, 'b': 1}")
    listed = [("col", f"cat{i}", 40 - i, i + 1, 21, 1) for i in range(20)]
    many = report(spark, listed, [("col", 1, 0.0, 1.0, "", 5)], is_categorical=True, is_numeric=True, min=0.0, max=1.0)
    assert "Unique categories #: 21\nTop categories: {'cat0': 40, " in many
    assert "...\nand 1 more categories" in many
    assert "Histogram" not in many
    assert report(spark, is_categorical=True).endswith("No missing values  \n")


def test_numeric_sections(spark):
    full = {"min": 1.0, "max": 5.0, "mean": 3.0, "median": 3.0, "std": 1.0, "q1": 2.0, "q3": 4.0, "skewness": 0.0, "kurtosis": 0.01}
    bins = [("col", 2, 2.0, 3.0, "", 10), ("col", 1, 1.0, 2.0, "", 5)]
    text = report(spark, (), bins, is_numeric=True, type="float", **full)
    assert text.split("  \n")[3] == (
        "Range: 1.0 to 5.0\nMean: 3.0000, Median: 3.0000\nStd Dev: 1.0000\n"
        "Q1: 2.0000, Q3: 4.0000\nSkewness: 0.0000, Kurtosis: 0.0100"
    )
    assert text.split("  \n")[4] == (
        "\n**Distribution (Histogram):**\n\n| Bin Range | Count |\n|-----------|-------|\n"
        "| 1.0000000000 to 2.0000000000 | 5 |\n| 2.0000000000 to 3.0000000000 | 10 |"
    )
    part = report(spark, is_numeric=True, type="integer", min=0.0, max=10.0)
    assert part.endswith("  \nRange: 0 to 10")


def test_temporal_section(spark):
    dates = {"is_temporal": True, "temporal_min": "2020-01-01", "temporal_max": "2020-01-03"}
    assert report(spark, **dates).endswith("  \nRange: 2020-01-01 to 2020-01-03")
    spanned = report(spark, temporal_diff_seconds=2 * 86400 + 3600, **dates)
    assert spanned.endswith("Range: 2020-01-01 to 2020-01-03\nTime span: 2 days, 1 hours")


@pytest.fixture(scope="module")
def example(spark):
    rows = [
        (i, (i * 7 % 10) / 3, i % 3 == 0, ["foo", "bar", "baz"][i % 3], f"2020-01-{i + 1:02d}", None if i in (0, 2, 5, 7) else i + 1, 1)
        for i in range(10)
    ]
    df = spark.createDataFrame(rows, "int_col bigint, float_col double, bool_col boolean, str_col string, day string, missing_col bigint, uniform_val_col bigint")
    return df.selectExpr("int_col", "float_col", "bool_col", "str_col", "timestamp(day) as datetime_col", "missing_col", "uniform_val_col", "int_col * 2 as int_col2")


def test_table_report(example):
    info = tg.profile_table(example).table.first()["info"]
    shape, missing, pairs, cardinality = info.split("\n\n")
    assert [shape, missing, cardinality] == [
        "## DataFrame Shape\nRows: 10, Columns: 8 (4 int, 1 float, 1 bool, 1 datetime, 1 text)",
        "1 columns have missing values: missing_col.\nColumns with >30.0% missing:missing_col.",
        "Constant columns (single unique value): uniform_val_col.",
    ]
    head, *listed = pairs.split("\n")
    assert head == "Strongly correlated feature pairs (|r| >= 0.8):"
    assert sorted(listed) == [
        "- int_col & int_col2: r = 1.00",
        "- int_col & missing_col: r = 1.00",
        "- missing_col & int_col2: r = 1.00",
    ]


def test_table_report_with_missing_values_propagated(example):
    info = tg.profile_table(example, missing="propagate").table.first()["info"]
    assert "(|r| >= 0.8):\n- int_col & int_col2: r = 1.00\n\n" in info


def test_target_lines(example):
    def line(name):
        profile = tg.profile_table(example, target=name, sections={"types", "numeric"})
        return tg.target_summary(profile.columns).first()["summary"]

    assert line("str_col") == "Target 'str_col' is categorical with 3 classes."
    assert line("datetime_col") == "Target 'datetime_col' type: datetime."
    wide = example.selectExpr("explode(sequence(int_col, int_col + 5)) as n")
    profile = tg.profile_table(wide, target="n", sections={"types", "numeric"})
    text = tg.target_summary(profile.columns).first()["summary"]
    assert text.startswith("Target 'n' is numeric. Mean: 7.0, Std: ") and text.endswith(", Min: 0, Max: 14.")


def test_no_gaps_no_strong_pairs(spark):
    df = spark.range(60).selectExpr("id", "id * 37 % 59 as other")
    info = tg.profile_table(df).table.first()["info"]
    assert "No missing values detected." in info
    assert "No strongly correlated feature pairs (|r| >= 0.8)." in info
    assert "Columns with high cardinality (>50): id, other." in info
