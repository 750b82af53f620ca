from __future__ import annotations

import re

import pytest

import tabgauge as tg
from tabgauge.functions.frames import Cell, one_row_per_column
from tabgauge.plans.facts import Facts
from tabgauge.plans.profile import _summarised


@pytest.fixture(scope="module")
def people(spark):
    return spark.sql(
        """
        select id as numeric, double(id) / 7 as ratio, if(id % 2 = 0, 'a', 'b') as categorical,
          concat('name', id) as name, id > 10 as flag,
          cast('2024-01-01' as timestamp_ntz) + make_interval(0, 0, 0, int(id)) as temporal,
          date('2024-01-01') + int(id) as day, if(id % 4 = 0, null, id) as gap
        from range(40)
        """
    )


def test_profile_agrees_with_the_single_operators(people, rows):
    profile = rows(tg.profile_table(people).columns)
    for operator in (
        tg.missing_counts,
        tg.numeric_stats,
        tg.numeric_moments,
        tg.numeric_quantiles,
        tg.string_length_stats,
        tg.temporal_stats,
        tg.column_types,
        tg.data_quality,
    ):
        for name, row in rows(operator(people)).items():
            for field, value in row.asDict().items():
                expected = pytest.approx(value) if isinstance(value, float) else value
                assert profile[name][field] == expected, (operator.__name__, name, field)


def test_target_and_features(people):
    found = tg.profile_table(people, "ratio", ["flag", "numeric"]).columns.orderBy("position")
    assert [(r["column"], r["is_target"], r["is_feature"]) for r in found.collect()] == [
        ("ratio", True, False),
        ("flag", False, True),
        ("numeric", False, True),
    ]


def test_table_row(people):
    row = tg.profile_table(people, "flag").table.first()
    assert (row["num_rows"], row["num_cols"], row["target"]) == (40, 8, "flag")
    assert row["int_cols"] == ["numeric", "gap"]
    assert row["float_cols"] == ["ratio"]
    assert row["datetime_cols"] == ["temporal"] and row["date_cols"] == ["day"]
    assert row["missing_cols"] == ["gap"] and row["constant_cols"] == []
    assert row["cardinality"]["categorical"] == 2 and row["cardinality"]["name"] == 40
    assert row["features"][0] == "numeric" and "flag" not in row["features"]


def test_column_profile(people, rows):
    whole = rows(tg.profile_table(people).columns)
    for name in ("ratio", "categorical", "temporal", "gap"):
        one = tg.profile_column(people, name).first()
        assert one["info"] == whole[name]["info"]
        assert one["outlier_count"] == whole[name]["outlier_count"]
    assert tg.profile_column(people, "ratio", is_target=True).first()["is_target"]
    with pytest.raises(ValueError, match="Column 'nope' not found"):
        tg.profile_column(people, "nope")


def test_sections_leave_out_passes(people, rows, spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, **settings):
        spark.sparkContext.setJobGroup(group, group)
        profile = tg.profile_table(people, **settings)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group)), profile

    few, profile = jobs("few", sections={"missing"})
    many, _ = jobs("many")
    assert few < many
    found = rows(profile.columns)["gap"]
    assert (found["missing_count"], found["cardinality"], found["median"]) == (10, None, None)
    with pytest.raises(ValueError, match="Unknown sections: colour"):
        tg.profile_table(people, sections={"colour"})


def test_empty_table(people, rows):
    profile = tg.profile_table(people.limit(0))
    found = rows(profile.columns)
    assert all((r["row_count"], r["cardinality"], r["missing_rate"]) == (0, 0, None) for r in found.values())
    assert "Rows: 0, Columns: 8" in profile.table.first()["info"]
    assert profile.histogram.count() == 0


def test_declared_category(people, rows):
    profile = tg.profile_table(people, declared={"name": "categorical"})
    info = rows(profile.columns)["name"]["info"]
    assert "**Type**: categorical" in info and "and 20 more categories" in info
    assert profile.table.first()["categorical_cols"] == ["name"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_their_columns(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "people"))
    df = tg.read_parquet(spark, str(tmp_path / "people"))
    schemas = re.findall(r"ReadSchema: (\S+)", plan(tg.numeric_stats(df)))
    assert schemas == ["struct<numeric:bigint,ratio:double,gap:bigint>"]
    pushed = plan(tg.drop_missing(df, "gap"))
    assert "IsNotNull(gap)" in pushed


def test_plans_stay_in_the_jvm_without_expand_or_cross_join(people):
    for operator in (
        tg.missing_counts,
        tg.numeric_stats,
        tg.numeric_moments,
        tg.cardinality,
        tg.value_counts,
        tg.pearson_long,
        tg.outliers_zscore,
        tg.data_quality,
        tg.histogram_numeric,
    ):
        text = plan(operator(people))
        for node in ("Expand", "CartesianProduct", "NestedLoop", "EvalPython", "InPandas"):
            assert node not in text, (operator.__name__, node)


def test_wide_tables_take_several_aggregates(spark, rows):
    df = spark.range(20).selectExpr(*(f"id * {i} as c{i}" for i in range(90)))
    cells = {c: Cell({"v": c}, {"s": "sum({v})", "m": "max({v})"}) for c in df.columns}
    found = rows(one_row_per_column(df, cells, {"s": "bigint", "m": "bigint"}, 2))
    assert len(found) == 90
    assert (found["c89"]["s"], found["c89"]["m"]) == (190 * 89, 19 * 89)


def test_declared_types_must_fit(spark):
    df = spark.createDataFrame([("x",)], "s string")
    for kind in ("integer", "datetime"):
        with pytest.raises(ValueError, match="'s'"):
            tg.profile_table(df, declared={"s": kind})
    with pytest.raises(ValueError, match="'nope'"):
        tg.profile_table(df, declared={"nope": "categorical"})
    with pytest.raises(ValueError, match="'s'"):
        tg.outliers_iqr_temporal(df, ["s"])


@pytest.mark.parametrize("section", ["types", "numeric", "correlation", "temporal", "text", "quality", "histogram", "missing"])
def test_sections_say_nothing_about_other_parts(spark, section):
    df = spark.range(20).selectExpr("if(id < 15, null, double(id)) as x", "double(id % 7) as y", "concat('c', id % 6) as s")
    profile = tg.profile_table(df, sections={section})
    columns = {r["column"]: r for r in profile.columns.collect()}
    table = profile.table.first()["info"]
    assert columns["x"]["type"] == "float" and columns["x"]["is_numeric"] and "**Type**: float" in columns["x"]["info"]
    assert ("issing values" in columns["x"]["info"]) == (section == "missing")
    assert ("Mean:" in columns["y"]["info"]) == (section == "numeric")
    assert ("Category distribution" in columns["s"]["info"]) == (section == "histogram")
    assert ("correlat" in table) == (section == "correlation")
    assert "3 ()" not in table and "No missing values detected" not in table


@pytest.mark.parametrize("section", ["numeric", "correlation"])
def test_sections_read_no_text(spark, section, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id as a", "double(id % 7) as b", "concat('t', id) as text").write.parquet(path)
    df = spark.read.parquet(path)
    facts = Facts(df, df.columns)
    assert _summarised(facts, {section}) == ["a", "b"]
    assert tg.profile_table(df, sections={section}).columns.count() == 3


def test_a_finished_profile_reads_nothing(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "t"))
    profile = tg.profile_table(spark.read.parquet(str(tmp_path / "t")), target=people.columns[0])
    for frame in (profile.columns, profile.table, profile.categories, profile.histogram, profile.correlation):
        shown = plan(frame)
        assert "FileScan" not in shown and "parquet" not in shown.lower()
        assert frame.count() == frame.count() > 0


def test_large_numbers_keep_their_digits(spark, rows):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740995,), (1 << 62,)], "n bigint").selectExpr("n", "cast(n as decimal(38, 3)) / 1000 as d")
    for found in (rows(tg.numeric_stats(df))["n"], rows(tg.profile_table(df).columns)["n"], rows(tg.profile_table(df, approx=True).columns)["n"]):
        assert (found["min_exact"], found["max_exact"]) == ("9007199254740993", "4611686018427387904")
    assert "Range: 9007199254740993 to 4611686018427387904" in rows(tg.profile_table(df).columns)["n"]["info"]
    assert rows(tg.numeric_stats(df))["d"]["min_exact"].startswith("9007199254740.993")


def test_given_statistics(spark, rows):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "a double, b double")
    given = spark.createDataFrame([("a", 0.0, 1.0), ("b", None, 100.0)], "column string, mean double, std double")
    for approx in (False, True):
        found = rows(tg.profile_table(df, stats=given, approx=approx).columns)
        assert (found["a"]["outlier_count"], found["b"]["outlier_count"]) == (6, 0)
    checked = rows(tg.data_quality(df, stats=given))
    assert (checked["a"]["outlier_count"], checked["b"]["outlier_count"]) == (6, 0)


def test_many_bins_are_shown_as_few(spark, rows):
    df = spark.range(5000).selectExpr("double(id) as x")
    text = rows(tg.profile_table(df, bins=1000).columns)["x"]["info"]
    table = text[text.index("| Bin Range") :].strip().split("\n")[2:]
    assert len(table) == 202 and sum(int(line.split("|")[2]) for line in table) == 5000
