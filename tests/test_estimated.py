"""Mergeable states: estimates within their bounds, one scan, levels, and profiles of growing folders."""

from __future__ import annotations

import math
import re
import shutil

import pytest

import tabgauge as tg
from tabgauge.functions import tasks
from tabgauge.operators import states
from tabgauge.plans.profile import SECTIONS
from tabgauge.plans import store as stores

EXACT = (
    "type row_count missing_count missing_rate inf_count min max mean std skewness kurtosis timezone is_numeric is_temporal "
    "char_length_min char_length_max char_length_mean char_length_std temporal_min temporal_max temporal_diff_seconds "
    "has_low_variation is_categorical position"
).split()
ALL_BUT_PAIRS = [s for s in SECTIONS if s != "correlation"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 60_000, 1, 5).selectExpr(
        "id",
        "1e9 + randn(1) as far",
        "if(id % 7 = 0, null, if(id % 11 = 0, double('nan'), exp(2 * randn(2)))) as gaps",
        "if(id % 1000 = 3, double('inf'), if(id % 1000 = 7, double('-inf'), rand(3))) as odd",
        "float(id % 5) as few",
        "concat('w', int(pow(2, 14 * rand(4)))) as word",
        "if(id % 3 = 0, null, repeat('é', int(id % 90))) as text",
        "id % 10 < 9 as flag",
        "cast(null as double) as nothing",
        "1.5 as same",
        "date_add(date'2020-01-01', if(id % 500 = 0, 9000, int(id % 60))) as day",
        "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id + 0.25) as stamp",
        "array(id) as list",
    )


def by_column(profile):
    return {r["column"]: r for r in profile.columns.collect()}


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def test_estimates_against_the_exact_profile(table):
    near, exact = (by_column(tg.profile_table(table, approx=a, sections=ALL_BUT_PAIRS)) for a in (True, False))
    n, data = 60_000, table.drop("list", "stamp", "day").toPandas()
    for name, row in exact.items():
        found = near[name]
        assert [f for f in EXACT if not close(row[f], found[f])] == []
        assert abs(found["cardinality"] - row["cardinality"]) <= 5 * states.DISTINCT_ERROR * row["cardinality"]
        assert abs(found["outlier_count"] - row["outlier_count"] if row["outlier_count"] is not None else 0) <= 3 * states.RANK_ERROR * n
        for field, share in (("p5", 0.05), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p95", 0.95)):
            if row[field] is None:
                assert found[field] is None
                continue
            values = data[name].dropna()
            below, upto = (values < found[field]).mean(), (values <= found[field]).mean()
            assert below - 3 * states.RANK_ERROR <= share <= upto + 3 * states.RANK_ERROR


def test_categories_and_bins(table):
    near, exact = (tg.profile_table(table, approx=a, sections=["histogram"], declared={"word": "categorical"}) for a in (True, False))
    found, right = ({(r["column"], r["rank"]): r for r in p.categories.collect()} for p in (near, exact))
    assert set(found) == set(right)
    for key, r in right.items():
        if r["column"] != "word":
            assert found[key] == r
        else:
            assert abs(found[key]["n"] - r["n"]) <= states.COUNT_ERROR * 60_000
    bins, rows = ({(r["column"], r["bin_idx"]): r for r in p.histogram.collect()} for p in (near, exact))
    assert set(bins) == set(rows)
    for key, r in rows.items():
        assert close(bins[key]["lower"], r["lower"]) and bins[key]["bin_key"] == r["bin_key"]
        assert abs(bins[key]["n"] - r["n"]) <= 6 * states.RANK_ERROR * 60_000
    totals = {c: sum(r["n"] for (k, _), r in bins.items() if k == c) for c, _ in bins}
    assert totals == {c: sum(r["n"] for (k, _), r in rows.items() if k == c) for c, _ in rows}


@pytest.mark.parametrize("rule", ["sturges", "freedman_diaconis", 7])
def test_bin_rules(table, rule):
    near = tg.profile_table(table, approx=True, sections=["histogram"], bins=rule).histogram.collect()
    assert {r["column"] for r in near} == {"id", "far", "gaps", "odd"}
    with pytest.raises(ValueError, match="exact"):
        tg.profile_table(table, approx=True, sections=["histogram"], bins=lambda c: c)


def test_small_and_empty_tables(spark):
    rows = [(1.0, "a", True), (2.0, None, False), (None, "b", None)]
    df = spark.createDataFrame(rows, "x double, y string, z boolean")
    for frame in (df, df.limit(1), df.limit(0)):
        near, exact = (by_column(tg.profile_table(frame, approx=a, sections=ALL_BUT_PAIRS)) for a in (True, False))
        for name, row in exact.items():
            assert [f for f in (*EXACT, "cardinality", "outlier_count") if not close(row[f], near[name][f])] == []
    assert tg.profile_table(df, approx=True).table.first()["num_rows"] == 3
    assert tg.profile_table(df, approx=True, sections=["correlation"]).correlation.count() == 1


def test_one_scan_and_one_small_shuffle(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    (whole,) = states.table_states(spark.read.parquet(str(tmp_path / "t")), table.columns)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("kind", ["double", "float", "string", "bigint", "decimal(14, 2)", "boolean", "date", "timestamp_ntz", "timestamp"])
def test_rows_pass_the_aggregate_whole_and_compiled(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    spark.range(0, 4, 1, 1).selectExpr(*(f"cast(null as {kind}) as c{i}" for i in range(45))).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.read.parquet(path)
        made = states.table_states(df, df.columns)
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        for frame in made:
            plan = frame._jdf.queryExecution().executedPlan()
            above, below = plan.toString().split("Exchange")
            assert "Generate" in above and "Generate" not in below
            # Longer methods the JVM leaves to its interpreter.
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))
            assert sizes and all(int(size) <= 8000 for size in sizes)
        assert sum(frame.count() for frame in made) == 45
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_levels_give_the_same_states(table, monkeypatch):
    one = states.estimates(states.table_states(table, table.columns), table.columns)
    monkeypatch.setattr(tasks, "FAN", 2)
    several = states.table_states(table, table.columns)
    assert several[0]._jdf.queryExecution().executedPlan().toString().count("partial_hll_union_agg") == 2
    found = states.estimates(several, table.columns)
    for name, e in one.items():
        assert all(close(e.state[f], found[name].state[f]) for f in e.state if f not in ("m3", "m4"))
        assert e.distinct == found[name].distinct


def test_a_growing_folder_is_read_once(spark, table, tmp_path, monkeypatch):
    folder, kept = tmp_path / "a b+c%", str(tmp_path / "store")
    table = table.drop("nothing")
    table.filter("id < 50000").repartition(4).write.parquet(str(folder / "one"))
    asked = []

    def read(files):
        asked.append(files)
        return spark.read.parquet(*files)

    first = tg.profile_files(spark, [str(folder)], kept, read)
    assert (first.files, first.read, len(asked.pop())) == (4, 4, 4)
    table.filter("id >= 50000").coalesce(1).write.parquet(str(folder / "two"))
    second = tg.profile_files(spark, [str(folder)], kept, read)
    assert (second.files, second.read, len(asked.pop())) == (5, 1, 1)
    third = tg.profile_files(spark, [str(folder)], kept, read)
    assert (third.files, third.read) == (5, 0)
    exact = by_column(tg.profile_table(table, sections=ALL_BUT_PAIRS))
    for made in (second, third):
        near = by_column(made.profile)
        for name, row in exact.items():
            assert [f for f in EXACT if not close(row[f], near[name][f])] == []
            assert abs(near[name]["cardinality"] - row["cardinality"]) <= 5 * states.DISTINCT_ERROR * row["cardinality"]
    monkeypatch.setattr(tasks, "FAN", 2)
    monkeypatch.setattr(stores, "FAN", 2)
    assert close(by_column(tg.profile_files(spark, [str(folder)], kept, read).profile)["far"]["std"], exact["far"]["std"])
    shutil.rmtree(folder / "one")
    assert by_column(tg.profile_files(spark, [str(folder)], kept, read).profile)["id"]["row_count"] == 10_000
    spark.range(5).write.parquet(str(folder / "three"))
    with pytest.raises(ValueError):
        tg.profile_files(spark, [str(folder / "three")], kept)
