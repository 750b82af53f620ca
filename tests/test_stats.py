from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import numpy as np
import pytest

import tabgauge as tg
from tabgauge.functions import tasks as task_levels
from tabgauge.functions.frames import Cell
from tabgauge.operators import order_stats, sketches
from tabgauge.operators.order_stats import Bracket, order_statistics, whole_column
from tabgauge.operators.quantiles import QUANTILES

NAN, INF = float("nan"), float("inf")


def test_one_to_five(spark, rows):
    df = spark.range(1, 6).withColumnRenamed("id", "num")
    stats = rows(tg.numeric_stats(df))["num"]
    assert (stats["min"], stats["max"], stats["mean"]) == (1.0, 5.0, 3.0)
    assert stats["std"] == pytest.approx(np.std([1, 2, 3, 4, 5], ddof=1))
    found = rows(tg.numeric_quantiles(df))["num"]
    for name, share in (("p5", 5), ("q1", 25), ("median", 50), ("q3", 75), ("p95", 95)):
        assert found[name] == pytest.approx(np.percentile([1, 2, 3, 4, 5], share))
    moments = rows(tg.numeric_moments(df))["num"]
    assert moments["skewness"] == pytest.approx(0.0, abs=1e-12)
    assert moments["kurtosis"] == pytest.approx(-1.3)


def test_moments_match_their_definition(spark, rows):
    values = np.random.default_rng(7).gamma(2.0, 3.0, 500)
    df = spark.createDataFrame([(float(v) + 1e6,) for v in values], "x double")
    found = rows(tg.numeric_moments(df))["x"]
    d = values - values.mean()
    assert found["skewness"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5, rel=1e-6)
    assert found["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3, rel=1e-6)


@pytest.mark.parametrize("size", [1e-200, 1e200])
def test_moments_at_the_ends_of_the_number_line(spark, rows, size):
    values = np.array([1.0, 2.0, 4.0, 8.0])
    df = spark.createDataFrame([(float(v * size),) for v in values], "x double")
    d = values - values.mean()
    found = rows(tg.numeric_moments(df))["x"]
    assert found["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)


def test_constant_single_and_missing(spark, rows):
    df = spark.createDataFrame(
        [(2.0, None, NAN), (2.0, 5.0, None)], "same double, one double, none double"
    )
    columns = rows(tg.profile_table(df).columns)
    assert (columns["same"]["std"], columns["same"]["skewness"]) == (0.0, None)
    assert (columns["one"]["std"], columns["one"]["median"]) == (None, 5.0)
    assert (columns["one"]["outlier_count"], columns["one"]["has_low_variation"]) == (None, None)
    none = columns["none"]
    assert (none["min"], none["median"], none["std"]) == (None, None, None)
    assert (none["outlier_count"], none["outlier_rate"], none["has_low_variation"]) == (0, 0.0, True)


def test_string_lengths_count_characters(spark, rows):
    df = spark.createDataFrame([("a",), ("bé",), ("ccc",), ("dddd",), (None,)], "slen string")
    found = rows(tg.string_length_stats(df))["slen"]
    assert (found["char_length_min"], found["char_length_max"]) == (1, 4)
    assert found["char_length_mean"] == 2.5
    assert found["char_length_std"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


def test_temporal_span(spark, rows):
    days = [(date(2023, 1, d), datetime(2023, 1, d, 0, 0, d, 500000 - d)) for d in range(1, 6)]
    df = spark.createDataFrame(days, "dt date, ts timestamp_ntz")
    found = rows(tg.temporal_stats(df))
    assert (found["dt"]["temporal_min"], found["dt"]["temporal_max"]) == ("2023-01-01", "2023-01-05")
    assert found["dt"]["temporal_diff_seconds"] == 4 * 86400
    assert found["ts"]["temporal_min"] == "2023-01-01 00:00:01.499999"
    assert found["ts"]["temporal_diff_seconds"] == 4 * 86400 + 3


def test_zoneless_times_ignore_the_session_zone(spark, rows):
    # Clocks in this zone skip 02:30 on the first of these days.
    clock = [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 30), datetime(1960, 1, 1, 0, 0, 0, 5)]
    df = spark.createDataFrame([(c,) for c in clock], "ts timestamp_ntz")
    expected = rows(tg.temporal_stats(df))["ts"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = rows(tg.temporal_stats(df))["ts"]
        assert rows(tg.cardinality(df))["ts"]["cardinality"] == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == expected


def values_at(spark, values, ranks):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    present = [v for v in values if v == v]
    bracket = whole_column("x", min(present), max(present), len(present), ranks)
    found = order_statistics(df, [bracket])
    ordered = sorted(present)
    assert found == {("x", k): ordered[k] for k in ranks}


CASES = {
    "even": lambda r: r.random(3000),
    "one value holds a third": lambda r: np.where(r.random(3000) < 0.34, 0.5, r.random(3000)),
    "many magnitudes": lambda r: r.choice([-1, 1], 3000) * 10.0 ** r.uniform(-300, 300, 3000),
    "far ends": lambda r: np.concatenate([r.random(2998), [-1e308, 1e308]]),
    "infinite ends": lambda r: np.concatenate([r.random(2990), [INF] * 5, [-INF] * 5]),
    "few values": lambda r: r.integers(0, 3, 3000).astype(float),
    "with NaN": lambda r: np.concatenate([r.normal(size=2900), [NAN] * 100]),
    "crowded by a far value": lambda r: np.concatenate([r.random(2999) * 1e-12, [1e12]]),
}


@pytest.mark.parametrize("limit", [3, 40])
@pytest.mark.parametrize("name", CASES)
def test_order_statistics_against_a_sort(spark, monkeypatch, name, limit):
    # Small limits send the search through all of its kinds of rounds.
    monkeypatch.setattr(order_stats, "SORT_ROWS", limit)
    values = list(CASES[name](np.random.default_rng(11)))
    n = int(sum(v == v for v in values))
    values_at(spark, values, {0, 1, n // 4, n // 2, n // 2 + 1, 3 * n // 4, n - 2, n - 1})


def test_ranks_that_a_sketch_misjudges_are_found_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "SORT_ROWS", 40)
    right = order_stats.sketched

    def wrong(df, cells):
        return [replace(s, cuts=tuple(c + 0.3 for c in s.cuts)) for s in right(df, cells)]

    calls = []
    monkeypatch.setattr(order_stats, "sketched", lambda df, cells: calls.append(1) or (wrong if len(calls) < 3 else right)(df, cells))
    values_at(spark, list(np.random.default_rng(2).random(2000)), {0, 500, 1000, 1999})
    assert len(calls) >= 3


@pytest.fixture
def scans(monkeypatch):
    """Names of the scans that the search for ranks makes."""
    made = []
    for name in ("_with_cuts", "_narrowed", "_counted", "_selected"):
        monkeypatch.setattr(order_stats, name, lambda *a, f=getattr(order_stats, name), n=name: made.append(n) or f(*a))
    return made


@pytest.mark.parametrize("kind", ["uniform", "log-normal", "forty magnitudes"])
def test_few_scans_whatever_the_distribution(spark, scans, kind):
    value = {"uniform": "rand(3)", "log-normal": "exp(4 * randn(3))", "forty magnitudes": "pow(10, 40 * rand(3) - 20)"}[kind]
    df = spark.range(0, 400_000, 1, 4).selectExpr(f"{value} as x")
    data = np.sort(df.toPandas()["x"].to_numpy())
    n = len(data)
    ranks = {0, n // 20, n // 4, n // 2, 3 * n // 4, n - n // 20, n - 1}
    found = order_statistics(df, [whole_column("x", data[0], data[-1], n, ranks)])
    assert found == {("x", k): data[k] for k in ranks}
    assert scans == ["_with_cuts", "_selected", "_counted"]


@pytest.mark.parametrize("tasks", [1, 3, 70])
def test_sketches_merge_in_levels(spark, monkeypatch, tasks):
    monkeypatch.setattr(task_levels, "FAN", 4)
    df = spark.range(0, 20_000, 1, tasks).selectExpr("double(id * 7919 % 20000) as x", "id % 3 = 0 as y")
    cell = Cell({"v": "x", "f": "y"}, {"value": "{v}", "hit": "count_if({f})"})
    assert task_levels.tasks_of(df) == tasks
    found = sketches.sketched(df, [cell, cell])
    assert [(s.n, s.cuts[0], s.cuts[-1], s.counts) for s in found] == [(20_000, 0.0, 19_999.0, {"hit": 6667})] * 2
    error = sketches.rank_error(sketches.SKETCH_SIZE) * 20_000
    assert all(abs(c - i * 20_000 / sketches.CUTS) <= 3 * error + 1 for s in found for i, c in enumerate(s.cuts))
    (_, whole), = sketches.merged_sketches(df, [cell], 200)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    levels = {1: 1, 3: 1, 70: 4}[tasks]  # of up to 4 rows each
    assert plan.count("partial_kll_merge_agg") == levels - 1 and plan.count("partial_kll_sketch_agg") == 1


def test_more_tasks_than_planned_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(task_levels, "FAN", 2)
    monkeypatch.setattr(task_levels, "tasks_of", lambda df: 3)
    (found,) = sketches.sketched(spark.range(0, 500, 1, 11).selectExpr("double(id) as x"), [Cell({"v": "x"}, {"value": "{v}"})])
    assert (found.n, found.cuts[0], found.cuts[-1]) == (500, 0.0, 499.0)


def test_approximate_quantiles_within_their_bound(spark, rows):
    df = spark.range(0, 300_000, 1, 8).selectExpr("exp(3 * randn(1)) as a", "double(id % 5) as b", "if(id % 2 = 0, null, rand(2)) as c")
    near = rows(tg.numeric_quantiles(df, approx=True))
    data = df.toPandas()
    for name in "abc":
        present = np.sort(data[name].dropna().to_numpy())
        for key, share in QUANTILES.items():
            low, high = np.searchsorted(present, near[name][key], "left"), np.searchsorted(present, near[name][key], "right")
            off = max(low - share * len(present), share * len(present) - high, 0) / len(present)
            assert off <= 3 * sketches.rank_error(sketches.SKETCH_SIZE)
    empty = rows(tg.numeric_quantiles(df.limit(0), approx=True))
    assert empty["a"]["median"] is None and set(empty) == {"a", "b", "c"}


def test_picking_bins_keeps_counts():
    whole = Bracket("x", 0.0, 9.0, 0, 10, (0, 4, 9))
    found = whole_pick = order_stats.pick(whole, [(1, 5, 3.0, 5.0), (0, 3, 0.0, 2.0), (2, 2, 8.0, 9.0)])
    assert [(b.low, b.high, b.below, b.ranks) for b in whole_pick] == [
        (0.0, 2.0, 0, (0,)),
        (3.0, 5.0, 3, (4,)),
        (8.0, 9.0, 8, (9,)),
    ]
    assert sum(b.rows for b in found) == 10


def test_quantiles_of_skewed_columns(spark, rows):
    generator = np.random.default_rng(5)
    data = np.column_stack([np.where(generator.random(20000) < 0.4, 1.0, generator.lognormal(0, 4, 20000)), generator.normal(size=20000)])
    df = spark.createDataFrame(data.tolist(), "a double, b double")
    found = rows(tg.numeric_quantiles(df))
    for i, name in enumerate("ab"):
        expected = np.percentile(data[:, i], [5, 25, 50, 75, 95])
        assert list(found[name][1:]) == pytest.approx(list(expected))
    near = rows(tg.numeric_quantiles(df, approx=True))
    assert near["b"]["median"] == pytest.approx(np.median(data[:, 1]), abs=0.01)


def test_brackets_that_overlap_have_their_own_rows(spark):
    df = spark.range(100).selectExpr("double(id) as x", "double(-id) as y")
    brackets = [Bracket("x", 10, 20, 10, 11, (12,)), Bracket("x", 5, 50, 5, 46, (30,)), Bracket("y", -3, 0, 96, 4, (97,))]
    assert order_statistics(df, brackets) == {("x", 12): 12.0, ("x", 30): 30.0, ("y", 97): -2.0}


def test_only_values_inside_brackets_reach_the_sketches(spark):
    df = spark.range(1000).selectExpr("double(id) as x", "if(id % 3 = 0, null, double(id)) as y")
    brackets = [Bracket("x", 10, 20, 10, 11, (12,)), Bracket("y", 90, 100, None, 7, (70,)), Bracket("x", 15, 16, 15, 2, (15,))]
    inside = sorted(tuple(r) for r in order_stats._inside(df, brackets).collect())
    assert inside == [(0, float(i)) for i in range(10, 21)] + [(1, float(i)) for i in range(90, 101) if i % 3] + [(2, 15.0), (2, 16.0)]
    cut = order_stats._with_cuts(df, brackets)
    assert [(b.rows, b.cuts[0], b.cuts[-1]) for b in cut] == [(11, 10.0, 20.0), (7, 91.0, 100.0), (2, 15.0, 16.0)]
