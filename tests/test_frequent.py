"""Frequent values against a full count, on skewed, uniform and odd columns."""

from __future__ import annotations

import pytest

import tabgauge as tg
from tabgauge.operators import frequent


def full(df, columns, limit):
    counts = [(r["column"], -r["n"], r["value"].encode(), r["value"]) for r in tg.value_counts(df, columns).collect()]
    out = []
    for name in columns:
        own = sorted(c for c in counts if c[0] == name)[:limit]
        out += [(name, value, -n, i + 1) for i, (_, n, _, value) in enumerate(own)]
    return sorted(out)


def found(df, columns=None, limit=20):
    return sorted(tuple(r) for r in tg.frequent_values(df, columns, limit).collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 40_000, 1, 6).selectExpr(
        "int(pow(10000, rand(1))) as skewed",
        "int(rand(2) * 30000) as uniform",
        "id % 3 = 0 as flag",
        "if(id % 4 = 0, null, concat(repeat('long ', 30), int(pow(500, rand(3))))) as text",
        "case when id % 5 = 0 then double('nan') when id % 7 = 0 then -0.0 when id % 11 = 0 then 0.0 when id % 13 = 0 then double('inf') else round(pow(50, rand(4)), 1) end as number",
        "date_add(date'2020-01-01', int(pow(300, rand(5)))) as day",
        "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, int(pow(300, rand(6))) / 4) as stamp",
        "cast(round(pow(100, rand(7)), 1) as decimal(10, 2)) as price",
        "string(null) as nothing",
    )


@pytest.mark.parametrize("limit", [1, 20])
def test_equals_the_full_count(table, limit):
    assert found(table, limit=limit) == full(table, table.columns, limit)


def test_only_rare_values_are_counted_in_full(table, monkeypatch):
    asked = []
    monkeypatch.setattr(frequent, "value_counts", lambda df, names: asked.append(names) or tg.value_counts(df, names))
    found(table)
    assert asked == [["uniform"]]


def test_limits_and_empty_tables(spark, table):
    few = table.limit(500)
    few = spark.createDataFrame(few.toArrow())
    assert found(few, ["skewed", "uniform", "text"], 2000) == full(few, ["skewed", "uniform", "text"], 2000)
    assert found(table.limit(0)) == []
    with pytest.raises(ValueError):
        tg.frequent_values(table, limit=0)


def test_candidates_alone_are_shuffled(table):
    counted = frequent._counted(table, ["skewed"], {0: ["1", "2", None]})
    assert {r["value"] for r in counted.collect()} == {"1", "2"}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")


def test_counts_are_hashed_and_rare_columns_are_not_counted_twice(table, monkeypatch):
    plan = frequent._counted(table, ["text", "skewed"], {0: ["a", None], 1: ["1"]})._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    asked, right = [], frequent._counted
    monkeypatch.setattr(frequent, "_counted", lambda df, names, items: asked.append(sorted(items)) or right(df, names, items))
    assert found(table, ["uniform", "flag"]) == full(table, ["uniform", "flag"], 20)
    assert asked == [[1]]


def test_numbers_at_the_edges_of_their_types(spark):
    rows = [(2**63 - 1, 5e-324, True), (-(2**63), float("nan"), None), (2**63 - 1, -0.0, True), (2**63 - 2, 0.0, False), (None, 0.1 + 0.2, None)]
    df = spark.createDataFrame(rows * 3, "a long, b double, c boolean").selectExpr("*", "float(b) as f", "cast(b as decimal(20, 3)) as d")
    assert found(df) == full(df, df.columns, 20)
    df = df.selectExpr("*", "try_divide(b, 0) as g")
    assert found(df, ["g", "a"], 2) == full(df, ["g", "a"], 2)
