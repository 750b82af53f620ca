from __future__ import annotations

import tabgauge as tg

NAN = float("nan")


def test_null_and_nan_are_one_value_each(spark, rows):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (NAN,), (0.0,), (-0.0,)], "x double")
    found = rows(tg.cardinality(df))["x"]
    assert (found["cardinality"], found["top_count"]) == (4, 2)


def test_unique_rate(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x bigint")
    assert rows(tg.cardinality(df))["x"]["unique_rate"] == 0.75
    near = rows(tg.cardinality(df, approx=True))["x"]
    assert (near["cardinality"], near["top_count"]) == (3, None)


def test_large_integers_stay_apart(spark, rows):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,)], "x bigint")
    assert rows(tg.cardinality(df))["x"]["cardinality"] == 2


def test_long_texts_differ_in_their_last_character(spark, rows):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "b",)], "t string")
    found = rows(tg.cardinality(df))["t"]
    assert (found["cardinality"], found["top_count"]) == (2, 2)


def test_value_counts_show_python_text(spark):
    df = spark.createDataFrame(
        [(True, 0.1, 3, "a"), (False, 1e20, 3, None), (None, 1e-7, 4, "a"), (True, 12345678.5, 4, "it's")],
        "flag boolean, x double, i int, s string",
    )
    found = {(r["column"], r["value"]): r["n"] for r in tg.value_counts(df).collect()}
    assert found["flag", "True"] == 2 and found["flag", "None"] == 1
    assert {v for c, v in found if c == "x"} == {"0.1", "1e+20", "1e-07", "12345678.5"}
    assert found["i", "3"] == 2 and found["s", "a"] == 2 and found["s", "None"] == 1
    assert sum(n for (c, _), n in found.items() if c == "s") == 4


def test_counts_descend(spark):
    df = spark.createDataFrame([(v,) for v in "bbbaacc"], "s string")
    ordered = tg.sorted_counts(tg.value_counts(df)).collect()
    assert [(r["value"], r["n"]) for r in ordered] == [("b", 3), ("a", 2), ("c", 2)]


def test_top_categories(spark):
    df = spark.range(300).selectExpr("concat('c', id % 25) as many", "concat('d', id % 19) as few")
    found = tg.top_categories(tg.value_counts(df)).collect()
    many = [r for r in found if r["column"] == "many"]
    few = [r for r in found if r["column"] == "few"]
    assert (len(many), {r["remaining"] for r in many}) == (20, {5})
    assert (len(few), {r["remaining"] for r in few}) == (19, {None})
    exactly = tg.top_categories(tg.value_counts(df.select("many")), limit=25)
    assert {r["remaining"] for r in exactly.collect()} == {0}


def test_flags(spark):
    df = spark.range(60).selectExpr("id as many", "1 as one", "id % 3 as few")
    flags = {r["column"]: (r["is_high_cardinality"], r["is_constant"]) for r in tg.cardinality_flags(tg.cardinality(df)).collect()}
    assert flags == {"many": (True, False), "one": (False, True)}


def test_empty_selections(spark):
    df = spark.range(3).selectExpr("double(id) as x")
    assert tg.value_counts(df, []).count() == 0
    assert tg.cardinality(df, []).count() == 0
    assert tg.cardinality(df, [], approx=True).count() == 0
    assert tg.data_quality(df, []).count() == 0
    assert tg.low_variation_categorical(df).count() == 0


def test_more_categories_than_a_window_limits(spark):
    df = spark.range(5000).selectExpr("concat('v', id % 2500) as v", "id")
    found = tg.top_categories(tg.value_counts(df, ["v"]), limit=2000).collect()
    assert len(found) == 2000 and {r["remaining"] for r in found} == {500}
    assert sorted(r["rank"] for r in found) == list(range(1, 2001))
    assert [r["value"] for r in sorted(found, key=lambda r: r["rank"])] == sorted({f"v{i}" for i in range(2500)})[:2000]
