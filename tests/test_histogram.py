from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabgauge as tg
from tabgauge.operators.histogram import freedman_diaconis, sturges

NAN, INF = float("nan"), float("inf")


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def counts(df):
    return [(r["bin_key"], r["n"]) for r in df.orderBy("bin_idx").collect()]


def test_bins_are_closed_on_the_right(spark):
    found = counts(tg.histogram_numeric(numbers(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), bins=4))
    assert found == [
        ("[-inf,1.0000000000]", 0),
        ("[1.0000000000,2.0000000000]", 2),
        ("[2.0000000000,3.0000000000]", 1),
        ("[3.0000000000,4.0000000000]", 1),
        ("[4.0000000000,5.0000000000]", 1),
        ("[5.0000000000,inf]", 0),
    ]


def test_default_and_custom_bin_counts(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert tg.histogram_numeric(df).count() == 12
    assert tg.histogram_numeric(df, bins=lambda c: F.lit(7)).count() == 9
    assert tg.histogram_numeric(df, bins=lambda c: F.count(c)).count() == 7
    with pytest.raises(ValueError, match="at least one bin"):
        tg.histogram_numeric(df, bins=0)
    with pytest.raises(ValueError, match="Unknown bin rule"):
        tg.histogram_numeric(df, bins="scott")


def test_counts_add_up_to_the_present_values(spark):
    values = list(np.random.default_rng(3).normal(size=500)) + [NAN, None, INF, -INF, INF]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    found = tg.histogram_numeric(df, bins=17).orderBy("bin_idx").collect()
    assert sum(r["n"] for r in found) == 503
    assert (found[0]["n"], found[-1]["n"]) == (1, 2)


def test_one_value_and_no_value(spark):
    found = counts(tg.histogram_numeric(numbers(spark, [3.0, 3.0]), bins=4))
    assert [n for _, n in found] == [0, 0, 2, 0, 0, 0]
    assert found[1][0] == "[2.5000000000,2.7500000000]"
    assert tg.histogram_numeric(numbers(spark, [None])).count() == 0


def test_rules():
    assert sturges(5) == 4 and sturges(0) == 1 and sturges(1) == 1
    assert freedman_diaconis(5, 2.0, 1.0, 5.0) == 2
    assert freedman_diaconis(5, 0.0, 1.0, 5.0) == 1
    assert freedman_diaconis(0, 0.0, 0.0, 0.0) == 1


def test_rule_names(spark):
    df = numbers(spark, [float(i) for i in range(100)])
    assert tg.histogram_numeric(df, bins="sturges").count() == sturges(100) + 2
    # Nearest quartiles of 0..99 are 25 and 74.
    assert tg.histogram_numeric(df, bins="freedman_diaconis").count() == freedman_diaconis(100, 49.0, 0.0, 99.0) + 2


def test_dispatch(spark):
    df = spark.range(100).selectExpr("id as many", "id % 3 as few", "concat('t', id) as text", "id > 5 as flag")
    found = tg.histogram_all(df).collect()
    keys = {}
    for row in found:
        keys.setdefault(row["column"], {})[row["key"]] = row["n"]
    assert set(keys) == {"many", "few", "flag"}
    assert keys["few"] == {"0": 34, "1": 33, "2": 33}
    assert keys["flag"] == {"True": 94, "False": 6}
    assert all(k.startswith("[") for k in keys["many"]) and sum(keys["many"].values()) == 100


def test_categorical(spark):
    df = spark.createDataFrame([(v,) for v in ["a", "b", "a", "c", "b", None]], "s string")
    assert {r["value"]: r["n"] for r in tg.histogram_categorical(df).collect()} == {"a": 2, "b": 2, "c": 1, "None": 1}


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="'nope'"):
        tg.histogram_all(spark.range(3), ["nope"])


def test_bin_rules_see_the_finite_range(spark):
    values = [float(i) for i in range(100)]
    plain = tg.histogram_numeric(numbers(spark, values), bins="freedman_diaconis").count()
    assert tg.histogram_numeric(numbers(spark, [*values, float("inf")]), bins="freedman_diaconis").count() == plain


@pytest.mark.parametrize("result", ["0", "-3", "null", "2.5"])
def test_a_bin_rule_has_to_give_a_whole_number(spark, result):
    with pytest.raises(ValueError, match="'numeric'"):
        tg.histogram_numeric(spark.range(9).selectExpr("double(id) as numeric"), bins=lambda c: F.max(F.expr(result)))


def test_many_bins(spark):
    df = numbers(spark, [0.0, 1.0, 1e15])
    found = tg.histogram_numeric(df, bins=1_000_000)
    assert found.count() == 1_000_002
    assert found.filter("n > 0").count() == 2
