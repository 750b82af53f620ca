"""Pearson correlation of the numeric columns."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.frames import small_frame
from tabgauge.functions.values import number
from tabgauge.operators.comoments import correlations
from tabgauge.operators.stats import basic_summary

# Fixed value: absolute correlation from which a pair counts as strong.
STRONG_CORRELATION = 0.8
# Fixed value: decimals by which pairs are put in order. What lies beyond depends on the order of the sums,
# so that pairs of equal strength would come in another order for another number of tasks.
RANKED_DIGITS = 9

PEARSON_SCHEMA = "col_1 string, col_2 string, pos_1 int, pos_2 int, r double"


def pearson_long(
    df: DataFrame, columns: Sequence[str] | None = None, missing: str = "pairwise"
) -> DataFrame:
    """Correlation of every ordered pair of numeric columns.

    ``missing="pairwise"`` uses the rows where both values are present;
    ``missing="propagate"`` gives NaN to every pair with a missing value.
    A column that does not vary has NaN everywhere, on the diagonal too.
    """
    names = dtypes.numeric_columns(df, columns)
    if not names:
        warnings.warn("No numeric features found in the dataframe.", stacklevel=2)
        return small_frame(df, [], PEARSON_SCHEMA)
    basics = {row["column"]: row for row in basic_summary(df, names).collect()}
    return pearson_around(df, names, basics, missing)


def pearson_around(
    df: DataFrame, names: Sequence[str], basics: Mapping[str, Row], missing: str
) -> DataFrame:
    """The matrix, given the ranges of the columns: one scan for any number of them.

    Each pair has its own means over its own rows, so a far value in a row that
    the pair leaves out does not touch it.
    """
    if missing not in ("pairwise", "propagate"):
        raise ValueError(f"missing must be 'pairwise' or 'propagate', not '{missing}'.")
    values = df.selectExpr(
        *(f"{number(n, df.schema[n].dataType)} as x{i}" for i, n in enumerate(names))
    )
    rated = correlations(values, [_power_of_two(basics[n]) for n in names])
    if missing == "propagate":
        gaps = [i for i, n in enumerate(names) if basics[n]["missing_count"] > 0]
        hit = F.col("pos_1").isin(gaps) | F.col("pos_2").isin(gaps)
        rated = rated.withColumn("r", F.when(hit, float("nan")).otherwise(F.col("r")))
    ordered = F.array(
        F.struct("pos_1", "pos_2"),
        F.struct(F.col("pos_2").alias("pos_1"), F.col("pos_1").alias("pos_2")),
    )
    both = rated.select(F.explode(F.array_distinct(ordered)).alias("pair"), "r")
    if not any(basics[n]["row_count"] for n in names):
        both = _without_rows(df, len(names))
    listed = F.array(*map(F.lit, names))
    return both.select(
        F.element_at(listed, F.col("pair.pos_1") + 1).alias("col_1"),
        F.element_at(listed, F.col("pair.pos_2") + 1).alias("col_2"),
        "pair.pos_1",
        "pair.pos_2",
        "r",
    )


def _power_of_two(basic: Row) -> float:
    """A factor that brings the largest value near 1; 1 where there is no finite range."""
    ends = [abs(v) for v in (basic["min"], basic["max"]) if v is not None and math.isfinite(v)]
    exponent = math.frexp(max(ends, default=1.0) or 1.0)[1]
    return 2.0 ** -min(max(exponent, -1000), 1000)


def _without_rows(df: DataFrame, n: int) -> DataFrame:
    """NaN for every pair of a table without rows."""
    pairs = df.sparkSession.range(n * n)
    place = F.struct(
        F.floor(F.col("id") / n).cast("int").alias("pos_1"),
        (F.col("id") % n).cast("int").alias("pos_2"),
    )
    return pairs.select(place.alias("pair"), F.lit(float("nan")).alias("r"))


def pearson_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """The matrix with an ``index`` column and one column per numeric column."""
    wide = long.groupBy(F.col("col_1").alias("index"), "pos_1").pivot("col_2", list(names))
    return wide.agg(F.first("r")).orderBy("pos_1").drop("pos_1")


def pearson_lookup(long: DataFrame, col_1: str, col_2: str) -> DataFrame:
    """The row of one pair; empty if the matrix lacks a column."""
    return long.filter((F.col("col_1") == col_1) & (F.col("col_2") == col_2)).select(
        "col_1", "col_2", "r"
    )


def pearson_value(long: DataFrame, col_1: str, col_2: str) -> float | None:
    """Correlation of one pair, or none with a warning if it is absent."""
    row = pearson_lookup(long, col_1, col_2).first()
    if row is None:
        warnings.warn(
            f"Pair '{col_1}', '{col_2}' not found in correlation matrix.", stacklevel=2
        )
        return None
    return row["r"]


def strong_correlations(
    long: DataFrame, threshold: float = STRONG_CORRELATION
) -> DataFrame:
    """Pairs with an absolute correlation from the threshold up, strongest first, equal ones by position."""
    # NaN sorts above every number in Spark, so it has to be kept out by name.
    strong = (F.abs("r") >= threshold) & ~F.isnan("r")
    return (
        long.filter((F.col("pos_1") < F.col("pos_2")) & strong)
        .orderBy(F.desc(F.round(F.abs("r"), RANKED_DIGITS)), "pos_1", "pos_2")
        .select("col_1", "col_2", "r")
    )
