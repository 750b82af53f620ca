"""Outliers and low variation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.frames import (
    one_row_per_column,
    small_frame,
    sql_double,
    union_all,
)
from tabgauge.functions.values import column, epoch, number
from tabgauge.operators.missing import counting_cell
from tabgauge.operators.order_stats import (
    nearest_rank,
    order_statistics,
    ranks_for,
    whole_column,
)
from tabgauge.operators.stats import basic_summary, numeric_stats
from tabgauge.operators.values import cardinality

# Defaults of the outlier and variation rules.
ZSCORE_THRESHOLD = 3.0
VARIANCE_THRESHOLD = 0.01
DOMINANT_SHARE = 1 - 0.2
FENCE_WIDTH = 1.5

QUALITY_SCHEMA = (
    "column string, outlier_count bigint, outlier_rate double, "
    "has_low_variation boolean"
)
QUALITY_KINDS = {
    "row_count": "bigint",
    "missing_count": "bigint",
    "outlier_count": "bigint",
    "has_low_variation": "boolean",
}


def check_thresholds(zscore: float, variance: float) -> None:
    """A z-score is not negative; a variance threshold lies within 0 and 1."""
    if zscore < 0:
        raise ValueError(f"z-score threshold must not be negative, got {zscore}.")
    if not 0 <= variance <= 1:
        raise ValueError(f"variance threshold must lie in 0..1, got {variance}.")


def _rated(counts: DataFrame) -> DataFrame:
    """Add the rate over all rows; a column without values gets the defaults."""
    empty = F.col("missing_count") == F.col("row_count")
    return counts.select(
        "column",
        F.when(empty, 0).otherwise(F.col("outlier_count")).alias("outlier_count"),
        F.when(empty, 0.0)
        .otherwise(F.try_divide("outlier_count", "row_count"))
        .alias("outlier_rate"),
        F.when(empty, True).otherwise(F.col("has_low_variation")).alias("has_low_variation"),
    )


def outliers_zscore(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    zscore: float = ZSCORE_THRESHOLD,
    variance: float = VARIANCE_THRESHOLD,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Numeric values further than ``zscore`` deviations from the mean.

    NaN counts as an outlier, null does not, and the rate is over all rows. A
    constant column has no outliers. ``stats`` may give ``(column, mean,
    std)`` to use instead of the column's own; what it lacks is worked out.
    """
    names = dtypes.numeric_columns(df, columns)
    given = given_stats(stats)
    lacking = [n for n in names if None in given.get(n, (None, None))]
    # One row per column of the table comes back here.
    own = {r["column"]: (r["mean"], r["std"]) for r in numeric_stats(df, lacking).collect()} if lacking else {}
    return outliers_around(df, names, preferred(given, own), zscore, variance)


def given_stats(stats: DataFrame | None) -> dict[str, tuple[float | None, float | None]]:
    """Mean and deviation by column, one row per column."""
    return {} if stats is None else {r["column"]: (r["mean"], r["std"]) for r in stats.select("column", "mean", "std").collect()}


def preferred(
    given: Mapping[str, tuple[float | None, float | None]], own: Mapping[str, tuple[float | None, float | None]]
) -> dict[str, tuple[float | None, float | None]]:
    """The given values, and the column's own where they lack one."""
    names = {**own, **given}
    return {
        n: tuple(g if g is not None else o for g, o in zip(given.get(n, (None, None)), own.get(n, (None, None)), strict=True))
        for n in names
    }


def outlier_flag(df: DataFrame, name: str, mean: float, std: float, zscore: float) -> str:
    """SQL for whether a row is an outlier, given the mean and deviation."""
    dtype = df.schema[name].dataType
    value = f"{number(name, dtype)} - {sql_double(mean)}"
    far = f"abs(try_divide({value}, {sql_double(std)})) > {sql_double(float(zscore))}"
    if dtypes.has_nan(dtype):
        far = f"{far} or isnan({column(name)})"
    return f"coalesce({far}, false)"


def outliers_around(
    df: DataFrame,
    names: Sequence[str],
    known: Mapping[str, tuple[float | None, float | None]],
    zscore: float,
    variance: float,
) -> DataFrame:
    """Count z-score outliers in one scan, means and deviations being known."""
    check_thresholds(zscore, variance)
    cells = {}
    for name in names:
        mean, std = known.get(name, (None, None))
        cell = cells[name] = counting_cell(df, name)
        if mean is not None and std is not None:
            cell.inputs["outlier"] = outlier_flag(df, name, mean, std, zscore)
            cell.fields |= {
                "outlier_count": "count_if({outlier})",
                "has_low_variation": str(std * std < variance),
            }
    return _rated(one_row_per_column(df, cells, QUALITY_KINDS, 3))


def temporal_quartiles(
    df: DataFrame, basics: Mapping[str, Row], names: Sequence[str]
) -> dict[str, tuple[float, float]]:
    """Quartiles that are values of the column, as ordinals."""
    valid = {n: basics[n]["row_count"] - basics[n]["missing_count"] for n in names}
    ranks = ranks_for(valid, (0.25, 0.75), nearest=True)
    brackets = [
        whole_column(n, *temporal_range(df, n, basics[n]), valid[n], ranks[n])
        for n in names
        if valid[n]
    ]
    found = order_statistics(df, brackets)
    return {
        b.name: tuple(
            found[b.name, nearest_rank(valid[b.name], q)] for q in (0.25, 0.75)
        )
        for b in brackets
    }


def temporal_range(df: DataFrame, name: str, basic: Row) -> tuple[float, float]:
    """First and last ordinal of a temporal column."""
    first, last = basic["first_epoch"], basic["last_epoch"]
    if dtypes.semantic_type(df.schema[name].dataType) == dtypes.DATETIME:
        first, last = first // 1000, last // 1000
    return float(first), float(last)


def fence_flag(df: DataFrame, name: str, quartiles: tuple[float, float]) -> str:
    """SQL for whether a temporal value lies outside the fences around the quartiles."""
    dtype = df.schema[name].dataType
    q1, q3 = quartiles
    reach = FENCE_WIDTH * (q3 - q1)
    # Ordinals of timestamps are milliseconds, values compare as microseconds.
    ticks = 1000 if dtypes.semantic_type(dtype) == dtypes.DATETIME else 1
    low, high = math.floor(q1 - reach) * ticks, math.ceil(q3 + reach) * ticks
    return f"coalesce({epoch(name, dtype)} not between {low} and {high}, false)"


def outliers_iqr_temporal(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Temporal values outside the quartile fences, and whether all are equal."""
    names = dtypes.select_by_type(df, *dtypes.TEMPORAL) if columns is None else columns
    dtypes.require_columns(df, names)
    for name in names:
        if name not in dtypes.select_by_type(df, *dtypes.TEMPORAL):
            raise ValueError(f"Column '{name}' is not temporal.")
    basics = {row["column"]: row for row in basic_summary(df, names).collect()}
    quartiles = temporal_quartiles(df, basics, names)
    return outliers_fenced(df, names, basics, quartiles)


def outliers_fenced(
    df: DataFrame,
    names: Sequence[str],
    basics: Mapping[str, Row],
    quartiles: Mapping[str, tuple[float, float]],
) -> DataFrame:
    """Count values outside the fences in one scan, quartiles being known."""
    cells = {}
    for name in names:
        basic = basics[name]
        # Null counts as a value of its own, so it has to be absent.
        uniform = not basic["missing_count"] and basic["first_epoch"] == basic["last_epoch"]
        cell = cells[name] = counting_cell(df, name)
        cell.fields["has_low_variation"] = str(uniform)
        if name in quartiles:
            cell.inputs["outlier"] = fence_flag(df, name, quartiles[name])
            cell.fields["outlier_count"] = "count_if({outlier})"
    return _rated(one_row_per_column(df, cells, QUALITY_KINDS, 3))


def low_variation_boolean(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Whether true, false or null fills more than 80% of a boolean column."""
    names = dtypes.select_by_type(df, dtypes.BOOLEAN) if columns is None else columns
    dtypes.require_columns(df, names)
    cells = {}
    for name in names:
        cell = cells[name] = counting_cell(df, name)
        cell.inputs["value"] = column(name)
        top = "greatest(count_if({value}), count_if(not {value}), count_if({missing}))"
        cell.fields |= {
            "outlier_count": "0",
            "has_low_variation": f"try_divide({top}, count(1)) > {DOMINANT_SHARE}D",
        }
    return _rated(one_row_per_column(df, cells, QUALITY_KINDS, 5))


def low_variation_categorical(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Whether one value, null included, fills more than 80% of a column."""
    names = dtypes.select_by_type(df, dtypes.TEXT) if columns is None else columns
    return dominance(cardinality(df, names))


def dominance(found: DataFrame) -> DataFrame:
    """Low variation from the count of the most frequent value."""
    dominant = F.try_divide("top_count", "row_count") > DOMINANT_SHARE
    # On an empty table no value is present, as in a column without values.
    return found.select(
        "column",
        F.lit(0).cast("bigint").alias("outlier_count"),
        F.lit(0.0).alias("outlier_rate"),
        F.coalesce(dominant, F.lit(True)).alias("has_low_variation"),
    )


def data_quality(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    zscore: float = ZSCORE_THRESHOLD,
    variance: float = VARIANCE_THRESHOLD,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Outliers and low variation of every column by the rule of its type.

    Columns of unknown type have nulls. ``stats`` may give ``(column, mean, std)`` of
    numeric columns, as in ``outliers_zscore``.
    """
    columns = list(df.columns if columns is None else columns)
    dtypes.require_columns(df, columns)
    kinds = {n: dtypes.semantic_type(df.schema[n].dataType) for n in columns}

    def of(*wanted: str) -> list[str]:
        return [n for n in columns if kinds[n] in wanted]

    parts = []
    if numbers := of(*dtypes.NUMERIC):
        parts.append(outliers_zscore(df, numbers, zscore, variance, stats))
    if times := of(*dtypes.TEMPORAL):
        parts.append(outliers_iqr_temporal(df, times))
    if texts := of(dtypes.TEXT):
        parts.append(low_variation_categorical(df, texts))
    if flags := of(dtypes.BOOLEAN):
        parts.append(low_variation_boolean(df, flags))
    if unknown := of(dtypes.UNKNOWN):
        parts.append(
            small_frame(df, [(n, None, None, None) for n in unknown], QUALITY_SCHEMA)
        )
    return union_all(parts) if parts else small_frame(df, [], QUALITY_SCHEMA)
