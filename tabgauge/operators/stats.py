"""Descriptive statistics of numeric, text and temporal columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from tabgauge.functions import dtypes, text
from tabgauge.functions.frames import Cell, one_row_per_column, small_frame, sql_double
from tabgauge.functions.values import MICROS_PER_SECOND, column, epoch, number
from tabgauge.operators.missing import COUNT_KINDS, counting_cell

# Fields of the basic summary and their types.
BASIC_KINDS = COUNT_KINDS | {
    "min": "double",
    "max": "double",
    "min_exact": "string",
    "max_exact": "string",
    "mean": "double",
    "char_length_min": "int",
    "char_length_max": "int",
    "char_length_mean": "double",
    "char_length_std": "double",
    "temporal_min": "string",
    "temporal_max": "string",
    "temporal_diff_seconds": "bigint",
    "first_epoch": "bigint",
    "last_epoch": "bigint",
}


def basic_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Everything about each column that one plain scan can tell."""
    cells = {}
    for name in df.columns if columns is None else columns:
        dtype = df.schema[name].dataType
        kind = dtypes.semantic_type(dtype)
        cell = counting_cell(df, name)
        if kind in dtypes.NUMERIC:
            cell.inputs["value"] = number(name, dtype)
            cell.fields |= {
                "min": "min({value})",
                "max": "max({value})",
                "mean": "avg({value})",
            }
            _add_exact(cell, name, dtype)
        elif kind in dtypes.TEMPORAL:
            _add_temporal(cell, name, dtype)
            cell.fields |= {
                "first_epoch": "min({epoch})",
                "last_epoch": "max({epoch})",
            }
        elif kind == dtypes.TEXT:
            _add_lengths(cell, name)
        cells[name] = cell
    return one_row_per_column(df, cells, BASIC_KINDS, 8)


def _add_exact(cell: Cell, name: str, dtype: T.DataType) -> None:
    """Smallest and largest whole number or decimal as text, with all digits; a double holds its own already."""
    if not dtypes.has_nan(dtype):
        cell.inputs["typed"] = column(name)
        cell.fields |= {"min_exact": "string(min({typed}))", "max_exact": "string(max({typed}))"}


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of the numeric columns.

    Missing values are left out. The deviation of a single value is null. ``min_exact`` and
    ``max_exact`` hold whole numbers and decimals with all their digits.
    """
    cells = {
        name: Cell(
            {"value": number(name, df.schema[name].dataType)},
            {
                "min": "min({value})",
                "max": "max({value})",
                "mean": "avg({value})",
                "std": "stddev_samp({value})",
            },
        )
        for name in dtypes.numeric_columns(df, columns)
    }
    for name, cell in cells.items():
        _add_exact(cell, name, df.schema[name].dataType)
    kinds = {"min": "double", "max": "double", "min_exact": "string", "max_exact": "string", "mean": "double", "std": "double"}
    return one_row_per_column(df, cells, kinds, 9)


def deviation(df: DataFrame, name: str, center: float, scale: float) -> str:
    """Distance from the center in units of the scale."""
    value = number(name, df.schema[name].dataType)
    return f"(({value} - {sql_double(center)}) * {sql_double(1.0 / scale)})"


def unit_scale(basic: Row) -> float | None:
    """Largest distance from the mean; none if the column does not vary.

    Sums of powers of deviations in this unit neither overflow nor cancel.
    """
    if basic["mean"] is None or basic["min"] == basic["max"]:
        return None
    scale = max(basic["max"] - basic["mean"], basic["mean"] - basic["min"])
    usable = 0.0 < scale < float("inf") and 1.0 / scale < float("inf")
    return scale if usable else float("nan")


def moments_around(
    df: DataFrame, basics: Mapping[str, Row], columns: Sequence[str] | None = None
) -> DataFrame:
    """Deviation, skewness and excess kurtosis, given each column's mean.

    With the mean known the moments are plain sums of powers, so one scan
    covers all columns inside generated code.
    """
    cells, constants = {}, {}
    for name in dtypes.numeric_columns(df, columns):
        basic = basics[name]
        scale = unit_scale(basic)
        valid = basic["row_count"] - basic["missing_count"]
        if scale is None:
            constants[name] = 0.0 if valid > 1 else None
        elif scale != scale:
            constants[name] = float("nan")
        else:
            cells[name] = Cell(
                {"d": deviation(df, name, basic["mean"], scale)},
                {
                    "scale": sql_double(scale),
                    "n": str(valid),
                    "s1": "sum({d})",
                    "s2": "sum({d} * {d})",
                    "s3": "sum({d} * {d} * {d})",
                    "s4": "sum({d} * {d} * {d} * {d})",
                },
            )
    kinds = dict.fromkeys(("scale", "n", "s1", "s2", "s3", "s4"), "double")
    sums = one_row_per_column(df, cells, kinds, 4)
    m1, m2 = "s1 / n", "(s2 / n - pow(s1 / n, 2))"
    m3 = f"(s3 / n - 3 * {m1} * s2 / n + 2 * pow({m1}, 3))"
    m4 = f"(s4 / n - 4 * {m1} * s3 / n + 6 * pow({m1}, 2) * s2 / n - 3 * pow({m1}, 4))"
    varied = sums.selectExpr(
        "column",
        f"sqrt(greatest({m2}, 0) * n / (n - 1)) * scale as std",
        f"try_divide({m3}, pow({m2}, 1.5)) as skewness",
        f"try_divide({m4}, pow({m2}, 2)) - 3 as kurtosis",
    )
    if not constants:
        return varied
    still = small_frame(
        df,
        [(n, std, std or None, std or None) for n, std in constants.items()],
        "column string, std double, skewness double, kurtosis double",
    )
    return varied.unionByName(still) if cells else still


def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis of the numeric columns.

    Two scans: one for the means, one for the sums of powers around them.
    Null for a column that does not vary.
    """
    names = dtypes.numeric_columns(df, columns)
    basics = {row["column"]: row for row in basic_summary(df, names).collect()}
    return moments_around(df, basics, names).drop("std")


def _add_lengths(cell: Cell, name: str) -> None:
    """Aggregates over the character length of a text column."""
    cell.inputs["length"] = f"char_length({column(name)})"
    cell.fields |= {
        "char_length_min": "min({length})",
        "char_length_max": "max({length})",
        "char_length_mean": "avg({length})",
        "char_length_std": "stddev_samp({length})",
    }


def string_length_stats(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Shortest, longest, mean and deviation of the text lengths in characters."""
    names = dtypes.select_by_type(df, dtypes.TEXT) if columns is None else columns
    dtypes.require_columns(df, names)
    cells = {name: Cell() for name in names}
    for name, cell in cells.items():
        _add_lengths(cell, name)
    kinds = {k: t for k, t in BASIC_KINDS.items() if k.startswith("char_length")}
    return one_row_per_column(df, cells, kinds, 7)


def _add_temporal(cell: Cell, name: str, dtype: T.DataType) -> None:
    """First value, last value and span of a temporal column."""
    cell.inputs |= {"time": column(name), "epoch": epoch(name, dtype)}
    ticks = "max({epoch}) - min({epoch})"
    kind = dtypes.semantic_type(dtype)
    if kind == dtypes.DATE:
        ticks = f"({ticks}) * {text.SECONDS_PER_DAY}"
    elif kind == dtypes.DATETIME:
        ticks = f"({ticks}) div {MICROS_PER_SECOND}"
    cell.fields |= {
        "temporal_min": text.temporal_text("min({time})", dtype),
        "temporal_max": text.temporal_text("max({time})", dtype),
        "temporal_diff_seconds": ticks,
    }


def temporal_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First value, last value and span in whole seconds."""
    names = dtypes.select_by_type(df, *dtypes.TEMPORAL) if columns is None else columns
    dtypes.require_columns(df, names)
    cells = {name: Cell() for name in names}
    for name, cell in cells.items():
        _add_temporal(cell, name, df.schema[name].dataType)
    kinds = {k: t for k, t in BASIC_KINDS.items() if k.startswith("temporal")}
    return one_row_per_column(df, cells, kinds, 4)
