"""Missing and infinite values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import dtypes, text
from tabgauge.functions.frames import Cell, one_row_per_column
from tabgauge.functions.values import is_infinite, is_missing

# Fixed value: share of missing values above which a column is reported.
HIGH_MISSING_RATE = 0.3


def drop_missing(df: DataFrame, name: str) -> DataFrame:
    """Rows where the column is neither null nor NaN; all columns are kept."""
    dtypes.require_columns(df, [name])
    return df.filter(f"not {is_missing(name, df.schema[name].dataType)}")


def keep_infinite(df: DataFrame, name: str) -> DataFrame:
    """Rows where a numeric column is plus or minus infinity."""
    dtypes.require_columns(df, [name])
    return df.filter(is_infinite(name, df.schema[name].dataType))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, missing values, missing rate and infinities of every column.

    The rate is null on an empty table.
    """
    columns = list(df.columns if columns is None else columns)
    dtypes.require_columns(df, columns)
    cells = {name: counting_cell(df, name) for name in columns}
    return one_row_per_column(df, cells, COUNT_KINDS, 3)


# Fields of the counts and their types.
COUNT_KINDS = {
    "row_count": "bigint",
    "missing_count": "bigint",
    "missing_rate": "double",
    "inf_count": "bigint",
}


def counting_cell(df: DataFrame, name: str) -> Cell:
    """Counts of rows, missing values and infinities of one column."""
    dtype = df.schema[name].dataType
    cell = Cell(
        {"missing": is_missing(name, dtype)},
        {
            "row_count": "count(1)",
            "missing_count": "count_if({missing})",
            "missing_rate": "try_divide(count_if({missing}), count(1))",
            "inf_count": "0",
        },
    )
    if dtypes.has_nan(dtype):
        cell.inputs["infinite"] = is_infinite(name, dtype)
        cell.fields["inf_count"] = "count_if({infinite})"
    return cell


def missing_rate_table(counts: DataFrame) -> DataFrame:
    """Columns with missing values and their rate as a percentage text."""
    percent = text.say(text.fixed("(missing_rate * 100)", 4), "'%'")
    return counts.filter("missing_rate > 0").selectExpr(
        "column", f"{percent} as missing_percent"
    )


def missing_columns(counts: DataFrame) -> DataFrame:
    """Columns that have at least one missing value."""
    return counts.filter(F.col("missing_count") > 0).select("column", "missing_count")


def high_missing_columns(
    counts: DataFrame, threshold: float = HIGH_MISSING_RATE
) -> DataFrame:
    """Columns whose missing rate lies above the threshold."""
    return counts.filter(F.col("missing_rate") > threshold).select(
        "column", "missing_rate"
    )
