"""SQL for missing values, infinity and the number line of a column.

The operators put many such expressions into one aggregate. As SQL text they
reach Spark in one call instead of one call for every piece.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tabgauge.functions import dtypes

MICROS_PER_SECOND = 1_000_000

# Session zones in which a wall clock is already UTC.
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00")


def column(name: str) -> str:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return "`" + name.replace("`", "``") + "`"


def is_missing(name: str, dtype: T.DataType) -> str:
    """Null, or NaN in a floating column."""
    value = column(name)
    if dtypes.has_nan(dtype):
        return f"({value} is null or isnan({value}))"
    return f"({value} is null)"


def is_infinite(name: str, dtype: T.DataType) -> str:
    """Plus or minus infinity; always false outside floating columns."""
    if dtypes.has_nan(dtype):
        return f"coalesce(abs({column(name)}) = double('inf'), false)"
    return "false"


def number(name: str, dtype: T.DataType) -> str:
    """A numeric column as double, missing values as null."""
    value = column(name)
    if dtypes.has_nan(dtype):
        value = f"if(isnan({value}), null, {value})"
    return f"cast({value} as double)"


def epoch(name: str, dtype: T.DataType) -> str:
    """A temporal column as bigint: days, microseconds, or seconds of the day.

    A timestamp without a zone is read as UTC.
    """
    value = column(name)
    if isinstance(dtype, T.DateType):
        return f"bigint(unix_date({value}))"
    clock = f"(bigint(hour({value})) * 60 + minute({value}))"
    if isinstance(dtype, T.TimeType):
        return f"({clock} * 60 + second({value}))"
    if not isinstance(dtype, T.TimestampNTZType):
        return f"unix_micros({value})"
    session = SparkSession.getActiveSession()
    if session and session.conf.get("spark.sql.session.timeZone") in UTC_NAMES:
        return f"unix_micros(cast({value} as timestamp))"
    # A cast would shift by the session zone, so add up the wall clock fields.
    minutes = f"(bigint(unix_date(cast({value} as date))) * 1440 + {clock})"
    micros = f"bigint(extract(second from {value}) * {MICROS_PER_SECOND})"
    return f"({minutes} * 60 * {MICROS_PER_SECOND} + {micros})"


def ordinal(name: str, dtype: T.DataType) -> str:
    """The double that quantiles of a column are taken over.

    Numbers as they are, dates as epoch days, timestamps as epoch
    milliseconds, times as seconds of the day.
    """
    if dtypes.semantic_type(dtype) in dtypes.NUMERIC:
        return number(name, dtype)
    value = epoch(name, dtype)
    if dtypes.semantic_type(dtype) == dtypes.DATETIME:
        value = f"(({value} - pmod({value}, 1000)) / 1000)"
    return f"double({value})"
