"""Distinct values: counts, cardinality, most frequent categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import dtypes, text
from tabgauge.functions.frames import (
    Cell,
    long_form,
    small_frame,
    sql_text,
    union_all,
)
from tabgauge.functions.values import column, epoch

# Fixed value: categories listed one by one in a report.
TOP_CATEGORIES = 20

# Distinct values that mark a column as high in cardinality.
HIGH_CARDINALITY = 50

# Longer texts are grouped by a digest of the whole text, so that the shuffle
# moves 64 characters per distinct text instead of the text.
DIGEST_ABOVE_BYTES = 64
# Ranks up to which Spark limits a window in every task, and parts beyond that.
GROUP_LIMIT = 1000
PARTS = 256


def value_family(dtype: T.DataType) -> str:
    """Type under which values of a column are told apart."""
    kind = dtypes.semantic_type(dtype)
    if kind in (dtypes.BOOLEAN, dtypes.INTEGER, dtypes.DATE, dtypes.DATETIME):
        return "bigint"
    if dtypes.has_nan(dtype):
        return "double"
    return "string"


def value_key(name: str, dtype: T.DataType) -> str:
    """SQL for a value of the family's type that tells the values apart."""
    kind = dtypes.semantic_type(dtype)
    value = column(name)
    if kind in (dtypes.DATE, dtypes.DATETIME):
        return epoch(name, dtype)
    if isinstance(dtype, T.BinaryType):
        value = f"hex({value})"
    value = f"cast({value} as {value_family(dtype)})"
    if value_family(dtype) != "string" or isinstance(dtype, T.DecimalType):
        return value
    return (
        f"if(octet_length({value}) > {DIGEST_ABOVE_BYTES}, "
        f"concat('sha256:', sha2({value}, 256)), {value})"
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """Frames ``(id, value, n)``, one per value type, with ``id`` the position.

    Long texts appear as digests. Equal values meet before the shuffle, so a
    value that fills a third of a column moves once per task.
    """
    families: dict[str, dict[int, Cell]] = {}
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        cell = Cell({"value": value_key(name, dtype)}, {"value": "{value}"})
        families.setdefault(value_family(dtype), {})[i] = cell
    return [
        (
            family,
            long_form(df, cells).groupBy("id", "value").agg(F.count(F.lit(1)).alias("n")),
        )
        for family, cells in families.items()
    ]


CARDINALITY_SCHEMA = (
    "column string, row_count bigint, cardinality bigint, unique_rate double, top_count bigint"
)


def cardinality(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Distinct values of every column, null counting as one value.

    Also the share of distinct values and the count of the most frequent one.
    ``approx=True`` estimates the cardinality in one scan without a shuffle of
    the values and leaves ``top_count`` null.
    """
    columns = list(df.columns if columns is None else columns)
    dtypes.require_columns(df, columns)
    if not columns:
        return small_frame(df, [], CARDINALITY_SCHEMA)
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    names = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("column")) for i, n in enumerate(columns)])
    frame = rows.select(F.inline(names), "row_count")
    if approx:
        sketches = [
            f"approx_count_distinct({value_key(n, df.schema[n].dataType)}) "
            f"+ coalesce(int(bool_or({column(n)} is null)), 0)"
            for n in columns
        ]
        estimates = df.selectExpr(f"array({', '.join(sketches)}) as found").select(
            F.posexplode("found").alias("id", "cardinality")
        )
        found = estimates.withColumn("top_count", F.lit(None).cast("bigint"))
    else:
        found = union_all(
            [
                values.groupBy("id").agg(
                    F.count(F.lit(1)).alias("cardinality"),
                    F.max("n").alias("top_count"),
                )
                for _, values in distinct_values(df, columns)
            ]
        )
    return frame.join(found, "id", "left").select(
        "column",
        "row_count",
        F.coalesce("cardinality", F.lit(0)).cast("bigint").alias("cardinality"),
        F.coalesce(
            F.try_divide(F.col("cardinality"), F.col("row_count")), F.lit(0.0)
        ).alias("unique_rate"),
        "top_count",
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per column and value as ``(column, value, n)``, null included.

    Values are grouped in their own type; only distinct values become text.
    """
    columns = list(df.columns if columns is None else columns)
    dtypes.require_columns(df, columns)
    if not columns:
        return small_frame(df, [], "column string, value string, n bigint")
    groups: dict[T.DataType, list[str]] = {}
    for name in columns:
        groups.setdefault(_group_type(df.schema[name].dataType), []).append(name)
    parts = []
    for dtype, names in groups.items():
        cells = {
            i: Cell(
                {"value": _groupable(n, df.schema[n].dataType, dtype)},
                {"value": "{value}"},
            )
            for i, n in enumerate(names)
        }
        counts = (
            long_form(df, cells).groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        label = f"array({', '.join(map(sql_text, names))})[id]"
        shown = text.value_text("value", dtype)
        parts.append(counts.selectExpr(f"{label} as column", f"{shown} as value", "n"))
    return union_all(parts)


def _group_type(dtype: T.DataType) -> T.DataType:
    """Widest type that keeps the values of a column apart and shows them alike."""
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    if dtypes.has_nan(dtype):
        return T.DoubleType()
    if dtypes.semantic_type(dtype) in (dtypes.TEXT, dtypes.UNKNOWN):
        return T.StringType()
    return dtype


def _groupable(name: str, dtype: T.DataType, group: T.DataType) -> str:
    value = column(name)
    if isinstance(dtype, T.BinaryType):
        value = f"hex({value})"
    return f"cast({value} as {group.simpleString()})"


def sorted_counts(counts: DataFrame) -> DataFrame:
    """Counts of each column in descending order, ties by value."""
    return counts.orderBy("column", F.desc("n"), "value")


def top_categories(
    counts: DataFrame, limit: int = TOP_CATEGORIES, sizes: DataFrame | None = None
) -> DataFrame:
    """The first ``limit`` categories of every column and how many are left.

    ``remaining`` is null where fewer than ``limit`` categories exist, since
    then all of them are listed. ``sizes`` may give ``(column, categories)``
    where they are known, which spares counting them.
    """
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    if limit > GROUP_LIMIT:
        # Beyond what Spark cuts off inside each task, a column's values would all meet
        # in one. Parts of them are cut first; none of the first ``limit`` can be lost.
        part = Window.partitionBy("column", F.pmod(F.hash("value"), F.lit(PARTS)))
        ranked = counts.withColumn("rank", F.row_number().over(part.orderBy(F.desc("n"), "value")))
        first = ranked.filter(F.col("rank") <= limit).drop("rank")
        if sizes is None:
            sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("categories"))
        counts = first
    top = counts.withColumn("rank", F.row_number().over(by_count)).filter(
        F.col("rank") <= limit
    )
    if sizes is None:
        sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("categories"))
    # One row per column of the table on this side.
    return top.join(F.broadcast(sizes), "column").select(
        "column",
        "value",
        "n",
        "rank",
        "categories",
        F.when(
            F.col("categories") >= limit, F.col("categories") - F.lit(limit)
        ).alias("remaining"),
    )


def cardinality_flags(found: DataFrame, threshold: int = HIGH_CARDINALITY) -> DataFrame:
    """Columns that hold one value only, or more than ``threshold``."""
    flags = found.select(
        "column",
        "cardinality",
        (F.col("cardinality") > threshold).alias("is_high_cardinality"),
        (F.col("cardinality") == 1).alias("is_constant"),
    )
    return flags.filter("is_high_cardinality or is_constant")
