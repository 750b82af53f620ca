"""Semantic types and roles of the columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.frames import small_frame
from tabgauge.operators.values import cardinality

TYPE_SCHEMA = (
    "column string, position int, type string, is_numeric boolean, "
    "is_temporal boolean, timezone string"
)


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns of the table."""
    return df.selectExpr("count(1) as num_rows", f"int({len(df.columns)}) as num_cols")


def resolve_type(
    df: DataFrame, name: str, declared: Mapping[str, str] | None = None
) -> str:
    """Type the caller declared for a column, else the one its schema implies."""
    own = dtypes.semantic_type(df.schema[name].dataType)
    kind = (declared or {}).get(name) or own
    if kind not in dtypes.SEMANTIC_TYPES:
        raise ValueError(f"Unknown semantic type '{kind}' for column '{name}'.")
    for family, label in ((dtypes.NUMERIC, "numbers"), (dtypes.TEMPORAL, "times")):
        if kind in family and own not in family:
            raise ValueError(f"Column '{name}' holds no {label}, so it cannot be '{kind}'.")
    return kind


def is_categorical(kind: str, distinct: int) -> bool:
    """Whether a column of this type and cardinality is treated as categories."""
    if kind in (dtypes.BOOLEAN, dtypes.CATEGORICAL, dtypes.STRING):
        return True
    few = distinct <= dtypes.CATEGORICAL_MAX_CARDINALITY
    return few and kind in (*dtypes.NUMERIC, dtypes.TEXT)


def schema_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    declared: Mapping[str, str] | None = None,
) -> DataFrame:
    """What the schema alone says about each column."""
    rows = []
    for position, name in enumerate(df.columns if columns is None else columns):
        kind = resolve_type(df, name, declared)
        rows.append(
            (
                name,
                position,
                kind,
                kind in dtypes.NUMERIC,
                kind in dtypes.TEMPORAL,
                dtypes.timezone_of(df, name),
            )
        )
    return small_frame(df, rows, TYPE_SCHEMA)


def column_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    declared: Mapping[str, str] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Type, flags, time zone and cardinality of every column."""
    columns = list(df.columns if columns is None else columns)
    found = cardinality(df, columns, approx).select(
        "column", "cardinality", "unique_rate"
    )
    few = F.col("cardinality") <= dtypes.CATEGORICAL_MAX_CARDINALITY
    counted = (*dtypes.NUMERIC, dtypes.TEXT)
    always = (dtypes.BOOLEAN, dtypes.CATEGORICAL, dtypes.STRING)
    # One row per column of the table on this side.
    return found.join(
        F.broadcast(schema_types(df, columns, declared)), "column"
    ).select(
        "column",
        "position",
        "type",
        (F.col("type").isin(*always) | (F.col("type").isin(*counted) & few)).alias(
            "is_categorical"
        ),
        "is_numeric",
        "is_temporal",
        "timezone",
        "cardinality",
        "unique_rate",
    )


def column_roles(
    df: DataFrame, target: str | None = None, features: Sequence[str] | None = None
) -> DataFrame:
    """Target first, then the features, with their place in the profile."""
    roles = dtypes.assign_roles(df, target, features)
    return small_frame(
        df,
        [(r.name, r.position, r.is_target, r.is_feature) for r in roles],
        "column string, position int, is_target boolean, is_feature boolean",
    )


def columns_by_type(types: DataFrame) -> DataFrame:
    """Column names of each type, in profile order."""
    members = F.array_sort(F.collect_list(F.struct("position", "column")))
    return types.groupBy("type").agg(F.transform(members, lambda m: m["column"]).alias("columns"))


def type_counts(types: DataFrame) -> DataFrame:
    """How many columns each type has."""
    return types.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
