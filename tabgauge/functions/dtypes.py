"""Rules that follow from the schema alone, so they cost no Spark job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Semantic type names.
BOOLEAN = "boolean"
INTEGER = "integer"
FLOAT = "float"
DATETIME = "datetime"
DATE = "date"
TIME = "time"
TEXT = "text"
STRING = "string"
CATEGORICAL = "categorical"
UNKNOWN = "unknown"

SEMANTIC_TYPES = (
    BOOLEAN,
    INTEGER,
    FLOAT,
    DATETIME,
    DATE,
    TIME,
    TEXT,
    STRING,
    CATEGORICAL,
    UNKNOWN,
)

NUMERIC = (INTEGER, FLOAT)
TEMPORAL = (DATETIME, DATE, TIME)

# Fixed value: most distinct values (null included) a categorical column has.
CATEGORICAL_MAX_CARDINALITY = 10


def semantic_type(dtype: T.DataType) -> str:
    """Semantic type of a Spark type; decimals count as floats."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.DateType):
        return DATE
    if isinstance(dtype, T.TimeType):
        return TIME
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    return UNKNOWN


def has_nan(dtype: T.DataType) -> bool:
    """True for types that can hold NaN and infinity."""
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise ``ValueError`` naming the first column the table lacks."""
    known = set(df.columns)
    for name in names:
        if name not in known:
            raise ValueError(f"Column '{name}' not found in DataFrame.")


def select_by_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns whose semantic type is one of ``kinds``."""
    return [f.name for f in df.schema.fields if semantic_type(f.dataType) in kinds]


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns in the given order, or in table order."""
    found = select_by_type(df, *NUMERIC)
    if columns is None:
        return found
    require_columns(df, columns)
    return [name for name in columns if name in found]


@dataclass(frozen=True)
class Role:
    """Place of a column in the profile."""

    name: str
    position: int
    is_target: bool
    is_feature: bool


def assign_roles(
    df: DataFrame,
    target: str | None = None,
    features: Sequence[str] | None = None,
) -> list[Role]:
    """Target first, then the features; features default to every other column."""
    if features is None:
        features = [name for name in df.columns if name != target]
    features = [name for name in features if name != target]
    names = ([] if target is None else [target]) + features
    require_columns(df, names)
    return [
        Role(name, position, name == target, name != target)
        for position, name in enumerate(names)
    ]


def timezone_of(df: DataFrame, name: str) -> str | None:
    """Session zone for instants; none for every other type."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return df.sparkSession.conf.get("spark.sql.session.timeZone")
    return None
