"""Shapes shared by the operators: one-row aggregates and the long form."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

# More sums than this in one aggregate outgrow what the JVM compiles, and the
# aggregate then runs many times slower. Columns are split over several
# aggregates instead; each reads only its own columns.
MAX_SUMS_PER_AGGREGATE = 80


@dataclass
class Cell:
    """Work on one column, as SQL: inputs, and fields over them as ``{input}``."""

    inputs: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)


def sql_double(value: float | None) -> str:
    """A double as a SQL constant that keeps every digit."""
    return "double(null)" if value is None else f"double('{float(value)!r}')"


def sql_text(value: str) -> str:
    """A string as a SQL constant."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union frames of one schema."""
    return reduce(DataFrame.unionByName, frames)


def _project(df: DataFrame, cells: Mapping[int, Cell]) -> DataFrame:
    return df.selectExpr(
        *(
            f"{value} as c{i}_{key}"
            for i, cell in cells.items()
            for key, value in cell.inputs.items()
        )
    )


def _bind(i: int, cell: Cell, sql: str) -> str:
    return sql.format(**{key: f"c{i}_{key}" for key in cell.inputs})


def one_row_per_column(
    df: DataFrame,
    cells: Mapping[str, Cell],
    kinds: Mapping[str, str],
    sums_per_column: int,
) -> DataFrame:
    """Aggregate many columns in one scan and return one row for each.

    The fields of a cell are aggregates; ``kinds`` names the fields of the
    result and their types. Fields a column lacks are null.
    """
    if not cells:
        schema = ", ".join(["column string"] + [f"{k} {t}" for k, t in kinds.items()])
        return small_frame(df, [], schema)
    names = list(cells)
    size = max(1, MAX_SUMS_PER_AGGREGATE // sums_per_column)
    parts = []
    for start in range(0, len(names), size):
        batch = dict(enumerate(cells[n] for n in names[start : start + size]))
        rows = []
        for i, cell in batch.items():
            values = [f"'column', {sql_text(names[start + i])}"]
            for key, kind in kinds.items():
                sql = _bind(i, cell, cell.fields.get(key, "null"))
                values.append(f"'{key}', cast({sql} as {kind})")
            rows.append(f"named_struct({', '.join(values)})")
        totals = _project(df, batch).selectExpr(f"array({', '.join(rows)}) as rows")
        parts.append(totals.selectExpr("inline(rows)"))
    return union_all(parts)


def long_form(
    df: DataFrame, cells: Mapping[int, Cell], wanted: str | None = None
) -> DataFrame:
    """One row per table row and cell: ``id`` and the fields of the cell.

    All cells have the same fields. Nothing is shuffled. Rows whose input
    ``wanted`` is null are left out, table rows without any before they multiply.
    """
    names = list(next(iter(cells.values())).fields)
    rows = [
        ", ".join([str(i), *(_bind(i, cell, cell.fields[n]) for n in names)])
        for i, cell in cells.items()
    ]
    projected = _project(df, cells)
    if wanted:
        flags = ", ".join(f"c{i}_{wanted}" for i in cells)
        projected = projected.filter(f"coalesce({flags}) is not null")
    stacked = projected.selectExpr(
        f"stack({len(cells)}, {', '.join(rows)}) as (id, {', '.join(names)})"
    )
    return stacked.filter(f"{wanted} is not null") if wanted else stacked


def sql_value(value: object) -> str:
    """A plain Python value as a SQL constant."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return sql_double(value)
    return sql_text(value) if isinstance(value, str) else str(value)


def small_frame(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows per column of ``df``, known on the driver, as a frame.

    The rows are part of the plan, so they need no tasks of their own and
    Spark knows that they are small when it joins them.
    """
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    if not rows:
        cells = (f"cast(null as {kind}) as {name}" for name, kind in fields)
        return df.sparkSession.sql(f"select {', '.join(cells)} where false")
    cells = (f"cast({name} as {kind}) as {name}" for name, kind in fields)
    values = (f"({', '.join(map(sql_value, row))})" for row in rows)
    return df.sparkSession.sql(
        f"select {', '.join(cells)} from values {', '.join(values)} "
        f"as t({', '.join(name for name, _ in fields)})"
    )


#: Rows of a finished result that a plan, and that the driver, keep at most.
PLANNED_ROWS, KEPT_ROWS = 2_000, 200_000


def kept(frame: DataFrame, schema: str, rows: int) -> DataFrame:
    """The result of ``frame``, worked out once; ``rows`` is how many it has at most.

    Beyond ``KEPT_ROWS`` it goes to the folder in ``spark.checkpoint.dir``, or stays a plan where none is set.
    """
    if rows <= PLANNED_ROWS:
        return small_frame(frame, [tuple(row) for row in frame.collect()], schema)
    if rows <= KEPT_ROWS:
        return frame.sparkSession.createDataFrame(frame.toArrow(), frame.schema)
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return frame
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
