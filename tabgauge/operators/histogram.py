"""Histograms of numbers and of categories."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabgauge.functions import dtypes, text
from tabgauge.functions.frames import Cell, long_form, small_frame, sql_double, union_all
from tabgauge.functions.values import number
from tabgauge.operators.order_stats import (
    nearest_rank,
    order_statistics,
    ranks_for,
    whole_column,
)
from tabgauge.operators.stats import basic_summary
from tabgauge.operators.types import is_categorical
from tabgauge.operators.values import cardinality, value_counts

# Bins when none are asked for, and the names of the bin rules.
DEFAULT_BINS = 10
FREEDMAN_DIACONIS = "freedman_diaconis"
STURGES = "sturges"

HISTOGRAM_SCHEMA = (
    "column string, bin_idx bigint, lower double, upper double, bin_key string, n bigint"
)

INFINITY = float("inf")

# A count, the name of a rule, or a function from a column to an aggregate.
BinRule = int | str | Callable[[Column], Column]


@dataclass(frozen=True)
class Grid:
    """Equal-width bins of one column."""

    name: str
    low: float
    high: float
    bins: int

    @property
    def start(self) -> float:
        """Left edge; a column with one value gets a bin range of width 1."""
        return self.low - 0.5 if self.low == self.high else self.low

    @property
    def width(self) -> float:
        if self.low == self.high:
            return 1.0 / self.bins
        spread = self.high - self.low
        if math.isfinite(spread):
            return spread / self.bins
        return self.high / self.bins - self.low / self.bins


def finite_ranges(
    df: DataFrame, names: Sequence[str], basics: Mapping[str, Row]
) -> dict[str, tuple[float, float]]:
    """Smallest and largest finite value of every column that has one."""
    ranges = {
        n: (basics[n]["min"], basics[n]["max"])
        for n in names
        if basics[n]["min"] is not None and not basics[n]["inf_count"]
    }
    infinite = [n for n in names if basics[n]["inf_count"]]
    if infinite:
        cells = []
        for name in infinite:
            value = number(name, df.schema[name].dataType)
            value = f"if(abs({value}) < double('inf'), {value}, null)"
            cells.append(f"named_struct('low', min({value}), 'high', max({value}))")
        found = df.selectExpr(f"array({', '.join(cells)}) as ranges").first()["ranges"]
        ranges |= {
            n: (r["low"], r["high"])
            for n, r in zip(infinite, found, strict=True)
            if r["low"] is not None
        }
    return ranges


def freedman_diaconis(valid: int, iqr: float, low: float, high: float) -> int:
    """Bins from the interquartile range and the finite range; 1 where either is zero."""
    if valid <= 0 or not iqr > 0:
        return 1
    width = 2 * iqr / valid ** (1 / 3)
    # Two quotients, since the difference of the ends may exceed the doubles.
    return max(1, math.ceil(high / width - low / width))


def sturges(valid: int) -> int:
    """Bins from the number of values; 1 where there are none."""
    return max(1, math.ceil(math.log2(valid) + 1)) if valid > 0 else 1


def bin_counts(
    df: DataFrame,
    names: Sequence[str],
    basics: Mapping[str, Row],
    rule: BinRule | None,
    ranges: Mapping[str, tuple[float, float]],
    quartiles: Mapping[str, tuple[float, float]] | None = None,
) -> dict[str, int]:
    """Bins of every column under a rule; ``ranges`` are the finite ones."""
    valid = {n: basics[n]["row_count"] - basics[n]["missing_count"] for n in names}
    if rule is None:
        return dict.fromkeys(names, DEFAULT_BINS)
    if isinstance(rule, int):
        if rule < 1:
            raise ValueError(f"A histogram needs at least one bin, got {rule}.")
        return dict.fromkeys(names, rule)
    if callable(rule):
        cells = [
            rule(F.expr(number(n, df.schema[n].dataType))).cast("double") for n in names
        ]
        found = df.agg(F.array(*cells).alias("bins")).first()["bins"] if cells else []
        for name, k in zip(names, found, strict=True):
            if k is None or not k >= 1 or k != math.floor(k):
                raise ValueError(f"The bin rule gives {k} bins for column '{name}'.")
        return {n: int(k) for n, k in zip(names, found, strict=True)}
    if rule == STURGES:
        return {n: sturges(valid[n]) for n in names}
    if rule == FREEDMAN_DIACONIS:
        if quartiles is None:
            quartiles = nearest_quartiles(df, names, basics)
        return {
            n: freedman_diaconis(
                valid[n] - basics[n]["inf_count"],
                quartiles[n][1] - quartiles[n][0],
                *ranges[n],
            )
            if n in quartiles
            else 1
            for n in names
        }
    raise ValueError(f"Unknown bin rule '{rule}'.")


def nearest_quartiles(
    df: DataFrame, names: Sequence[str], basics: Mapping[str, Row]
) -> dict[str, tuple[float, float]]:
    """Quartiles that are values of the column."""
    valid = {n: basics[n]["row_count"] - basics[n]["missing_count"] for n in names}
    ranks = ranks_for(valid, (0.25, 0.75), nearest=True)
    found = order_statistics(
        df,
        [
            whole_column(n, basics[n]["min"], basics[n]["max"], valid[n], ranks[n])
            for n in names
            if valid[n]
        ],
    )
    return {
        n: tuple(found[n, nearest_rank(valid[n], q)] for q in (0.25, 0.75))
        for n in names
        if valid[n]
    }


def histogram_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, bins: BinRule | None = None
) -> DataFrame:
    """Rows per equal-width bin of the numeric columns, empty bins included.

    Bins are closed on the right; the first one also holds the minimum. Bin 0
    and the last bin reach out to infinity and hold infinite values only.
    """
    names = dtypes.numeric_columns(df, columns)
    basics = {row["column"]: row for row in basic_summary(df, names).collect()}
    return histogram_on(df, grids(df, names, basics, bins))


def grids(
    df: DataFrame,
    names: Sequence[str],
    basics: Mapping[str, Row],
    rule: BinRule | None,
    quartiles: Mapping[str, tuple[float, float]] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
) -> list[Grid]:
    """Bins of the columns that have a finite value; ``ranges`` may give the finite ones."""
    if ranges is None:
        ranges = finite_ranges(df, names, basics)
    counts = bin_counts(df, list(ranges), basics, rule, ranges, quartiles)
    return [Grid(n, *ranges[n], counts[n]) for n in ranges]


def bin_sql(grid: Grid) -> str:
    """SQL for the bin of a value; null stays null."""
    inner = "1"
    if grid.width > 0:
        # A range so narrow that its bins have no width is left as one bin.
        place = f"({{value}} - {sql_double(grid.start)}) / {sql_double(grid.width)}"
        inner = f"least(greatest(ceil({place}), 1), {grid.bins})"
    return (
        f"bigint(case when {{value}} = double('inf') then {grid.bins + 1} "
        f"when {{value}} = double('-inf') then 0 "
        f"when {{value}} is not null then {inner} end)"
    )


def histogram_on(df: DataFrame, found: Sequence[Grid], counts: DataFrame | None = None) -> DataFrame:
    """Count rows on known bins: one scan, one row per bin and task shuffled.

    ``counts`` may give ``(id, bin_idx, n)`` of bins that hold rows, ``id`` being the place in ``found``.
    """
    if not found:
        return small_frame(df, [], HISTOGRAM_SCHEMA)
    if counts is None:
        counts = _count_bins(df, found)
    edges = small_frame(
        df,
        [(i, g.name, g.bins, g.low, g.high, g.start, g.width) for i, g in enumerate(found)],
        "id int, column string, bins bigint, low double, high double, start double, width double",
    )
    lower = (
        "case when bin_idx = 0 then double('-inf') when bin_idx > bins then high "
        "else start + (bin_idx - 1) * width end"
    )
    upper = (
        "case when bin_idx = 0 then low when bin_idx > bins then double('inf') "
        "when bin_idx = bins and low < high then high else start + bin_idx * width end"
    )
    return (
        _every_bin(df, [g.bins + 2 for g in found])
        .join(F.broadcast(edges), "id")  # one row per column of the table
        .join(counts, ["id", "bin_idx"], "left")
        .selectExpr(
            "column",
            "bin_idx",
            f"{lower} as lower",
            f"{upper} as upper",
            "coalesce(n, 0) as n",
        )
        .selectExpr(
            "column",
            "bin_idx",
            "lower",
            "upper",
            f"{text.bin_key('lower', 'upper')} as bin_key",
            "n",
        )
    )


def _count_bins(df: DataFrame, found: Sequence[Grid]) -> DataFrame:
    cells = {
        i: Cell({"value": number(g.name, df.schema[g.name].dataType)}, {"bin_idx": bin_sql(g)})
        for i, g in enumerate(found)
    }
    return (
        long_form(df, cells)
        .filter("bin_idx is not null")
        .groupBy("id", "bin_idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _every_bin(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``id, bin_idx`` of all bins of all columns, made by as many tasks as they need."""
    starts = [0, *itertools.accumulate(sizes)]
    listed = F.array(*(F.lit(s).cast("bigint") for s in starts[:-1]))
    place = F.size(F.filter(listed, lambda s: s <= F.col("n"))) - 1
    tasks = max(1, -(-starts[-1] // 1_000_000))
    numbers = df.sparkSession.range(0, starts[-1], 1, tasks).withColumnRenamed("id", "n")
    return numbers.select(
        place.alias("id"), (F.col("n") - F.element_at(listed, place + 1)).alias("bin_idx")
    )


def histogram_categorical(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows per value, as ``value_counts``; by default of the categorical columns."""
    names = categorical_columns(df) if columns is None else list(columns)
    if not names:
        return small_frame(df, [], "column string, value string, n bigint")
    return value_counts(df, names)


def categorical_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with few enough distinct values, in table order."""
    columns = list(df.columns if columns is None else columns)
    kinds = {n: dtypes.semantic_type(df.schema[n].dataType) for n in columns}
    able = (*dtypes.NUMERIC, dtypes.TEXT, dtypes.BOOLEAN)
    names = [n for n in columns if kinds[n] in able]
    if not names:
        return []
    found = {r["column"]: r["cardinality"] for r in cardinality(df, names).collect()}
    return [n for n in names if is_categorical(kinds[n], found[n])]


def histogram_all(
    df: DataFrame, columns: Sequence[str] | None = None, bins: BinRule | None = None
) -> DataFrame:
    """Value counts of categorical columns, bins of the other numeric ones.

    ``key`` is the category or the bin; other columns have no rows.
    """
    columns = list(df.columns if columns is None else columns)
    dtypes.require_columns(df, columns)
    categories = categorical_columns(df, columns)
    numbers = [n for n in dtypes.numeric_columns(df, columns) if n not in categories]
    parts = []
    if categories:
        counts = value_counts(df, categories)
        parts.append(counts.select("column", F.col("value").alias("key"), "n"))
    if numbers:
        binned = histogram_numeric(df, numbers, bins)
        parts.append(binned.select("column", F.col("bin_key").alias("key"), "n"))
    if not parts:
        return small_frame(df, [], "column string, key string, n bigint")
    return union_all(parts)
