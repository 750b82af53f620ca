"""What the driver learns about a table: a bounded number of values per column.

Every property is one pass over the whole table, run when first asked for.
Later passes take the results of earlier ones as constants, which keeps the
heavy scans free of joins and inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import dtypes
from tabgauge.functions.frames import sql_double, union_all
from tabgauge.operators.order_stats import (
    Bracket,
    bin_count,
    bin_factor,
    interpolate,
    linear_ranks,
    nearest_rank,
    order_statistics,
    pick,
    quantile_ranks,
    whole_column,
)
from tabgauge.operators.quality import temporal_range
from tabgauge.operators.quantiles import QUANTILES
from tabgauge.operators.stats import basic_summary, moments_around
from tabgauge.operators.types import resolve_type
from tabgauge.operators.values import distinct_values


QUARTILES = (0.25, 0.75)


@dataclass(frozen=True)
class Distinct:
    """Distinct values of a column and the count of the most frequent one."""

    cardinality: int
    top_count: int


class Facts:
    """Per-column facts of some columns of a table."""

    def __init__(
        self,
        df: DataFrame,
        columns: Sequence[str],
        declared: Mapping[str, str] | None = None,
    ) -> None:
        dtypes.require_columns(df, columns)
        dtypes.require_columns(df, declared or ())
        self.df = df
        self.columns = list(columns)
        self.kinds = {name: resolve_type(df, name, declared) for name in self.columns}
        # Columns that each pass covers; a profile of some sections needs fewer.
        self.summarised = list(self.columns)
        self.counted = list(self.columns)
        self._brackets: list[Bracket] | None = None

    def of(self, *kinds: str) -> list[str]:
        """Columns of the given types."""
        return [name for name in self.columns if self.kinds[name] in kinds]

    @property
    def numeric(self) -> list[str]:
        return self.of(*dtypes.NUMERIC)

    @property
    def temporal(self) -> list[str]:
        return self.of(*dtypes.TEMPORAL)

    @cached_property
    def basics(self) -> dict[str, Row]:
        """One scan: counts, ranges, means and text lengths."""
        found = basic_summary(self.df, self.summarised).collect()
        return {row["column"]: row for row in found}

    @cached_property
    def row_count(self) -> int:
        if not self.summarised:
            return self.df.count()
        return self.basics[self.summarised[0]]["row_count"]

    def valid(self, name: str) -> int:
        """Rows with a value that is not missing."""
        return self.basics[name]["row_count"] - self.basics[name]["missing_count"]

    def _whole(self, name: str) -> Bracket | None:
        if name not in self.basics or name not in (*self.numeric, *self.temporal):
            return None
        valid = self.valid(name)
        if not valid:
            return None
        if name in self.temporal:
            low, high = temporal_range(self.df, name, self.basics[name])
            return whole_column(
                name, low, high, valid, quantile_ranks(valid, QUARTILES, nearest=True)
            )
        low, high = self.basics[name]["min"], self.basics[name]["max"]
        # Interpolated quantiles, and the nearest values for the bin rule.
        ranks = quantile_ranks(valid, QUANTILES.values())
        ranks |= quantile_ranks(valid, QUARTILES, nearest=True)
        return whole_column(name, low, high, valid, ranks)

    @cached_property
    def distinct(self) -> dict[str, Distinct]:
        """One shuffle of the distinct values of all columns.

        The same pass counts values per equal-width bin, which is the first
        round of the search for quantiles.
        """
        whole = {i: self._whole(name) for i, name in enumerate(self.counted)}
        bins = bin_count(max(1, len(self.counted)))
        parts = []
        for family, values in distinct_values(self.df, self.counted) if self.counted else ():
            place, index = self._bins(family, whole, bins)
            parts.append(
                values.selectExpr("id", "n", f"{place} as place")
                .selectExpr("id", "n", "place", f"{index} as bin")
                .groupBy("id", "bin")
                .agg(
                    F.count(F.lit(1)).alias("distinct"),
                    F.sum("n").alias("rows"),
                    F.max("n").alias("top"),
                    F.min("place").alias("low"),
                    F.max("place").alias("high"),
                )
            )
        groups: dict[int, list[Row]] = {i: [] for i in whole}
        # Bins, not values: at most bin_count() rows for each column.
        for row in union_all(parts).collect() if parts else []:
            groups[row["id"]].append(row)
        rest = [n for n in self.columns if n not in self.counted]
        self._brackets = [b for b in map(self._whole, rest) if b]
        for i, bracket in whole.items():
            binned = [
                (r["bin"], r["rows"], r["low"], r["high"])
                for r in groups[i]
                if r["bin"] is not None
            ]
            if bracket and binned:
                self._brackets += pick(bracket, binned)
            elif bracket:
                self._brackets.append(bracket)
        return {
            name: Distinct(
                sum(r["distinct"] for r in groups[i]),
                max((r["top"] for r in groups[i]), default=0),
            )
            for i, name in enumerate(self.counted)
        }

    def _bins(
        self, family: str, whole: Mapping[int, Bracket | None], bins: int
    ) -> tuple[str, str]:
        """SQL for the ordinal and the bin of a distinct value, null without bins."""
        if family == "string":
            return "double(null)", "int(null)"
        lows, factors, ticks = [], [], []
        for i, name in enumerate(self.counted):
            bracket = whole[i]
            factor = bin_factor(bracket.low, bracket.high, bins) if bracket else None
            if bracket and bracket.single:
                factor = 0.0
            lows.append(sql_double(bracket.low if bracket else None))
            factors.append(sql_double(factor))
            stamp = isinstance(
                self.df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)
            )
            ticks.append("1000L" if stamp else "1L")
        if family == "double":
            place = "if(isnan(value), null, value)"
        else:
            tick = f"array({', '.join(ticks)})[id]"
            place = f"double((value - pmod(value, {tick})) / {tick})"
        low, factor = f"array({', '.join(lows)})[id]", f"array({', '.join(factors)})[id]"
        offset = f"((place - {low}) * {factor})"
        # least() skips nulls, so values without a bin are kept out of it.
        inner = f"least(int(floor({offset})), {bins - 1})"
        return place, f"if({offset} is null, null, {inner})"

    @cached_property
    def order(self) -> dict[tuple[str, int], float]:
        """Values at the ranks that the quantiles need."""
        brackets = self._brackets
        if brackets is None:
            brackets = [b for b in map(self._whole, self.columns) if b]
        return order_statistics(self.df, brackets)

    def quantile(self, name: str, share: float) -> float | None:
        """Linearly interpolated quantile of a numeric column."""
        if not self.valid(name):
            return None
        low, high, weight = linear_ranks(self.valid(name), share)
        return interpolate(self.order[name, low], self.order[name, high], weight)

    def nearest_quartiles(self, names: Sequence[str]) -> dict[str, tuple[float, float]]:
        """Quartiles that are values of the column."""
        return {
            n: tuple(self.order[n, nearest_rank(self.valid(n), q)] for q in QUARTILES)
            for n in names
            if self.valid(n)
        }

    @cached_property
    def moments(self) -> dict[str, Row]:
        """One scan: deviation, skewness and kurtosis around the known means."""
        found = moments_around(self.df, self.basics, self.numeric).collect()
        return {row["column"]: row for row in found}
