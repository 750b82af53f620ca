"""Mergeable states of columns: all that a profile needs, from one scan.

A state holds counts, ranges, central moments, text lengths, and three sketches: KLL for
quantiles, HyperLogLog for distinct values and frequent items for categories. Any two states
of a column merge into one of the same size, so states of tasks, files or earlier
runs can be put together in levels, in any order.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.frames import Cell, sql_double, sql_text
from tabgauge.functions.tasks import by_task, in_levels
from tabgauge.functions.values import column, epoch, number, ordinal
from tabgauge.operators.sketches import CUTS, finished, rank_error
from tabgauge.operators.values import DIGEST_ABOVE_BYTES, value_key

#: Sizes of the sketches of a state, some 25 KB a column in all.
STATE_SKETCH = 1024
STATE_HLL = 12
#: Frequent items tracked per column; with fewer distinct values their counts are exact.
TRACKED = 384
#: Size of what one aggregate takes: three for a text, two for any other column; more columns take further ones, each over
#: its own columns. Spark puts their inputs into one method with the scan, and the JVM compiles none above 8,000 bytes.
SIZE_PER_AGGREGATE = 40

#: Published bounds: standard error of the distinct values, share of the rows that a rank and a category's count are off.
DISTINCT_ERROR = 1.04 / 2 ** (STATE_HLL / 2)
RANK_ERROR = rank_error(STATE_SKETCH) + 1 / CUTS
COUNT_ERROR = 3.5 / 512

#: Rows looked at for a centre and a unit of each column, around which powers are added up.
PEEKED_ROWS = 1000

# Fields that add up, that keep the least and that keep the largest.
_SUMS = ("row_count", "missing_count", "null_count", "inf_count", "above_count", "valid")
_LEAST = ("min", "low", "time_min", "first_epoch")
_MOST = ("max", "high", "time_max", "last_epoch")


def item_text(name: str, dtype) -> str:
    """SQL for a value as it is tracked: its text, a digest for long texts."""
    value = f"cast({column(name)} as string)"
    if dtypes.semantic_type(dtype) != dtypes.TEXT:
        return value
    return f"if(octet_length({value}) > {DIGEST_ABOVE_BYTES}, concat('sha256:', sha2({value}, 256)), {value})"


#: From sums of powers around the centre to those around the mean.
_POWERS = {
    "mean": "centre + unit * s1 / valid",
    "m2": "greatest(s2 - s1 * s1 / valid, 0) * pow(unit, 2)",
    "m3": "(s3 - 3 * s1 * s2 / valid + 2 * pow(s1, 3) / pow(valid, 2)) * pow(unit, 3)",
    "m4": "(s4 - 4 * s1 * s3 / valid + 6 * s1 * s1 * s2 / pow(valid, 2) - 3 * pow(s1, 4) / pow(valid, 3)) * pow(unit, 4)",
}


def _inputs(df: DataFrame, name: str) -> dict[str, str]:
    """SQL for what the state of a column is made from; each of them only for types that have it.

    ``x`` is a number, the ordinal of a time or the length of a text, ``e`` a whole number or the ticks of a time.
    """
    dtype = df.schema[name].dataType
    kind = dtypes.semantic_type(dtype)
    raw = column(name)
    inputs = {"key": f"if({raw} is null, null, xxhash64({raw if kind == dtypes.TEXT else value_key(name, dtype)}))"}
    if kind in dtypes.TEMPORAL:
        inputs |= {"e": epoch(name, dtype), "x": ordinal(name, dtype)}
        if kind == dtypes.TIME:
            inputs["t"] = f"cast({raw} as string)"
    if kind in dtypes.NUMERIC:
        inputs["x"] = number(name, dtype)
    if kind == dtypes.INTEGER:
        inputs["e"] = f"cast({raw} as bigint)"
    if kind == dtypes.TEXT:
        inputs["x"] = f"double(char_length({raw}))"
    if kind not in (*dtypes.TEMPORAL, dtypes.UNKNOWN):
        inputs["item"] = item_text(name, dtype)
    return inputs


def _cell(df: DataFrame, name: str, centre: tuple[float, float] | None) -> Cell:
    """What the state of a column is made from, and aggregates over it; what its type cannot hold costs nothing."""
    inputs = _inputs(df, name)
    x, item = "{x}" if "x" in inputs else "double(null)", "{item}" if "item" in inputs else "cast(null as string)"
    present = "count({key})"
    fields = {
        "row_count": "count(1)",
        "missing_count": f"count(1) - {present}",
        "null_count": f"count(1) - {present}",
        "inf_count": "0",
        "above_count": "0",
        "valid": present if "x" in inputs else "0",
        "hll": f"hll_sketch_agg({{key}}, {STATE_HLL})",
        "kll": f"kll_sketch_agg_double({x}, {STATE_SKETCH})",
        "top": f"approx_top_k_accumulate({item}, {TRACKED})",
    }
    if "x" in inputs:
        fields |= dict.fromkeys(("min", "low"), "min({x})") | dict.fromkeys(("max", "high"), "max({x})")
    if dtypes.has_nan(df.schema[name].dataType):
        infinite = "abs({x}) = double('inf')"
        fields |= {
            "missing_count": "count(1) - count({x})",
            "inf_count": f"count_if({infinite})",
            "above_count": "count_if({x} = double('inf'))",
            "valid": "count({x})",
            "low": f"min(if({infinite}, null, {{x}}))",
            "high": f"max(if({infinite}, null, {{x}}))",
        }
    if centre:
        # Distance from the centre in units of the column; Spark works it out once a row.
        d = f"(({{x}} - {sql_double(centre[0])}) * {sql_double(1 / centre[1])})"
        fields |= {f"s{power}": f"sum({' * '.join([d] * power)})" for power in range(1, 5)}
    if "t" in inputs:
        fields |= {"time_min": "min({t})", "time_max": "max({t})"}
    if "e" in inputs:
        fields |= {"first_epoch": "min({e})", "last_epoch": "max({e})"}
    return Cell(inputs, fields)


def _centres(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """A value within each column and a unit for distances from it, from its first rows.

    They only keep sums of powers from cancelling or overflowing; results do not depend on them.
    """
    numbers = {n: sql for n in columns if "x" in (own := _inputs(df, n)) and "t" not in own and (sql := own["x"])}
    if not numbers:
        return {}
    finite = [f"if(abs({sql}) < double('inf'), {sql}, null) as c{i}" for i, sql in enumerate(numbers.values())]
    rows = df.limit(PEEKED_ROWS).selectExpr(*finite).toPandas()
    out = {}
    for i, name in enumerate(numbers):
        seen = rows[f"c{i}"].dropna().to_numpy(dtype=float)
        centre = float(seen[len(seen) // 2]) if len(seen) else 0.0
        reach = float(abs(seen / 2 - centre / 2).max() * 2) if len(seen) else 1.0
        out[name] = (centre, 2.0 ** (math.frexp(reach)[1] - 1) if 0 < reach < 1e300 else 1.0)
    return out


# Fields of a state and their types.
STATE_KINDS = {
    **dict.fromkeys(_SUMS, "bigint"),
    **dict.fromkeys(("min", "max", "low", "high", "mean", "m2", "m3", "m4"), "double"),
    **dict.fromkeys(("time_min", "time_max"), "string"),
    **dict.fromkeys(("first_epoch", "last_epoch"), "bigint"),
    "hll": "binary",
    "kll": "binary",
    "top": "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>",
}


# Fields of a state as it is made, before its powers are those around the mean.
_MADE_KINDS = {
    "column": "string",
    **dict.fromkeys(("centre", "unit", "s1", "s2", "s3", "s4"), "double"),
    **{key: kind for key, kind in STATE_KINDS.items() if key not in _POWERS},
}


def _batches(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """The columns in runs that one aggregate takes."""
    batches, size = [], SIZE_PER_AGGREGATE
    for name in columns:
        own = 3 if dtypes.semantic_type(df.schema[name].dataType) == dtypes.TEXT else 2
        if size + own > SIZE_PER_AGGREGATE:
            batches.append([])
            size = 0
        batches[-1].append(name)
        size += own
    return batches


def states_by(df: DataFrame, columns: Sequence[str], part: str) -> list[DataFrame]:
    """States ``(part, column, ...)`` of the rows with equal ``part``; one scan per some 20 columns, of these alone.

    A row of the table passes the aggregate as it is, each column with the functions that its type needs.
    Only the finished states are turned to a row per column.
    """
    frames, centres = [], _centres(df, columns)
    for names in _batches(df, columns):
        inputs, made, rows = [], [], []
        for i, name in enumerate(names):
            cell = _cell(df, name, centres.get(name))
            centre, unit = centres.get(name, (0.0, 1.0))
            places = {key: f"c{i}_{key}" for key in cell.inputs}
            inputs += [f"{sql} as {places[key]}" for key, sql in cell.inputs.items()]
            made += [F.expr(sql.format(**places)).alias(f"s{i}_{key}") for key, sql in cell.fields.items()]
            values = {key: f"s{i}_{key}" for key in cell.fields}
            values |= {"column": sql_text(name), "centre": sql_double(centre), "unit": sql_double(unit)}
            rows.append(", ".join(f"cast({values.get(key, 'null')} as {kind})" for key, kind in _MADE_KINDS.items()))
        whole = df.selectExpr(f"{part} as part", *inputs).groupBy("part").agg(*made)
        by_column = whole.selectExpr("part", f"stack({len(names)}, {', '.join(rows)}) as ({', '.join(_MADE_KINDS)})")
        frames.append(
            by_column.selectExpr(
                "part", "column", *(f"cast({_POWERS.get(key, key)} as {kind}) as {key}" for key, kind in STATE_KINDS.items())
            )
        )
    return frames


def _fold(parts: str, term: str) -> str:
    return f"aggregate({parts}, 0D, (total, p) -> total + {term})"


def merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per value of the keys. Moments follow from those of the parts around the common mean."""
    made = [F.sum(c).alias(c) for c in _SUMS]
    made += [F.min(c).alias(c) for c in _LEAST] + [F.max(c).alias(c) for c in _MOST]
    made += [
        F.expr("hll_union_agg(hll, false)").alias("hll"),
        F.expr(f"kll_merge_agg_double(kll, {STATE_SKETCH})").alias("kll"),
        F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"),
        F.expr("collect_list(struct(valid as n, mean, m2, m3, m4)) filter (where valid > 0 and mean is not null)").alias("moments"),
    ]
    found = states.groupBy(*keys).agg(*made)
    plain = [*keys, *_SUMS, *_LEAST, *_MOST, "hll", "kll", "top"]
    # An infinity makes means and moments infinite or NaN; what is left then is not used.
    centred = found.selectExpr(
        *plain,
        "moments",
        f"if(size(moments) > 0, {_fold('moments', 'p.mean * (p.n / valid)')}, null) as mean",
    )
    d = "(p.mean - mean)"
    return centred.selectExpr(
        *plain,
        "mean",
        f"{_fold('moments', f'p.m2 + p.n * {d} * {d}')} as m2",
        f"{_fold('moments', f'coalesce(p.m3, 0) + 3 * {d} * p.m2 + p.n * pow({d}, 3)')} as m3",
        f"{_fold('moments', f'coalesce(p.m4, 0) + 4 * {d} * coalesce(p.m3, 0) + 6 * {d} * {d} * p.m2 + p.n * pow({d}, 4)')} as m4",
    )


def whole_states(parts: Sequence[DataFrame], groups: int) -> list[DataFrame]:
    """One state per column, merged in levels from ``part`` 0 to ``groups - 1``."""

    def merge(frame: DataFrame, keys: list[str]) -> DataFrame:
        return merged(frame, keys)

    return [in_levels(frame, groups, ["column"], merge) for frame in parts]


def table_states(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """One state per column of a table. Tasks are merged in groups, groups in levels."""
    grouped, groups = by_task(df.select(*(df[column(n)] for n in columns)))
    return whole_states(states_by(grouped, columns, "part"), groups)


@dataclass(frozen=True)
class Estimate:
    """What a state says about a column. ``cuts`` are values at even steps of the ranks."""

    state: Mapping[str, object]
    distinct: int
    cuts: tuple[float, ...]
    items: tuple[tuple[str | None, int], ...]

    def __getitem__(self, field: str):
        return self.state[field]

    @property
    def valid(self) -> int:
        return self.state["valid"] or 0

    def quantile(self, share: float) -> float | None:
        """A value of the column whose rank is about the share."""
        return self.cuts[round(share * CUTS)] if self.cuts else None

    def upto(self, value: float) -> float:
        """Share of the values that are at most ``value``, between two cuts by the straight line."""
        if not self.cuts or value < self.cuts[0]:
            return 0.0
        at = bisect.bisect_right(self.cuts, value)
        if at > CUTS:
            return 1.0
        low, high = self.cuts[at - 1], self.cuts[at]
        inside = (value - low) / (high - low) if low < value < high and high - low < float("inf") else 0.0
        return (at - 1 + inside) / CUTS


def estimates(states: Sequence[DataFrame], columns: Sequence[str]) -> dict[str, Estimate]:
    """States as plain values: a bounded number per column comes to the driver. A table without rows has none."""
    shares = [i / CUTS for i in range(CUTS + 1)]
    plain = [c for c in STATE_KINDS if c not in ("hll", "kll", "top")]
    out = {name: Estimate({c: 0 if c in _SUMS else None for c in plain}, 0, (), ()) for name in columns}
    for frame in states:
        rows = frame.selectExpr(
            "column",
            *plain,
            "hll_sketch_estimate(hll) + int(null_count > 0) as distinct_estimate",
            f"{finished('kll', shares)} as cuts",
            f"approx_top_k_estimate(top, {TRACKED}) as items",
        ).collect()
        for r in rows:
            state = {c: r[c] for c in plain}
            items = tuple(sorted(((i["item"], i["count"]) for i in r["items"]), key=lambda x: (-x[1], x[0] is not None, x[0] or "")))
            out[r["column"]] = Estimate(state, r["distinct_estimate"], tuple(r["cuts"] or ()), items)
    return out
