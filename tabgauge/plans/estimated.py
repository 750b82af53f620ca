"""A profile from mergeable states: one scan of a table, or none where its states are kept.

Counts, ranges, means, moments, text lengths and times are exact. Distinct values, quantiles,
histogram counts, outliers and counts of categories beyond ``TRACKED`` distinct values are
estimates within the bounds in ``operators.states``.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabgauge.functions import dtypes, text
from tabgauge.functions.frames import small_frame, sql_text, union_all
from tabgauge.functions.values import MICROS_PER_SECOND
from tabgauge.operators.histogram import HISTOGRAM_SCHEMA, BinRule, Grid, grids, histogram_on
from tabgauge.operators.quality import DOMINANT_SHARE, FENCE_WIDTH
from tabgauge.operators.quantiles import QUANTILES
from tabgauge.operators.states import Estimate
from tabgauge.operators.types import is_categorical
from tabgauge.operators.values import TOP_CATEGORIES

CATEGORY_SCHEMA = (
    "column string, value string, n bigint, rank int, categories bigint, remaining bigint"
)


def add_estimates(
    df: DataFrame,
    records: Mapping[str, dict],
    found: Mapping[str, Estimate],
    sections: Collection[str],
    zscore: float,
    variance: float,
    given: Mapping[str, tuple[float | None, float | None]],
) -> list[str]:
    """Fill the records of a profile; returns the categorical columns."""
    categorical = []
    for name, record in records.items():
        e, kind = found[name], record["type"]
        rows = e["row_count"] or 0
        record["row_count"] = rows
        if sections & {"types", "histogram"}:
            record |= {
                "is_categorical": is_categorical(kind, e.distinct),
                "cardinality": e.distinct,
                "unique_rate": min(1.0, e.distinct / rows) if rows else 0.0,
            }
            if record["is_categorical"]:
                categorical.append(name)
        if "missing" in sections:
            record |= {
                "missing_count": e["missing_count"],
                "missing_rate": e["missing_count"] / rows if rows else None,
                "inf_count": e["inf_count"],
            }
        if "numeric" in sections and kind in dtypes.NUMERIC:
            record |= {"min": e["min"], "max": e["max"], "mean": e["mean"]} | _moments(e)
            if e["first_epoch"] is not None:  # whole numbers
                record |= {"min_exact": str(e["first_epoch"]), "max_exact": str(e["last_epoch"])}
            record |= {field: e.quantile(share) for field, share in QUANTILES.items()}
        if "text" in sections and e.valid and dtypes.semantic_type(df.schema[name].dataType) == dtypes.TEXT:
            record |= {
                "char_length_min": int(e["min"]),
                "char_length_max": int(e["max"]),
                "char_length_mean": e["mean"],
                "char_length_std": _moments(e)["std"],
            }
        if "quality" in sections:
            record |= _quality(e, kind, zscore, variance, given.get(name, (None, None)))
    return categorical


def _moments(e: Estimate) -> dict[str, float | None]:
    n, m2 = e.valid, e["m2"]
    if n < 2:
        return {"std": None, "skewness": None, "kurtosis": None}
    if e["inf_count"]:
        return dict.fromkeys(("std", "skewness", "kurtosis"), math.nan)
    if e["min"] == e["max"] or not m2:
        return {"std": 0.0, "skewness": None, "kurtosis": None}
    return {
        "std": math.sqrt(m2 / (n - 1)),
        "skewness": e["m3"] / n / (m2 / n) ** 1.5,
        "kurtosis": e["m4"] / n / (m2 / n) ** 2 - 3,
    }


def _quality(
    e: Estimate, kind: str, zscore: float, variance: float, given: tuple[float | None, float | None]
) -> dict:
    rows, outliers, low = e["row_count"] or 0, 0, True
    if kind == dtypes.UNKNOWN:
        return {}
    if kind in dtypes.NUMERIC and e.valid:
        mean, std = given
        std = _moments(e)["std"] if std is None else std
        mean = e["mean"] if mean is None else mean
        if std is None:
            return {}  # a single value has no deviation
        if math.isnan(std):
            low, outliers = False, e.valid + e["missing_count"] - e["null_count"]
        else:
            low = std * std < variance
            inside = e.upto(mean + zscore * std) - e.upto(math.nextafter(mean - zscore * std, -math.inf))
            outliers = round((1 - inside) * e.valid) if std else 0
            outliers += e["missing_count"] - e["null_count"]  # NaN is an outlier
    elif kind in dtypes.TEMPORAL and e.valid:
        low = not e["missing_count"] and e["first_epoch"] == e["last_epoch"]
        q1, q3 = e.quantile(0.25), e.quantile(0.75)
        reach = FENCE_WIDTH * (q3 - q1)
        inside = e.upto(q3 + reach) - e.upto(math.nextafter(q1 - reach, -math.inf))
        outliers = round((1 - inside) * e.valid)
    elif rows and e["missing_count"] < rows:
        low = e.items[0][1] / rows > DOMINANT_SHARE
    return {"outlier_count": outliers, "outlier_rate": outliers / rows if rows else 0.0, "has_low_variation": low}


def add_times(df: DataFrame, records: Mapping[str, dict], found: Mapping[str, Estimate]) -> None:
    """First and last time as text, and the span. Times of all columns are written by one small query."""
    times = {n for n in records if dtypes.semantic_type(df.schema[n].dataType) in dtypes.TEMPORAL}
    names = [n for n in records if n in times and found[n]["first_epoch"] is not None]
    if not names:
        return
    shown = []
    for name in names:
        dtype, e = df.schema[name].dataType, found[name]
        for end, field in (("first_epoch", "time_min"), ("last_epoch", "time_max")):
            if dtypes.semantic_type(dtype) == dtypes.TIME:
                value = f"cast({sql_text(e[field])} as {dtype.simpleString()})"
            elif dtypes.semantic_type(dtype) == dtypes.DATE:
                value = f"date_from_unix_date({e[end]})"
            elif isinstance(dtype, T.TimestampNTZType):
                value = f"timestampadd(MICROSECOND, {e[end]}, timestamp_ntz'1970-01-01 00:00:00')"
            else:
                value = f"timestamp_micros({e[end]})"
            shown.append(text.temporal_text(value, dtype))
    row = df.sparkSession.sql(f"select array({', '.join(shown)}) as shown").first()["shown"]
    for i, name in enumerate(names):
        e, kind = found[name], dtypes.semantic_type(df.schema[name].dataType)
        ticks = e["last_epoch"] - e["first_epoch"]
        if kind == dtypes.DATE:
            ticks *= text.SECONDS_PER_DAY
        elif kind == dtypes.DATETIME:
            ticks //= MICROS_PER_SECOND
        records[name] |= {"temporal_min": row[2 * i], "temporal_max": row[2 * i + 1], "temporal_diff_seconds": ticks}


def categories_of(df: DataFrame, names: Collection[str], found: Mapping[str, Estimate]) -> DataFrame:
    """The most frequent categories of the columns, as ``top_categories`` lists them."""
    parts = []
    for name in names:
        dtype, e = df.schema[name].dataType, found[name]
        kind = dtype.simpleString() if dtypes.semantic_type(dtype) != dtypes.UNKNOWN else "string"
        left = e.distinct - TOP_CATEGORIES if e.distinct >= TOP_CATEGORIES else None
        rows = [(name, item, n, i + 1, e.distinct, left) for i, (item, n) in enumerate(e.items[:TOP_CATEGORIES])]
        raw = small_frame(df, rows, "column string, item string, n bigint, rank int, categories bigint, remaining bigint")
        parts.append(
            raw.selectExpr("column", f"{text.value_text(f'cast(item as {kind})', dtype)} as value", "n", "rank", "categories", "remaining")
        )
    return union_all(parts) if parts else small_frame(df, [], CATEGORY_SCHEMA)


def histogram_of(
    df: DataFrame, names: Collection[str], found: Mapping[str, Estimate], rule: BinRule | None
) -> DataFrame:
    """Bins of the columns with counts read off the ranks of their edges."""
    if not names:
        return small_frame(df, [], HISTOGRAM_SCHEMA)
    ranges = {n: (found[n]["low"], found[n]["high"]) for n in names if found[n]["low"] is not None}
    quartiles = {n: (found[n].quantile(0.25), found[n].quantile(0.75)) for n in ranges}
    on = grids(df, list(ranges), {n: found[n].state for n in ranges}, rule, quartiles, ranges)
    rows = [(i, b, n) for i, g in enumerate(on) for b, n in _counts(g, found[g.name])]
    return histogram_on(df, on, small_frame(df, rows, "id int, bin_idx bigint, n bigint"))


def _counts(grid: Grid, e: Estimate) -> list[tuple[int, int]]:
    """Rows per bin; all finite values fall into the inner bins, and every rounding goes to a neighbour."""
    below = e["inf_count"] - (e["above_count"] or 0)
    finite = e.valid - e["inf_count"]
    edges = [min(grid.start + b * grid.width, grid.high) for b in range(1, grid.bins)]
    upto = [min(max(round(e.upto(x) * e.valid) - below, 0), finite) for x in edges] + [finite]
    rows = [(b + 1, n - (upto[b - 1] if b else 0)) for b, n in enumerate(upto)]
    return [(0, below), *rows, (grid.bins + 1, e["above_count"] or 0)]
