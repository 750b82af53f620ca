"""Quantiles of the numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabgauge.functions import dtypes
from tabgauge.functions.frames import Cell, small_frame, sql_text, union_all
from tabgauge.functions.values import number
from tabgauge.operators.order_stats import (
    interpolate,
    linear_ranks,
    order_statistics,
    ranks_for,
    sketched_column,
)
from tabgauge.operators.sketches import SKETCH_SIZE, finished, merged_sketches, sketched

# Names of the quantiles of a numeric profile and their shares.
QUANTILES = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def numeric_quantiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    shares: Mapping[str, float] = QUANTILES,
    approx: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles, one field per name in ``shares``.

    Exact, with a scan for sketches, one that counts, one that selects, and two more for each further
    factor of some hundred beyond ten million rows, one of which sketches only values near the ranks; no column is sorted. ``approx=True``
    takes the scan for sketches alone: each result is a value of the column, whose rank is off by less than
    ``rank_error(SKETCH_SIZE)`` of the rows in 99 of 100 cases.
    """
    names = dtypes.numeric_columns(df, columns)
    schema = ", ".join(["column string"] + [f"`{k}` double" for k in shares])
    if not names:
        return small_frame(df, [], schema)
    cells = [Cell({"v": number(n, df.schema[n].dataType)}, {"value": "{v}"}) for n in names]
    if approx:
        parts = []
        for places, whole in merged_sketches(df, cells, SKETCH_SIZE):
            rows = []
            for i, place in enumerate(places):
                at = f"({finished(f'k{i}', list(shares.values()))})"
                fields = "".join(f", '{key}', {at}[{j}]" for j, key in enumerate(shares))
                rows.append(f"named_struct('column', {sql_text(names[place])}{fields})")
            parts.append(whole.selectExpr(f"inline(array({', '.join(rows)}))"))
        return union_all(parts)
    sketches = dict(zip(names, sketched(df, cells), strict=True))
    valid = {n: s.n for n, s in sketches.items()}
    ranks = ranks_for(valid, shares.values())
    found = order_statistics(df, [sketched_column(n, sketches[n], ranks[n]) for n in names if valid[n]])
    rows = []
    for name in names:
        row: list[str | float | None] = [name]
        for share in shares.values():
            if not valid[name]:
                row.append(None)
                continue
            low, high, weight = linear_ranks(valid[name], share)
            row.append(interpolate(found[name, low], found[name, high], weight))
        rows.append(tuple(row))
    return small_frame(df, rows, schema)
