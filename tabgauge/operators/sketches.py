"""Quantile sketches of columns, made in one scan and merged in levels.

A task keeps a KLL sketch per column and hands over one row. Groups of ``FAN`` tasks are
merged first, then groups of groups, so no merge grows with the number of tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.frames import Cell, sql_double
from tabgauge.functions.tasks import by_task, in_levels

#: Size parameter of a sketch: ranks are off by less than ``rank_error(SKETCH_SIZE)`` in 99 of 100 cases.
SKETCH_SIZE = 4096
#: Steps of the distribution that a finished sketch hands to the driver.
CUTS = 1024
#: Sketches per aggregate; further ones take an aggregate of their own, which reads only their columns.
SKETCHES_PER_AGGREGATE = 64


def rank_error(size: int) -> float:
    """Published bound of a KLL sketch on the share of rows that a rank is off, at 99 % confidence."""
    return 2.296 / size**0.9723


@dataclass(frozen=True)
class Sketch:
    """Number of values, and values at ``CUTS + 1`` even steps from the smallest to the largest."""

    n: int
    cuts: tuple[float, ...]
    counts: Mapping[str, int]


def finished(sketch: str, shares: Sequence[float]) -> str:
    """SQL for values of a sketch at constant shares; null if it holds none."""
    wanted = ", ".join(map(sql_double, shares))
    return (
        f"case when kll_sketch_get_n_double({sketch}) > 0 "
        f"then kll_sketch_get_quantile_double({sketch}, array({wanted})) end"
    )


def merged_sketches(df: DataFrame, cells: Sequence[Cell], size: int) -> list[tuple[range, DataFrame]]:
    """Per batch of cells a frame of one row: sketch ``k0, k1, ...`` of each cell's ``value`` and sums of its other fields."""
    batches = []
    for start in range(0, len(cells), SKETCHES_PER_AGGREGATE):
        batch = dict(enumerate(cells[start : start + SKETCHES_PER_AGGREGATE]))
        inputs = [f"{sql} as c{i}_{key}" for i, cell in batch.items() for key, sql in cell.inputs.items()]
        grouped, groups = by_task(df.selectExpr(*inputs))
        made, again = [], []
        for i, cell in batch.items():
            names = {key: f"c{i}_{key}" for key in cell.inputs}
            made.append(F.expr(f"kll_sketch_agg_double({cell.fields['value'].format(**names)}, {size})").alias(f"k{i}"))
            again.append(F.expr(f"kll_merge_agg_double(k{i}, {size})").alias(f"k{i}"))
            for key, sql in cell.fields.items():
                if key != "value":
                    made.append(F.expr(sql.format(**names)).alias(f"k{i}_{key}"))
                    again.append(F.sum(f"k{i}_{key}").alias(f"k{i}_{key}"))
        states = grouped.groupBy("part").agg(*made)
        whole = in_levels(states, groups, (), lambda frame, keys, again=again: frame.groupBy(*keys).agg(*again))
        # One row also for a table without tasks.
        batches.append((range(start, start + len(batch)), whole.agg(*(F.first(c).alias(c) for c in whole.columns if c != "part"))))
    return batches


def sketched(df: DataFrame, cells: Sequence[Cell], size: int = SKETCH_SIZE) -> list[Sketch]:
    """Sketch of each cell's field ``value``, and sums of its other fields, in one scan."""
    shares = [i / CUTS for i in range(CUTS + 1)]
    out = []
    for places, whole in merged_sketches(df, cells, size):
        structs = []
        for i, place in enumerate(places):
            sums = [f"'{key}', k{i}_{key}" for key in cells[place].fields if key != "value"]
            counts = f"map({', '.join(sums)})" if sums else "map()"
            structs.append(f"named_struct('n', kll_sketch_get_n_double(k{i}), 'cuts', {finished(f'k{i}', shares)}, 'counts', cast({counts} as map<string, bigint>))")
        found = whole.selectExpr(f"array({', '.join(structs)}) as found").first()["found"]
        out += [Sketch(r["n"] or 0, tuple(r["cuts"] or ()), {k: v or 0 for k, v in r["counts"].items()}) for r in found]
    return out


def sketched_rows(rows: DataFrame, count: int, size: int = SKETCH_SIZE) -> list[Sketch]:
    """Sketch of the ``value`` of each ``id`` from 0 to ``count - 1`` in the rows ``(id, value)``, in one scan."""
    shares = [i / CUTS for i in range(CUTS + 1)]
    grouped, groups = by_task(rows)

    def merge(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys).agg(F.expr(f"kll_merge_agg_double(k, {size})").alias("k"))

    states = grouped.groupBy("part", "id").agg(F.expr(f"kll_sketch_agg_double(value, {size})").alias("k"))
    whole = in_levels(states, groups, ["id"], merge).selectExpr("id", "kll_sketch_get_n_double(k) as n", f"{finished('k', shares)} as cuts")
    found = {r["id"]: Sketch(r["n"], tuple(r["cuts"] or ()), {}) for r in whole.collect()}
    return [found.get(i, Sketch(0, (), {})) for i in range(count)]
