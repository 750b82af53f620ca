"""Exact order statistics of many columns without sorting any of them.

A bracket is a closed range of values known to hold some wanted ranks. Quantile sketches,
merged in levels over the tasks, tell where the ranks lie within a large bracket; one scan
covers all brackets of all columns. The rows below, at and inside the ranges are then counted by plain
sums. If what is left around a rank is still too large, the next scan sketches the values inside, and
them alone, which thins it out some hundred times whatever the distribution; the last
scan groups the values inside small ranges. All results rest on exact counts; the sketches only
choose the ranges, and a rank outside its range is looked for again. The driver sees a
bounded number of values per wanted rank, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.frames import Cell, long_form, one_row_per_column, small_frame, sql_double
from tabgauge.functions.values import ordinal
from tabgauge.operators.sketches import CUTS, SKETCH_SIZE, Sketch, rank_error
from tabgauge.operators.sketches import sketched_rows as sketched

BINS = 2048
MAX_COUNTS = 1 << 18  # bin counts that one round hands to the driver at most
SORT_ROWS = 50_000  # distinct values of a bracket that one task may sort
#: Share of the rows on both sides of a wanted rank that its range takes in.
MARGIN = 3 * rank_error(SKETCH_SIZE)


@dataclass(frozen=True)
class Bracket:
    """Rows of a column with ``low <= value <= high``; ``below`` rows precede, None if not counted yet.

    ``cuts`` are values at even steps of its rows, from a sketch, and ``wide`` tells how often
    the margin was doubled.
    """

    name: str
    low: float
    high: float
    below: int | None
    rows: int
    ranks: tuple[int, ...]
    cuts: tuple[float, ...] = ()
    wide: int = 0

    @property
    def single(self) -> bool:
        return self.low == self.high and self.below is not None


def bin_count(groups: int) -> int:
    """Bins per group so that the counts of one round stay few."""
    return max(16, min(BINS, MAX_COUNTS // max(1, groups)))


def bin_factor(low: float, high: float, bins: int) -> float | None:
    """Bins per unit of value; none where equal widths cannot be formed."""
    width = high - low
    if not 0.0 < width < math.inf:
        return None
    factor = bins / width
    return factor if math.isfinite(factor) else None


def pick(
    bracket: Bracket, bins: Iterable[tuple[int, int, float, float]]
) -> list[Bracket]:
    """Bins ``(index, rows, low, high)`` of a bracket that hold its ranks."""
    below, found = bracket.below, []
    for _, rows, low, high in sorted(bins):
        ranks = tuple(k for k in bracket.ranks if below <= k < below + rows)
        if ranks:
            found.append(Bracket(bracket.name, low, high, below, rows, ranks))
        below += rows
    return found


def order_statistics(
    df: DataFrame, brackets: Sequence[Bracket]
) -> dict[tuple[str, int], float]:
    """Value at every wanted rank (counted from 0) of the brackets."""
    values: dict[tuple[str, int], float] = {}
    work = list(brackets)
    while work:
        values |= {(b.name, k): b.low for b in work if b.single for k in b.ranks}
        work = [b for b in work if not b.single]
        bare = [b for b in work if b.rows > SORT_ROWS and not b.cuts]
        if bare:
            work = [b for b in work if b not in bare] + _with_cuts(df, bare)
        ranges = [r for b in work for r in _ranges(b)]
        if any(r.rows > SORT_ROWS for r in ranges):
            work = _narrowed(df, ranges, values)
        else:
            work = _selected(df, ranges, values)
    return values


def _cell(df: DataFrame, name: str) -> Cell:
    return Cell({"v": ordinal(name, df.schema[name].dataType)})


def _layers(brackets: Sequence[Bracket]) -> list[list[int]]:
    """Places of the brackets in groups of one column each that do not overlap."""
    layers: list[list[int]] = []
    for i in sorted(range(len(brackets)), key=lambda i: (brackets[i].name, brackets[i].low)):
        for layer in layers:
            last = brackets[layer[-1]]
            if last.name == brackets[i].name and last.high < brackets[i].low:
                layer.append(i)
                break
        else:
            layers.append([i])
    return layers


def _inside(df: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    """``(id, value)`` of every value inside a bracket, ``id`` being its place. Nothing is shuffled."""
    layers = _layers(brackets)
    names = [brackets[layer[0]].name for layer in layers]
    # Values by name first: a filter on the brackets that Spark moved below them would hold each value's SQL once per bracket,
    # which is more than the JVM compiles.
    values = df.selectExpr(*(f"{ordinal(n, df.schema[n].dataType)} as v{j}" for j, n in enumerate(names)))
    cells = {}
    for j, layer in enumerate(layers):
        tests = (f"when v{j} between {sql_double(brackets[i].low)} and {sql_double(brackets[i].high)} then {i}" for i in layer)
        cells[j] = Cell({"v": f"v{j}", "bracket": f"case {' '.join(tests)} end"}, {"bracket": "{bracket}", "value": "{v}"})
    return long_form(values, cells).filter("bracket is not null").selectExpr("bracket as id", "value")


def _with_cuts(df: DataFrame, brackets: Sequence[Bracket]) -> list[Bracket]:
    """One scan: sketches of large brackets. Only values inside one reach the sketches."""
    found = sketched(_inside(df, brackets), len(brackets))
    return [replace(b, cuts=s.cuts, rows=s.n) for b, s in zip(brackets, found, strict=True)]


def _ranges(bracket: Bracket) -> list[Bracket]:
    """Ranges around the ranks of a bracket, ``rows`` being an estimate of the rows strictly inside.

    A bracket without cuts is small and stays whole.
    """
    if not bracket.cuts:
        return [bracket]
    found: list[tuple[int, int, list[int]]] = []
    margin = MARGIN * 2**bracket.wide
    for rank in sorted(bracket.ranks):
        share = (rank - (bracket.below or 0)) / bracket.rows
        first = max(0, math.floor((share - margin) * CUTS))
        last = min(CUTS, math.ceil((share + 1 / bracket.rows + margin) * CUTS))
        if found and first <= found[-1][1]:
            found[-1] = (found[-1][0], max(last, found[-1][1]), [*found[-1][2], rank])
        else:
            found.append((first, last, [rank]))
    return [
        replace(
            bracket,
            low=bracket.cuts[first],
            high=bracket.cuts[last],
            below=None,
            rows=(last - first) * bracket.rows // CUTS if bracket.cuts[first] < bracket.cuts[last] else 0,
            ranks=tuple(ranks),
            cuts=(),
        )
        for first, last, ranks in found
    ]


def _outside(bracket: Bracket, missed: Sequence[int]) -> list[Bracket]:
    """The whole column again for ranks that a sketch misjudged, with wider margins."""
    if not missed:
        return []
    end = float("inf")
    return [Bracket(bracket.name, -end, end, None, SORT_ROWS + 1, tuple(missed), wide=bracket.wide + 1)]


def _counted(
    df: DataFrame, ranges: Sequence[Bracket], values: dict[tuple[str, int], float]
) -> tuple[list[Bracket], list[Bracket]]:
    """One scan of plain sums: rows below each range, at its ends and inside.

    Ranks at the ends go to ``values``; comes back what lies strictly inside, and ranks that were misjudged.
    """
    per_column: dict[str, list[Bracket]] = {}
    for r in ranges:
        per_column.setdefault(r.name, []).append(r)
    cells = {}
    for name, own in per_column.items():
        cells[name] = _cell(df, name)
        for j, r in enumerate(own):
            low, high = sql_double(r.low), sql_double(r.high)
            tests = (f"< {low}", f"<= {low}", f"< {high}", f"<= {high}")
            cells[name].fields |= {f"n{j}_{i}": f"count_if({{v}} {test})" for i, test in enumerate(tests)}
    most = max(len(own) for own in per_column.values())
    kinds = {f"n{j}_{i}": "bigint" for j in range(most) for i in range(4)}
    found = {row["column"]: row for row in one_row_per_column(df, cells, kinds, 4 * most).collect()}
    inner, missed = [], []
    for name, own in per_column.items():
        for j, r in enumerate(own):
            first, inside, last, end = (found[name][f"n{j}_{i}"] for i in range(4))
            last = max(last, inside)
            values |= {(name, k): r.low for k in r.ranks if first <= k < inside}
            values |= {(name, k): r.high for k in r.ranks if last <= k < end}
            ranks = tuple(k for k in r.ranks if inside <= k < last)
            if ranks:
                low, high = math.nextafter(r.low, math.inf), math.nextafter(r.high, -math.inf)
                inner.append(replace(r, low=low, high=high, below=inside, rows=last - inside, ranks=ranks))
            missed += _outside(r, [k for k in r.ranks if not first <= k < end])
    return inner, missed


def _narrowed(
    df: DataFrame, ranges: Sequence[Bracket], values: dict[tuple[str, int], float]
) -> list[Bracket]:
    """What lies strictly inside the ranges, counted, and ranks that were misjudged."""
    inner, missed = _counted(df, [r for r in ranges if r.below is None], values)
    return [r for r in ranges if r.below is not None] + inner + missed


def _selected(
    df: DataFrame, ranges: Sequence[Bracket], values: dict[tuple[str, int], float]
) -> list[Bracket]:
    """The distinct values inside the ranges, ranked by one task per range.

    Only values inside a range are grouped; where the rows below one are not known they are
    counted first. Found ranks go to ``values``.
    """
    open_ = [r for r in ranges if r.below is None]
    inner, missed = _counted(df, open_, values) if open_ else ([], [])
    ranges = [r for r in ranges if r.below is not None] + inner
    if not ranges:
        return missed
    counts = _inside(df, ranges).withColumnRenamed("id", "bracket").groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    wanted = small_frame(
        df,
        [(i, k - r.below, k) for i, r in enumerate(ranges) for k in r.ranks],
        "bracket int, place bigint, wanted_rank bigint",
    )
    found = (
        counts.withColumn("upto", F.expr("sum(n) over (partition by bracket order by value)"))
        .join(F.broadcast(wanted), "bracket")  # one row per wanted rank
        .filter("place < upto and place >= upto - n")
        .collect()
    )
    values |= {(ranges[r["bracket"]].name, r["wanted_rank"]): r["value"] for r in found}
    return missed + [again for r in ranges for again in _outside(r, [k for k in r.ranks if (r.name, k) not in values])]


def linear_ranks(valid: int, share: float) -> tuple[int, int, float]:
    """Ranks on both sides of a quantile and the weight of the upper one."""
    place = (valid - 1) * share
    low = math.floor(place)
    return low, min(low + 1, valid - 1), place - low


def nearest_rank(valid: int, share: float) -> int:
    """Rank of a quantile that is always one of the values."""
    return math.floor((valid - 1) * share + 0.5)


def interpolate(low: float, high: float, weight: float) -> float:
    """Point between two values; equal ends also hold for infinities."""
    return low if low == high else low + (high - low) * weight


def whole_column(name: str, low: float, high: float, valid: int, ranks: Iterable[int]) -> Bracket:
    """Bracket that holds every non-missing value of a column."""
    return Bracket(name, low, high, 0, valid, tuple(sorted(set(ranks))))


def sketched_column(name: str, sketch: Sketch, ranks: Iterable[int]) -> Bracket:
    """Bracket of a column that has been sketched already."""
    whole = whole_column(name, sketch.cuts[0], sketch.cuts[-1], sketch.n, ranks)
    return replace(whole, cuts=sketch.cuts) if sketch.n > SORT_ROWS else whole


def quantile_ranks(valid: int, shares: Iterable[float], nearest: bool = False) -> set[int]:
    """Ranks needed for the given quantiles of a column."""
    if valid <= 0:
        return set()
    if nearest:
        return {nearest_rank(valid, share) for share in shares}
    return {k for share in shares for k in linear_ranks(valid, share)[:2]}


def ranks_for(
    valid: Mapping[str, int], shares: Iterable[float], nearest: bool = False
) -> dict[str, set[int]]:
    """Ranks needed for the given quantiles of several columns."""
    shares = tuple(shares)
    return {name: quantile_ranks(n, shares, nearest) for name, n in valid.items()}
