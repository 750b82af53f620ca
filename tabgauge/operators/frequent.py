"""The most frequent values of columns without shuffling all distinct ones.

A first scan keeps a frequent-items sketch per task and column, numbers as numbers and texts as texts. Every value with more rows than a known
share of the table is in the merged sketch, so a second scan counts just its items, exactly. If the
last of the wanted values has more rows than that share, no other value can have as many and the
result is exact; columns for which this cannot be shown, such as those whose values are all rare,
are counted in full instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import dtypes, text
from tabgauge.functions.frames import small_frame, union_all
from tabgauge.functions.tasks import by_task, in_levels
from tabgauge.functions.values import column
from tabgauge.operators.values import DIGEST_ABOVE_BYTES, GROUP_LIMIT, TOP_CATEGORIES, top_categories, value_counts, value_family, value_key

#: Items that a sketch tracks, in a map of 2048.
TRACKED = 1536
#: Published bound: values with more rows than this share of the table are in the sketch.
MISSED_SHARE = 3.5 / 2048
#: Columns per scan.
COLUMNS = 100

FREQUENT_SCHEMA = "column string, value string, n bigint, rank int"


def _item(name: str, dtype: T.DataType) -> str:
    """SQL for a value of its family's type that tells the values of a column apart."""
    key = value_key(name, dtype)
    if dtypes.has_nan(dtype):
        return f"case when {key} = 0 then double(0) when isnan({key}) then double('NaN') else {key} end"
    return key


def _families(df: DataFrame, names: Sequence[str], places: Iterable[int]) -> dict[str, list[int]]:
    """Places of the columns by the type under which their values are told apart."""
    found: dict[str, list[int]] = {}
    for i in places:
        found.setdefault(value_family(df.schema[names[i]].dataType), []).append(i)
    return found


def _shown(dtype: T.DataType) -> str:
    """SQL for the text that a value shows as, from its ``item`` and, for long texts, its ``whole``."""
    if isinstance(dtype, T.BooleanType):
        value = "cast(cast(item as bigint) as boolean)"
    elif isinstance(dtype, T.DateType):
        value = "date_from_unix_date(cast(item as int))"
    elif isinstance(dtype, T.TimestampType):
        value = "timestamp_micros(cast(item as bigint))"
    elif isinstance(dtype, T.TimestampNTZType):
        value = "timestampadd(MICROSECOND, cast(item as bigint), timestamp_ntz'1970-01-01 00:00:00')"
    elif isinstance(dtype, T.IntegralType):
        return "coalesce(cast(cast(item as bigint) as string), 'None')"
    elif dtypes.has_nan(dtype):
        return text.value_text("cast(item as double)", T.DoubleType())
    else:
        return "coalesce(whole, item, 'None')"
    return text.value_text(value, dtype)


def _stacked(df: DataFrame, names: Sequence[str], places: Sequence[int], whole: bool = False, *more: str) -> DataFrame:
    """``(id, item)`` of every row and the columns at ``places``, which are of one family; numbers stay numbers.

    ``whole``, if wanted, is the text where the item is a digest. ``more`` columns are kept.
    """
    inputs, rows = list(more), []
    for i in places:
        dtype = df.schema[names[i]].dataType
        inputs.append(f"{_item(names[i], dtype)} as item{i}")
        row = [str(i), f"item{i}"]
        if whole:
            long = dtypes.semantic_type(dtype) in (dtypes.TEXT, dtypes.UNKNOWN) and not isinstance(dtype, T.BinaryType)
            value = f"cast({column(names[i])} as string)"
            inputs.append((f"if(octet_length({value}) > {DIGEST_ABOVE_BYTES}, {value}, null)" if long else "string(null)") + f" as whole{i}")
            row.append(f"whole{i}")
        rows.append(", ".join(row))
    return df.selectExpr(*inputs).selectExpr(*more, f"stack({len(places)}, {', '.join(rows)}) as (id, item{', whole' * whole})")


def _candidates(
    df: DataFrame, names: Sequence[str], limit: int
) -> tuple[dict[int, list[str | None]], dict[int, tuple[int, bool]], dict[int, int]]:
    """Items of the merged sketches, per column the rows and whether the sketch dropped nothing, and rows that the last wanted value has at most."""
    grouped, groups = by_task(df.select(*(df[column(n)] for n in names)))

    def merge(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"), F.sum("rows").alias("rows"))

    parts = []
    for places in _families(grouped, names, range(len(names))).values():
        states = _stacked(grouped, names, places, False, "part").groupBy("id", "part").agg(
            F.expr(f"approx_top_k_accumulate(item, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows")
        )
        top = f"transform(approx_top_k_estimate(top, {TRACKED}), x -> struct(cast(x.item as string) as item, x.count as count)) as top"
        parts.append(in_levels(states, groups, ["id"], merge).selectExpr("id", "rows", top))
    items, known, last = {}, {}, {}
    for r in union_all(parts).collect() if parts else ():
        items[r["id"]] = [x["item"] for x in r["top"]]
        # A sketch never counts an item too low.
        last[r["id"]] = sorted((x["count"] for x in r["top"]), reverse=True)[limit - 1] if len(r["top"]) >= limit else 0
        # Counts that add up to the rows have lost nothing.
        known[r["id"]] = (r["rows"], sum(x["count"] for x in r["top"]) == r["rows"] and len(r["top"]) < TRACKED)
    return items, known, last


def frequent_values(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = TOP_CATEGORIES
) -> DataFrame:
    """``(column, value, n, rank)``: the ``limit`` most frequent values of each column, null included.

    Equal to ranking ``value_counts``, ties by value. Ranks up to ``TRACKED`` can come from the sketch.
    """
    columns = list(df.columns if columns is None else columns)
    dtypes.require_columns(df, columns)
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}.")
    parts, rest = [], []
    for start in range(0, len(columns), COLUMNS):
        names = columns[start : start + COLUMNS]
        items, known, last = _candidates(df, names, limit)
        # Columns whose values are all rare cannot be shown to be right and need no second count.
        able = [i for i in items if last[i] > MISSED_SHARE * known[i][0] or known[i][1]]
        counted = _counted(df, names, {i: items[i] for i in able})
        ranked = _ranked(counted.selectExpr("id as column", "value", "n"), limit)
        # At most ``limit`` rows per column come to the driver.
        found: dict[int, list] = {i: [] for i in able}
        for r in ranked.collect() if able else ():
            found[r["column"]].append((r["value"], r["n"], r["rank"]))
        for i, name in enumerate(names):
            rows = sorted(found.get(i, ()), key=lambda r: r[2])
            if i in found and (known[i][1] or (len(rows) == limit and rows[-1][1] > MISSED_SHARE * known[i][0])):
                parts += [(name, *r) for r in rows]
            elif i in items:
                rest.append(name)
    exact = small_frame(df, parts, FREQUENT_SCHEMA)
    return union_all([exact, _ranked(value_counts(df, rest), limit)]) if rest else exact


def _counted(df: DataFrame, names: Sequence[str], items: dict[int, list[str | None]]) -> DataFrame:
    """Exact counts of the given items only; tasks hand over at most one row per item."""
    parts = []
    for family, places in _families(df, names, items).items():
        wanted = df.sparkSession.createDataFrame([(i, item) for i in places for item in items[i]], "id int, item string")
        wanted = wanted.selectExpr("id", f"cast(item as {family}) as item")
        text_kept = family == "string"
        # At most TRACKED rows per column on the right side.
        chosen = _stacked(df, names, places, text_kept).alias("a").join(
            F.broadcast(wanted.alias("w")), F.expr("a.id = w.id and a.item <=> w.item"), "left_semi"
        )
        # The whole text is a key, since its least value, a text, would have every row sorted instead of hashed.
        counts = chosen.groupBy("id", "item", *["whole"] * text_kept).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.selectExpr("id", "cast(item as string) as item", "whole" if text_kept else "string(null) as whole", "n"))
    if not parts:
        return small_frame(df, [], "id int, value string, n bigint")
    cases = [f"when id = {i} then {_shown(df.schema[names[i]].dataType)}" for i in items]
    return union_all(parts).selectExpr("id", f"case {' '.join(cases)} end as value", "n")


def _ranked(counts: DataFrame, limit: int) -> DataFrame:
    if limit > GROUP_LIMIT:
        sizes = counts.select("column").distinct().withColumn("categories", F.lit(0).cast("bigint"))
        return top_categories(counts, limit, sizes).select("column", "value", "n", "rank")
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
