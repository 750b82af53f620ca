"""DuckDB SQL for every query, written from the definitions of the statistics.

The statistics are stated one column at a time and put together with UNION
ALL, which is slow and plain on purpose.
"""

from __future__ import annotations

from collections.abc import Iterable

from checks.inputs import LINES, PRECISE, SIGNALS, TABLES

WITH = f"with lines as ({LINES}), signals as ({SIGNALS}), precise as ({PRECISE})\n"

# Columns of the inputs by kind of value, in table order.
LINEITEM = {
    "l_orderkey": "integer",
    "l_partkey": "integer",
    "l_suppkey": "integer",
    "l_linenumber": "integer",
    "l_quantity": "float",
    "l_extendedprice": "float",
    "l_discount": "float",
    "l_tax": "float",
    "l_returnflag": "text",
    "l_linestatus": "text",
    "l_shipdate": "datetime",
}
ORDERS = {
    "o_orderkey": "integer",
    "o_custkey": "integer",
    "o_orderstatus": "text",
    "o_totalprice": "float",
    "o_orderdate": "datetime",
    "o_orderpriority": "text",
}
LINE_COLUMNS = {
    "l_orderkey": "integer",
    "l_linenumber": "integer",
    "l_quantity": "float",
    "double_quantity": "float",
    "discount_gap": "float",
    "tax_gap": "float",
    "low_var": "float",
    "constant": "integer",
    "all_missing": "float",
    "is_returned": "boolean",
    "is_line": "boolean",
    "flag_gap": "text",
    "dominant": "text",
    "l_linestatus": "text",
    "ship_date": "date",
    "ship_gap": "datetime",
    "one_day": "date",
}
SIGNAL_COLUMNS = {
    "event_id": "integer",
    "user_id": "integer",
    "ts": "datetime",
    "event_type": "text",
    "value": "float",
    "value_gap": "float",
    "value_nan": "float",
    "value_inf": "float",
    "value_far": "float",
    "day_far": "date",
}
LINE_NUMBERS = [
    "l_orderkey", "l_linenumber", "l_quantity", "double_quantity", "discount_gap", "tax_gap", "low_var", "constant", "all_missing"
]
SIGNAL_NUMBERS = ["event_id", "user_id", "value", "value_gap", "value_nan", "value_inf", "value_far"]


def numbers(columns: dict[str, str]) -> list[str]:
    return [name for name, kind in columns.items() if kind in ("integer", "float")]


def times(columns: dict[str, str]) -> list[str]:
    return [name for name, kind in columns.items() if kind in ("date", "datetime")]


def union(parts: Iterable[str]) -> str:
    return "\nunion all\n".join(f"select * from ({part})" for part in parts)


def missing(name: str, kind: str) -> str:
    return f"({name} is null or isnan({name}))" if kind == "float" else f"({name} is null)"


def valid(source: str, name: str) -> str:
    """Column ``x`` with the present values as doubles."""
    cast = f"cast({name} as double)"
    return f"(select {cast} as x from {source} where {name} is not null and not isnan({cast}))"


# Infinities leave no deviation, and no mean where both signs occur.
FINITE = "filter (not isinf(x))"
MEAN = (
    "case when count(*) filter (x = 'Infinity'::double) > 0 and count(*) filter (x = '-Infinity'::double) > 0 "
    f"then 'NaN'::double when bool_or(isinf(x)) then min(x) filter (isinf(x)) else avg(x) {FINITE} end"
)
DEVIATION = f"case when bool_or(isinf(x)) then 'NaN'::double else stddev_samp(x) {FINITE} end"


def stats(source: str, name: str) -> str:
    whole = {**LINEITEM, **ORDERS, **LINE_COLUMNS, **SIGNAL_COLUMNS}[name] == "integer"
    exact = [f"(select cast({end}({name}) as varchar) from {source})" if whole else "null::varchar" for end in ("min", "max")]
    return (
        f"select '{name}' as \"column\", min(x) as min, max(x) as max, {exact[0]} as min_exact, {exact[1]} as max_exact, "
        f"round({MEAN}, 6) as mean, round({DEVIATION}, 6) as std from {valid(source, name)}"
    )


def moments(source: str, name: str, digits: int) -> str:
    return (
        f"select '{name}' as \"column\", "
        f"case when bool_or(isinf(x)) then 'NaN'::double else "
        f"round(avg(pow(x - m, 3)) {FINITE} / pow(nullif(avg(pow(x - m, 2)) {FINITE}, 0), 1.5), {digits}) end as skewness, "
        f"case when bool_or(isinf(x)) then 'NaN'::double else "
        f"round(avg(pow(x - m, 4)) {FINITE} / pow(nullif(avg(pow(x - m, 2)) {FINITE}, 0), 2) - 3, {digits}) end as kurtosis "
        f"from {valid(source, name)}, (select avg(x) {FINITE} as m from {valid(source, name)})"
    )


QUANTILES = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def quantiles(source: str, name: str, digits: int = 6) -> str:
    cells = ", ".join(
        f"round(quantile_cont(x, {share}), {digits}) as {key}" for key, share in QUANTILES.items()
    )
    return f"select '{name}' as \"column\", {cells} from {valid(source, name)}"


def lengths(source: str, name: str) -> str:
    return (
        f"select '{name}' as \"column\", cast(min(length({name})) as integer) as char_length_min, "
        f"cast(max(length({name})) as integer) as char_length_max, "
        f"round(avg(length({name})), 6) as char_length_mean, "
        f"round(stddev_samp(length({name})), 6) as char_length_std from {source}"
    )


def time_text(value: str, kind: str) -> str:
    if kind == "date":
        return f"cast({value} as varchar)"
    return (
        f"case when epoch_us({value}) % 1000000 = 0 then strftime({value}, '%Y-%m-%d %H:%M:%S') "
        f"else strftime({value}, '%Y-%m-%d %H:%M:%S.%f') end"
    )


def span(source: str, name: str, kind: str) -> str:
    seconds = (
        f"(max({name}) - min({name})) * 86400"
        if kind == "date"
        else f"(epoch_us(max({name})) - epoch_us(min({name}))) // 1000000"
    )
    return (
        f"select '{name}' as \"column\", {time_text(f'min({name})', kind)} as temporal_min, "
        f"{time_text(f'max({name})', kind)} as temporal_max, "
        f"cast({seconds} as bigint) as temporal_diff_seconds from {source}"
    )


def distinct(source: str, name: str) -> str:
    return (
        f"select '{name}' as \"column\", cast(sum(n) as bigint) as row_count, "
        f"count(*) as cardinality, round(count(*) / sum(n), 6) as unique_rate, "
        f"max(n) as top_count from (select {name}, count(*) as n from {source} group by {name})"
    )


def categorical(kind: str) -> str:
    if kind == "boolean":
        return "true"
    return "cardinality <= 10" if kind in ("integer", "float", "text") else "false"


def types(source: str, columns: dict[str, str]) -> str:
    return union(
        f"select \"column\", cast({i} as integer) as position, '{kind}' as type, "
        f"{categorical(kind)} as is_categorical, {kind in ('integer', 'float')} as is_numeric, "
        f"{kind in ('date', 'datetime')} as is_temporal, null::varchar as timezone, cardinality, unique_rate "
        f"from ({distinct(source, name)})"
        for i, (name, kind) in enumerate(columns.items())
    )


def gaps(source: str, name: str, kind: str) -> str:
    gone = f"count(*) filter ({missing(name, kind)})"
    infinite = f"count(*) filter (abs({name}) = 'Infinity'::double)" if kind == "float" else "0::bigint"
    return (
        f"select '{name}' as \"column\", count(*) as row_count, {gone} as missing_count, "
        f"round({gone} / count(*), 6) as missing_rate, {infinite} as inf_count from {source}"
    )


def all_gaps(source: str, columns: dict[str, str]) -> str:
    return union(gaps(source, name, kind) for name, kind in columns.items())


def counts(source: str, name: str, kind: str) -> str:
    text = f"cast({name} as varchar)"
    if kind == "boolean":
        text = f"case when {name} then 'True' when not {name} then 'False' end"
    return (
        f"select '{name}' as \"column\", coalesce({text}, 'None') as value, count(*) as n "
        f"from {source} group by {name}"
    )


def zscores(
    source: str, name: str, kind: str, limit: float = 3.0, given: str | None = None
) -> str:
    known = given or f"select {MEAN} as m, {DEVIATION} as s from {valid(source, name)}"
    nan = f" or isnan({name})" if kind == "float" else ""
    far = f"count(*) filter ((s > 0 and abs({name} - m) / s > {limit}){nan})"
    empty = f"count({name}) = 0"
    return (
        f"select '{name}' as \"column\", "
        f"case when {empty} then 0 when any_value(s) is null then null else {far} end as outlier_count, "
        f"round(case when {empty} then 0 when any_value(s) is null then null else {far} / count(*) end, 6) "
        f"as outlier_rate, case when {empty} then true else any_value(s) * any_value(s) < 0.01 end "
        f"as has_low_variation from {source}, ({known})"
    )


def nearest(values: str, share: float) -> str:
    return f"list_sort(list({values}))[cast(floor((count({values}) - 1) * {share} + 0.5) as integer) + 1]"


def fences(source: str, name: str, kind: str) -> str:
    place = f"{name} - date '1970-01-01'" if kind == "date" else f"epoch_ms({name})"
    value, tick = (place, 1) if kind == "date" else (f"epoch_us({name})", 1000)
    low, high = "floor(q1 - 1.5 * (q3 - q1))", "ceil(q3 + 1.5 * (q3 - q1))"
    outside = f"count(*) filter ({value} < {low} * {tick} or {value} > {high} * {tick})"
    quartiles = f"select {nearest('p', 0.25)} as q1, {nearest('p', 0.75)} as q3 from (select {place} as p from {source} where {name} is not null)"
    return (
        f"select '{name}' as \"column\", {outside} as outlier_count, "
        f"round({outside} / count(*), 6) as outlier_rate, "
        f"count(distinct {name}) + max(case when {name} is null then 1 else 0 end) <= 1 "
        f"as has_low_variation from {source}, ({quartiles})"
    )


def dominant(source: str, name: str) -> str:
    return (
        f"select '{name}' as \"column\", 0::bigint as outlier_count, 0::double as outlier_rate, "
        f"max(n) / sum(n) > 0.8 as has_low_variation "
        f"from (select count(*) as n from {source} group by {name})"
    )


def quality(source: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        if kind in ("integer", "float"):
            parts.append(zscores(source, name, kind))
        elif kind in ("date", "datetime"):
            parts.append(fences(source, name, kind))
        else:
            parts.append(dominant(source, name))
    return union(parts)


def bins(source: str, name: str, count: str = "10") -> str:
    """Right-closed bins between the finite ends; ``count`` is SQL over ``x``."""
    return f"""
    select '{name}' as "column", cast(i as bigint) as bin_idx,
      '[' || case when i = 0 then '-inf' when i > k then printf('%.10f', hi)
                  else printf('%.10f', lo + (i - 1) * w) end || ',' ||
      case when i = 0 then printf('%.10f', lo) when i > k then 'inf'
           when i = k then printf('%.10f', hi) else printf('%.10f', lo + i * w) end || ']'
      as bin_key, coalesce(n, 0) as n
    from (select *, unnest(generate_series(0, k + 1)) as i from (
        select min(x) filter (not isinf(x)) as lo, max(x) filter (not isinf(x)) as hi,
          cast({count} as integer) as k, (hi - lo) / k as w from {valid(source, name)}))
    left join (
      select case when x = 'Infinity'::double then k + 1 when x = '-Infinity'::double then 0
             else least(greatest(cast(ceil((x - lo) / w) as integer), 1), k) end as j, count(*) as n
      from {valid(source, name)}, (
        select min(x) filter (not isinf(x)) as lo, max(x) filter (not isinf(x)) as hi,
          cast({count} as integer) as k, (hi - lo) / k as w from {valid(source, name)})
      group by 1) on i = j"""


STURGES = "greatest(1, ceil(log2(count(x)) + 1))"
FREEDMAN_DIACONIS = (
    f"greatest(1, ceil((max(x) {FINITE} - min(x) {FINITE}) / (2 * ({nearest('x', 0.75)} - {nearest('x', 0.25)}) "
    f"/ pow(count(x) {FINITE}, 1.0 / 3))))"
)


def rule(source: str, name: str, count: str) -> str:
    return f"select '{name}' as \"column\", cast({count} as bigint) as bins from {valid(source, name)}"


def pearson(source: str, columns: dict[str, str], propagate: bool = False, places: bool = False) -> str:
    parts = []
    names = numbers(columns)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = f"{a} is not null and {b} is not null"
            r = f"""case when count(distinct {a}) filter ({both}) <= 1
                or count(distinct {b}) filter ({both}) <= 1
                {f'or count({a}) < count(*) or count({b}) < count(*)' if propagate else ''}
                then 'NaN'::double else round(corr({a}, {b}), 6) end"""
            place = f"cast({i} as integer) as pos_1, cast({j} as integer) as pos_2, " if places else ""
            parts.append(f"select '{a}' as col_1, '{b}' as col_2, {place}{r} as r from {source}")
    return union(parts)


def pearson_with_infinities(source: str, columns: dict[str, str]) -> str:
    """Pairs of all numeric columns; an infinity among a pair's rows makes it NaN."""
    parts = []
    names = numbers(columns)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            rows = (
                f"select cast({a} as double) as x, cast({b} as double) as y from {source} "
                f"where not {missing(a, columns[a])} and not {missing(b, columns[b])}"
            )
            finite = "filter (not isinf(x) and not isinf(y))"
            parts.append(
                f"select '{a}' as col_1, '{b}' as col_2, cast({i} as integer) as pos_1, cast({j} as integer) as pos_2, "
                f"case when count(distinct x) <= 1 or count(distinct y) <= 1 or count(*) filter (isinf(x) or isinf(y)) > 0 "
                f"then 'NaN'::double else round(corr(x, y) {finite}, 6) end as r from ({rows})"
            )
    return union(parts)


# Fields of an estimated profile that are exact.
ESTIMATED_FIELDS = (
    "column", "type", "row_count", "missing_count", "missing_rate", "inf_count", "min", "max", "min_exact", "max_exact", "mean", "std",
    "char_length_min", "char_length_max", "char_length_mean", "char_length_std", "temporal_min", "temporal_max",
    "temporal_diff_seconds", "has_low_variation",
)

PROFILE_FIELDS = {
    "column": "varchar",
    "position": "integer",
    "is_target": "boolean",
    "is_feature": "boolean",
    "type": "varchar",
    "is_categorical": "boolean",
    "is_numeric": "boolean",
    "is_temporal": "boolean",
    "timezone": "varchar",
    "row_count": "bigint",
    "missing_count": "bigint",
    "missing_rate": "double",
    "inf_count": "bigint",
    "cardinality": "bigint",
    "unique_rate": "double",
    "min": "double",
    "max": "double",
    "min_exact": "varchar",
    "max_exact": "varchar",
    "mean": "double",
    "median": "double",
    "p5": "double",
    "q1": "double",
    "q3": "double",
    "p95": "double",
    "std": "double",
    "skewness": "double",
    "kurtosis": "double",
    "char_length_min": "integer",
    "char_length_max": "integer",
    "char_length_mean": "double",
    "char_length_std": "double",
    "temporal_min": "varchar",
    "temporal_max": "varchar",
    "temporal_diff_seconds": "bigint",
    "outlier_count": "bigint",
    "outlier_rate": "double",
    "has_low_variation": "boolean",
}


def profile(source: str, columns: dict[str, str], target: str | None = None) -> str:
    """One row per column, from the parts above."""
    order = [n for n in columns if n == target] + [n for n in columns if n != target]
    rows = []
    for position, name in enumerate(order):
        kind = columns[name]
        known = {
            "column": f"'{name}'",
            "position": str(position),
            "is_target": str(name == target),
            "is_feature": str(name != target),
            "type": f"'{kind}'",
            "is_categorical": categorical(kind),
            "is_numeric": str(kind in ("integer", "float")),
            "is_temporal": str(kind in ("date", "datetime")),
        }
        parts = {"g": gaps(source, name, kind), "d": distinct(source, name)}
        parts["q"] = quality(source, {name: kind})
        if kind in ("integer", "float"):
            parts |= {"s": stats(source, name), "m": moments(source, name, 6), "p": quantiles(source, name)}
        elif kind == "text":
            parts["l"] = lengths(source, name)
        elif kind in ("date", "datetime"):
            parts["t"] = span(source, name, kind)
        holds = {
            "g": ("row_count", "missing_count", "missing_rate", "inf_count"),
            "d": ("cardinality", "unique_rate"),
            "q": ("outlier_count", "outlier_rate", "has_low_variation"),
            "s": ("min", "max", "min_exact", "max_exact", "mean", "std"),
            "m": ("skewness", "kurtosis"),
            "p": tuple(QUANTILES),
            "l": tuple(f for f in PROFILE_FIELDS if f.startswith("char_length")),
            "t": ("temporal_min", "temporal_max", "temporal_diff_seconds"),
        }
        known |= {field: f"{key}.{field}" for key in parts for field in holds[key]}
        cells = []
        for field, cast in PROFILE_FIELDS.items():
            value = f"cast({known.get(field, 'null')} as {cast})"
            cells.append((f"round({value}, 6)" if cast == "double" else value) + f' as "{field}"')
        froms = ", ".join(f"({sql}) {key}" for key, sql in parts.items())
        rows.append(f"select {', '.join(cells)} from {froms}")
    return union(rows)


def number_text(value: str, kind: str) -> str:
    return f"cast(cast({value} as bigint) as varchar)" if kind == "integer" else f"cast({value} as varchar)"


def category_text(source: str, name: str, kind: str) -> str:
    return (
        "select count(*) as categories, '{' || string_agg('''' || value || ''': ' || n, ', ' "
        f"order by n desc, value) || '}}' as listed from ({counts(source, name, kind)})"
    )


def span_text(days: str, seconds: str) -> str:
    return f"""case when {days} > 365.2425::double
        then ({days} / 365.2425::double) || ' years, ' || ({days}::double % 365.2425::double) || ' days'
        when {days} > 0 then {days} || ' days, ' || ({seconds} % 86400) // 3600 || ' hours'
        else ({seconds} // 3600) || ' hours, ' || ({seconds} % 3600) // 60 || ' minutes, '
          || {seconds} % 60 || ' seconds' end"""


def report(source: str, columns: dict[str, str], target: str | None = None) -> str:
    rows = []
    for name, kind in columns.items():
        role = "Target Variable" if name == target else "Feature"
        froms = [f"({gaps(source, name, kind)}) g", f"({distinct(source, name)}) d"]
        froms.append(f"({category_text(source, name, kind)}) c")
        lines = [
            f"'## Analysis of column: {name}'",
            f"'**Type**: {kind} ({role})'",
            "case when missing_count = 0 then 'No missing values' else 'Missing values: ' || missing_count "
            "|| ' (' || printf('%.2f', missing_count / g.row_count * 100) || '%)' end",
            f"case when {categorical(kind)} then 'Unique categories #: ' || categories || chr(10) || "
            "'Category distribution: ' || listed end",
        ]
        if kind in ("integer", "float"):
            froms.append(f"(select min(x) lo, max(x) hi, avg(x) a, stddev_samp(x) s, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.5) q2, quantile_cont(x, 0.75) q3 from {valid(source, name)}) s")
            froms.append(f"({moments(source, name, 12)}) m")
            froms.append(
                "(select string_agg('| ' || replace(trim(bin_key, '[]'), ',', ' to ') || ' | ' || n || ' |', "
                f"chr(10) order by bin_idx) as body from ({bins(source, name)})) h"
            )
            lines.append(
                f"'Range: ' || {number_text('lo', kind)} || ' to ' || {number_text('hi', kind)} || chr(10) || "
                "'Mean: ' || printf('%.4f', a) || ', Median: ' || printf('%.4f', q2) || chr(10) || "
                "'Std Dev: ' || printf('%.4f', s) || chr(10) || "
                "'Q1: ' || printf('%.4f', q1) || ', Q3: ' || printf('%.4f', q3) || chr(10) || "
                "'Skewness: ' || printf('%.4f', skewness) || ', Kurtosis: ' || printf('%.4f', kurtosis)"
            )
            lines.append(
                f"case when not ({categorical(kind)}) then chr(10) || '**Distribution (Histogram):**' || chr(10) "
                "|| chr(10) || '| Bin Range | Count |' || chr(10) || '|-----------|-------|' || chr(10) || body end"
            )
        if kind in ("date", "datetime"):
            froms.append(f"({span(source, name, kind)}) t")
            days = "(temporal_diff_seconds // 86400)"
            lines.append(
                "'Range: ' || temporal_min || ' to ' || temporal_max || chr(10) || 'Time span: ' || "
                + span_text(days, "temporal_diff_seconds")
            )
        rows.append(
            f"select '{name}' as \"column\", concat_ws('  ' || chr(10), {', '.join(lines)}) as info "
            f"from {', '.join(froms)}"
        )
    return union(rows)


def listing(condition: str) -> str:
    return f"string_agg(\"column\", ', ' order by position) filter ({condition})"


def summary(source: str, columns: dict[str, str], target: str) -> str:
    """Types and missing values with the target first."""
    order = [n for n in columns if n == target] + [n for n in columns if n != target]
    return union(
        f"select t.*, {i} as position, missing_count, missing_rate from "
        f"(select * exclude (position) from ({types(source, {n: columns[n]})})) t, "
        f"({gaps(source, n, columns[n])}) g"
        for i, n in enumerate(order)
    )


STRONG = f"""select coalesce('Strongly correlated feature pairs (|r| >= 0.8):' || string_agg(
    chr(10) || '- ' || col_1 || ' & ' || col_2 || ': r = ' || printf('%.2f', r), ''
    order by abs(r) desc, pos_1, pos_2) filter (pos_1 < pos_2 and not isnan(r) and abs(r) >= 0.8),
    'No strongly correlated feature pairs (|r| >= 0.8).') as correlation_text
  from ({pearson('lines', LINE_COLUMNS, places=True)})"""


def table_info() -> str:
    labels = {"integer": "int", "float": "float", "boolean": "bool", "datetime": "datetime", "date": "date", "text": "text"}
    shape = ", ".join(
        f"case when count(*) filter (type = '{kind}') > 0 then count(*) filter (type = '{kind}') || ' {label}' end"
        for kind, label in labels.items()
    )
    target = "(select cardinality from (" + distinct("lines", "is_returned") + "))"
    return f"""select concat_ws(chr(10) || chr(10),
      '## DataFrame Shape' || chr(10) || 'Rows: ' || (select count(*) from lines) || ', Columns: '
        || count(*) || ' (' || concat_ws(', ', {shape}) || ')',
      count(*) filter (missing_count > 0) || ' columns have missing values: ' || {listing('missing_count > 0')}
        || '.' || chr(10) || 'Columns with >30.0% missing:' || {listing('missing_rate > 0.3')} || '.',
      'Target ''is_returned'' is categorical with ' || {target} || ' classes.',
      (select correlation_text from ({STRONG})),
      'Columns with high cardinality (>50): ' || {listing('cardinality > 50')} || '.' || chr(10)
        || 'Constant columns (single unique value): ' || {listing('cardinality = 1')} || '.') as info
    from ({summary('lines', LINE_COLUMNS, 'is_returned')})"""


def table_lists() -> str:
    def names(condition: str) -> str:
        return f"coalesce(string_agg(\"column\", ',' order by position) filter ({condition}), '')"

    kinds = {"integer": "int", "float": "float", "boolean": "bool", "datetime": "datetime", "date": "date", "time": "time", "text": "text", "categorical": "categorical"}
    cells = [f"{names(f'''type = '{kind}' ''')} as {label}_cols" for kind, label in kinds.items()]
    return f"""select (select count(*) from lines) as num_rows, cast(count(*) as integer) as num_cols,
      'is_returned' as target, {', '.join(cells)}, {names('missing_count > 0')} as missing_cols,
      {names('missing_rate > 0.3')} as high_missing_cols, {names('cardinality > 50')} as high_cardinality_cols,
      {names('cardinality = 1')} as constant_cols, {names("\"column\" <> 'is_returned'")} as features
    from ({summary('lines', LINE_COLUMNS, 'is_returned')})"""


TARGETS = """
select 'l_returnflag' as "column", 'Target ''l_returnflag'' is categorical with '
  || count(distinct l_returnflag) || ' classes.' as summary from lineitem
union all
select 'l_shipdate', 'Target ''l_shipdate'' type: datetime.'
union all
select 'o_custkey', 'Target ''o_custkey'' is numeric. Mean: ' || round(avg(o_custkey), 2) || ', Std: '
  || round(stddev_samp(o_custkey), 2) || ', Min: ' || min(o_custkey) || ', Max: ' || max(o_custkey) || '.'
  from orders
union all
select 'o_totalprice', 'Target ''o_totalprice'' is numeric. Mean: ' || round(avg(o_totalprice), 2) || ', Std: '
  || round(stddev_samp(o_totalprice), 2) || ', Min: ' || min(o_totalprice) || ', Max: ' || max(o_totalprice)
  || '.' from orders
"""


def spans() -> str:
    return union(
        [span("orders", "o_orderdate", "datetime")]
        + [span("lines", n, LINE_COLUMNS[n]) for n in times(LINE_COLUMNS)]
        + [span("signals", n, SIGNAL_COLUMNS[n]) for n in times(SIGNAL_COLUMNS)]
    )


def top(parts: list[str]) -> str:
    return f"""select "column", value, n, cast(rank as integer) as rank, categories,
      case when categories >= 20 then categories - 20 end as remaining from (
      select *, row_number() over (partition by "column" order by n desc, value) as rank,
        count(*) over (partition by "column") as categories from ({union(parts)})) where rank <= 20"""


def registered() -> dict[str, str]:
    """SQL by query name."""
    line_types = types("lines", LINE_COLUMNS)
    line_gaps = all_gaps("lines", LINE_COLUMNS)
    line_quality = quality("lines", LINE_COLUMNS)
    texts = [n for n, kind in LINE_COLUMNS.items() if kind == "text"]
    flags = [n for n, kind in LINE_COLUMNS.items() if kind == "boolean"]
    documents = ["doc_id", "text", "lang", "source", "n_chars"]
    wide = ["p_partkey", "p_size", "p_retailprice"]
    ready = {
        "load_shape": union(
            f"select '{name}' as table_name, count(*) as num_rows, (select cast(count(*) as integer) "
            f"from (describe {name})) as num_cols from {name}"
            for name in TABLES
        ),
        "column_roles": union(
            f"select '{name}' as \"column\", cast({i} as integer) as position, {i == 0} as is_target, "
            f"{i > 0} as is_feature, cardinality from ({distinct('orders', name)})"
            for i, name in enumerate(sorted(ORDERS, key=lambda n: n != "o_totalprice"))
        ),
        "column_types": line_types,
        "columns_by_type": f"select type, string_agg(\"column\", ',' order by position) as columns from ({line_types}) group by type",
        "type_counts": f"select type, count(*) as n from ({line_types}) group by type",
        "cardinality": union(
            [distinct("lines", n) for n in LINE_COLUMNS] + [distinct("signals", n) for n in SIGNAL_COLUMNS]
        ),
        "cardinality_documents": union(distinct("documents", n) for n in documents),
        "cardinality_flags": f"select \"column\", cardinality, cardinality > 50 as is_high_cardinality, cardinality = 1 as is_constant from ({line_types}) where cardinality > 50 or cardinality = 1",
        "drop_missing": "select event_id, user_id, value_nan from signals where value_nan is not null and not isnan(value_nan)",
        "inf_count": f"select \"column\", inf_count from ({all_gaps('signals', SIGNAL_COLUMNS)})",
        "keep_infinite": "select event_id, value_inf > 0 as is_positive from signals where isinf(value_inf)",
        "missing_counts": union([line_gaps, all_gaps("signals", SIGNAL_COLUMNS)]),
        "missing_columns": f"select \"column\", missing_count from ({line_gaps}) where missing_count > 0",
        "high_missing_columns": f"select \"column\", missing_rate from ({line_gaps}) where missing_rate > 0.3",
        "missing_rate_table": f"select \"column\", printf('%.4f', missing_count / row_count * 100) || '%' as missing_percent from ({line_gaps}) where missing_count > 0",
        "missing_rate_markdown": "select '| Column | Missing Rate |' || chr(10) || '| ------ | ----------- |' || string_agg(chr(10) || '| ' || name || ' | ' || printf('%.4f', missing_count / row_count * 100) || '% |', '' order by i) as missing_table from ("
        + union(
            f"select {i} as i, \"column\" as name, missing_count, row_count from ({gaps('lines', n, kind)})"
            for i, (n, kind) in enumerate(LINE_COLUMNS.items())
        )
        + ") where missing_count > 0",
        "all_missing_defaults": union(
            f"select '{n}' as \"column\", 0::bigint as outlier_count, 0::double as outlier_rate, "
            f"count(all_missing) = 0 as has_low_variation from lines"
            for n in ("all_missing", "no_text", "no_flag", "no_date")
        ),
        "numeric_stats": union(
            [stats("lineitem", n) for n in numbers(LINEITEM)]
            + [stats("lines", n) for n in LINE_NUMBERS]
            + [stats("signals", n) for n in SIGNAL_NUMBERS]
        ),
        "numeric_moments": union(
            [moments("lineitem", n, 6) for n in numbers(LINEITEM)]
            + [moments("signals", n, 6) for n in SIGNAL_NUMBERS]
        ),
        "numeric_quantiles": union(
            [quantiles("lineitem", n) for n in numbers(LINEITEM)]
            + [quantiles("lines", n) for n in LINE_NUMBERS]
            + [quantiles("signals", n) for n in SIGNAL_NUMBERS]
        ),
        "string_length_stats": union(
            [lengths("documents", n) for n in ("text", "lang", "source")]
            + [lengths("pages", n) for n in ("url", "html")]
            + [lengths("customer", n) for n in ("c_name", "c_mktsegment")]
            + [lengths("lines", "flag_gap")]
        ),
        "temporal_stats": spans(),
        "temporal_span_text": f"select \"column\", {span_text('(temporal_diff_seconds // 86400)', 'temporal_diff_seconds')} as span from ({spans()})",
        "value_counts": union(
            counts("lines", n, kind) for n, kind in LINE_COLUMNS.items()
        ),
        "frequent_values": "select \"column\", value, n, cast(place as integer) as rank from (select *, row_number() over (partition by \"column\" order by n desc, value) as place from ("
        + union([counts("lines", n, k) for n, k in LINE_COLUMNS.items()] + [counts("documents", n, "text") for n in ("lang", "source")])
        + ")) where place <= 20",
        "data_quality_given": union(
            zscores("signals", n, k, given=None if n == "value_gap" else f"select round({MEAN}) as m, {DEVIATION if n == 'user_id' else f'round({DEVIATION}) / 2'} as s from {valid('signals', n)}")
            if n in SIGNAL_NUMBERS
            else quality("signals", {n: k})
            for n, k in SIGNAL_COLUMNS.items()
        ),
        "numeric_stats_exact": union(
            f"select '{n}' as \"column\", cast(min({n}) as varchar) as min_exact, cast(max({n}) as varchar) as max_exact from precise"
            for n in ("far_key", "low_key", "price")
        ),
        "quantiles_estimated": union(
            f"select '{n}' as \"column\", " + ", ".join(f"count(*) > 0 as {k}_close" for k in QUANTILES) + f" from {source}"
            for source, names in (("lineitem", numbers(LINEITEM)), ("signals", SIGNAL_NUMBERS))
            for n in names
        ),
        "top_categories": top(
            [counts("part", n, "text") for n in ("p_brand", "p_type", "p_size")]
            + [counts("lines", n, "text") for n in ("flag_gap", "l_quantity")]
        ),
        "low_variation_numeric": f"select \"column\", has_low_variation from ({quality('lines', {n: LINE_COLUMNS[n] for n in numbers(LINE_COLUMNS)})})",
        "low_variation_boolean": union(dominant("lines", n) for n in flags),
        "low_variation_categorical": union(dominant("lines", n) for n in texts),
        "low_variation_temporal": f"select \"column\", has_low_variation from ({quality('lines', {n: LINE_COLUMNS[n] for n in times(LINE_COLUMNS)})})",
        "outliers_zscore": union(
            [zscores("lineitem", n, LINEITEM[n], 1.5) for n in numbers(LINEITEM)]
            + [zscores("signals", n, SIGNAL_COLUMNS[n]) for n in SIGNAL_NUMBERS]
        ),
        "outliers_zscore_given": union(
            zscores(
                "signals",
                n,
                SIGNAL_COLUMNS[n],
                given=f"select round({MEAN}) as m, round({DEVIATION}) / 2 as s from {valid('signals', n)}",
            )
            for n in SIGNAL_NUMBERS
        ),
        "outliers_iqr_temporal": union(
            [fences("lines", n, LINE_COLUMNS[n]) for n in times(LINE_COLUMNS)]
            + [fences("signals", n, SIGNAL_COLUMNS[n]) for n in times(SIGNAL_COLUMNS)]
        ),
        "data_quality": line_quality,
        "histogram_numeric": union(
            [bins("lineitem", n) for n in numbers(LINEITEM)]
            + [bins("signals", n) for n in ("value_nan", "value_inf")]
        ),
        "histogram_custom_bins": union(bins("events", n, "ceil(sqrt(count(x)))") for n in ("user_id", "value")),
        "histogram_sturges": union(bins("orders", n, STURGES) for n in ("o_custkey", "o_totalprice")),
        "bins_sturges": union(
            [rule("lineitem", n, STURGES) for n in numbers(LINEITEM)]
            + [rule("signals", n, STURGES) for n in SIGNAL_NUMBERS]
        ),
        "bins_freedman_diaconis": union(
            [rule("lineitem", n, FREEDMAN_DIACONIS) for n in numbers(LINEITEM)]
            + [rule("signals", n, FREEDMAN_DIACONIS) for n in SIGNAL_NUMBERS]
        ),
        "histogram_categorical": union(counts("orders", n, "text") for n in ("o_orderstatus", "o_orderpriority")),
        "histogram_all": union(
            f"select \"column\", key, n from (select \"column\", value as key, n, true as few from ({counts('lineitem', n, LINEITEM[n])})"
            + (
                f" union all select \"column\", bin_key, n, false from ({bins('lineitem', n)})"
                if LINEITEM[n] != "text"
                else ""
            )
            + f") where few = (select cardinality <= 10 from ({distinct('lineitem', n)}))"
            for n in LINEITEM
            if LINEITEM[n] != "datetime"
        ),
        "pearson_long": pearson("lineitem", LINEITEM, places=True),
        "pearson_gaps": pearson("lines", LINE_COLUMNS),
        "pearson_signals": pearson_with_infinities("signals", SIGNAL_COLUMNS),
        "pearson_propagate": pearson("lines", LINE_COLUMNS, propagate=True),
        "pearson_wide": union(
            f"select '{a}' as index, "
            + ", ".join(f"round(corr({a}, {b}), 6) as {b}" for b in wide)
            + " from part"
            for a in wide
        ),
        "pearson_lookup": "select 'l_quantity' as col_1, 'l_extendedprice' as col_2, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem",
        "strong_correlations": f"select col_1, col_2, r from ({pearson('lines', LINE_COLUMNS, places=True)}) where pos_1 < pos_2 and not isnan(r) and abs(r) >= 0.8",
        "profile_table": profile("lineitem", LINEITEM, "l_quantity"),
        "profile_gaps": profile(
            "lines", LINE_COLUMNS
        ),
        "profile_estimated": "select "
        + ", ".join(f'round("{f}", 4) as "{f}"' if PROFILE_FIELDS[f] == "double" else f'"{f}"' for f in ESTIMATED_FIELDS)
        + f", true as cardinality_close from ({profile('lines', LINE_COLUMNS)} union all {profile('signals', SIGNAL_COLUMNS)})",
        "profile_column": profile("orders", {"o_totalprice": "float"}, "o_totalprice"),
        "table_profile": table_lists(),
        "column_report": union(
            [
                report("lineitem", LINEITEM, "l_linestatus"),
                report("lines", {n: LINE_COLUMNS[n] for n in ("flag_gap", "is_returned", "ship_date")}),
            ]
        ),
        "table_report": table_info(),
        "correlation_section": STRONG,
        "target_summary": TARGETS,
    }
    return {name: WITH + sql for name, sql in ready.items()}
