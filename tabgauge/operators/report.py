"""Readable text about each column and about the table.

Everything here works on profile frames, which hold one row per column, per
bin or per listed category of the table.
"""

from __future__ import annotations

from collections.abc import Collection

from string import Formatter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.frames import sql_text
from tabgauge.functions.text import fixed, float_text, quoted, say, span_text
from tabgauge.operators.correlation import RANKED_DIGITS, STRONG_CORRELATION
from tabgauge.operators.missing import HIGH_MISSING_RATE
from tabgauge.operators.values import HIGH_CARDINALITY, TOP_CATEGORIES

# Names of the types in the table report, in its order.
TYPE_LABELS = {
    dtypes.INTEGER: "int",
    dtypes.FLOAT: "float",
    dtypes.BOOLEAN: "bool",
    dtypes.DATETIME: "datetime",
    dtypes.DATE: "date",
    dtypes.TIME: "time",
    dtypes.TEXT: "text",
    dtypes.CATEGORICAL: "categorical",
}


def write(template: str, **values: str) -> str:
    """SQL for a text with ``{name}`` where a column or named SQL value goes.

    Null if any of the values is null.
    """
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(sql_text(text))
        if name:
            pieces.append(values.get(name, name))
    return say(*pieces)


def lines(separator: str, *parts: str) -> str:
    """SQL that joins texts and leaves out those that are null."""
    return f"concat_ws({sql_text(separator)}, {', '.join(parts)})"


def category_lists(categories: DataFrame) -> DataFrame:
    """The listed categories of every column as one text."""
    entry = write("{value}: {n}", value=quoted("value"))
    listed = "array_join(array_sort(entries).text, ', ')"
    return (
        categories.selectExpr(
            "column", "categories", f"struct(rank, {entry} as text) as entry"
        )
        .groupBy("column")
        .agg(
            F.max("categories").alias("categories"),
            F.collect_list("entry").alias("entries"),
        )
        .selectExpr(
            "column",
            "categories",
            write("{{{listed}}}", listed=listed) + " as category_list",
        )
    )


#: Inner bins that a report shows at most.
REPORT_BINS = 200


def bin_tables(histogram: DataFrame, most: int = REPORT_BINS) -> DataFrame:
    """The bins of every column as one Markdown table.

    Where a column has more than ``most`` inner bins, neighbours are shown as one, so that no text grows with them.
    """
    last = histogram.groupBy("column").agg((F.max("bin_idx") - 1).alias("inner_bins"))
    width = f"greatest(1, bigint(ceil(inner_bins / {most})))"
    place = f"case when bin_idx = 0 then 0 when bin_idx > inner_bins then {most} + 1 else (bin_idx - 1) div {width} + 1 end"
    histogram = (
        histogram.join(F.broadcast(last), "column")  # one row per column of the table
        .withColumn("bin_idx", F.expr(place))
        .groupBy("column", "bin_idx")
        .agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.sum("n").alias("n"))
    )
    line = write("| {low} to {high} | {n} |", low=fixed("lower", 10), high=fixed("upper", 10))
    head = "\n**Distribution (Histogram):**\n\n| Bin Range | Count |\n|-----------|-------|\n"
    return (
        histogram.selectExpr("column", f"struct(lower, bin_idx, {line} as text) as bin")
        .groupBy("column")
        .agg(F.collect_list("bin").alias("bins"))
        .selectExpr(
            "column",
            write(f"{head}{{body}}", body=r"array_join(array_sort(bins).text, '\n')")
            + " as bin_table",
        )
    )


def _number(name: str) -> str:
    """Whole numbers of integer columns without a decimal point."""
    whole = f"coalesce({name}_exact, cast(cast({name} as bigint) as string))"
    return f"if(type = '{dtypes.INTEGER}', {whole}, {float_text(name)})"


def _category_section() -> str:
    count = "coalesce(categories, cardinality)"
    few = write(
        "Unique categories #: {count}\nCategory distribution: {shown}",
        count=count,
        shown="coalesce(category_list, '{}')",
    )
    many = write(
        "Unique categories #: {count}\nTop categories: {shown} ...\nand {left} more categories",
        count=count,
        shown="coalesce(category_list, '{}')",
        left=f"coalesce(categories, 0) - {TOP_CATEGORIES}",
    )
    return f"coalesce(if({count} < {TOP_CATEGORIES}, {few}, {many}), '')"


def _numeric_section() -> str:
    four = {
        name: fixed(name, 4)
        for name in ("mean", "median", "std", "q1", "q3", "skewness", "kurtosis")
    }
    return lines(
        "\n",
        write("Range: {min} to {max}", min=_number("min"), max=_number("max")),
        write("Mean: {mean}, Median: {median}", **four),
        write("Std Dev: {std}", **four),
        write("Q1: {q1}, Q3: {q3}", **four),
        write("Skewness: {skewness}, Kurtosis: {kurtosis}", **four),
    )


def _temporal_section() -> str:
    return lines(
        "\n",
        write("Range: {temporal_min} to {temporal_max}"),
        write("Time span: {span}", span=span_text("temporal_diff_seconds")),
    )


def temporal_span_text(stats: DataFrame) -> DataFrame:
    """Span of every temporal column in words."""
    return stats.selectExpr("column", f"{span_text('temporal_diff_seconds')} as span")


def column_report(
    columns: DataFrame,
    categories: DataFrame,
    histogram: DataFrame,
    sections: Collection[str] | None = None,
) -> DataFrame:
    """``(column, info)``: what the profile says about each column.

    ``columns`` is a column profile, ``categories`` the listed categories
    (``top_categories``) and ``histogram`` the bins of the numeric columns.
    With ``sections`` the lines about other parts of the profile are left out.
    """

    def of(section: str, line: str) -> str:
        return line if sections is None or section in sections else "string(null)"

    role = "case when is_target then ' (Target Variable)' when is_feature then ' (Feature)' else '' end"
    missing = write(
        "Missing values: {missing_count} ({percent}%)",
        percent=fixed("(missing_rate * 100)", 2),
    )
    # With a shortened category list the bins would say nothing more.
    shortened = f"coalesce(is_categorical and categories >= {TOP_CATEGORIES}, false)"
    has_span = "temporal_min is not null and temporal_max is not null"
    info = lines(
        "  \n",
        write("## Analysis of column: {column}"),
        write("**Type**: {type}{role}", role=role),
        of("missing", f"if(missing_rate > 0, {missing}, 'No missing values')"),
        of("histogram", f"if(is_categorical, {_category_section()}, null)"),
        of("numeric", f"if(is_numeric, {_numeric_section()}, null)"),
        of("histogram", f"if(is_numeric and not {shortened}, bin_table, null)"),
        of("temporal", f"if(is_temporal and {has_span}, {_temporal_section()}, null)"),
    )
    return (
        columns.join(category_lists(categories), "column", "left")
        .join(bin_tables(histogram), "column", "left")
        .selectExpr("column", f"{info} as info")
    )


def target_summary(columns: DataFrame) -> DataFrame:
    """One line about the target column; no row without a target."""
    classes = write(
        "Target '{column}' is categorical with {classes} classes.",
        classes="coalesce(cardinality, 0)",
    )
    values = {
        "mean": float_text("mean"),
        "std": float_text("std"),
        "min": _number("min"),
        "max": _number("max"),
    }
    numbers = write(
        "Target '{column}' is numeric. Mean: {mean}, Std: {std}, Min: {min}, Max: {max}.",
        **{name: f"coalesce({value}, 'None')" for name, value in values.items()},
    )
    other = write("Target '{column}' type: {type}.")
    return columns.filter("is_target").selectExpr(
        "column",
        f"case when is_categorical then {classes} when is_numeric then {numbers} "
        f"else {other} end as summary",
    )


def _where(condition: str, name: str) -> str:
    """Names of the profiled columns that meet a condition, in profile order."""
    members = f"collect_list(if({condition}, struct(position, column), null))"
    return f"array_sort({members}).column as {name}"


def table_profile(columns: DataFrame, num_rows: int, num_cols: int) -> DataFrame:
    """One row about the table: its shape and lists of column names."""
    return columns.selectExpr(
        f"bigint({num_rows}) as num_rows",
        f"int({num_cols}) as num_cols",
        *(
            _where(f"type = '{kind}'", f"{label}_cols")
            for kind, label in TYPE_LABELS.items()
        ),
        _where("missing_count > 0", "missing_cols"),
        _where(f"missing_rate > {HIGH_MISSING_RATE}D", "high_missing_cols"),
        _where(f"cardinality > {HIGH_CARDINALITY}", "high_cardinality_cols"),
        _where("cardinality = 1", "constant_cols"),
        "max(if(is_target, column, null)) as target",
        _where("is_feature", "features"),
        "map_from_entries(collect_list(struct(column, "
        "coalesce(nullif(cardinality, 0), -1)))) as cardinality",
    )


def _listing(text: str, names: str) -> str:
    """A line that lists columns; null if there are none."""
    line = write(text, names=f"array_join({names}, ', ')")
    return f"if(size({names}) > 0, {line}, null)"


def _shape_section() -> str:
    counts = (
        f"if(size({label}_cols) > 0, concat(size({label}_cols), ' {label}'), null)"
        for label in TYPE_LABELS.values()
    )
    return write(
        "## DataFrame Shape\nRows: {num_rows}, Columns: {num_cols} ({types})",
        types=lines(", ", *counts),
    )


def _missing_section() -> str:
    some = write(
        "{count} columns have missing values: {names}.",
        count="size(missing_cols)",
        names="array_join(missing_cols, ', ')",
    )
    many = _listing(
        f"Columns with >{HIGH_MISSING_RATE * 100:.1f}% missing:{{names}}.",
        "high_missing_cols",
    )
    found = lines("\n", some, many)
    return f"if(size(missing_cols) = 0, 'No missing values detected.', {found})"


def _cardinality_section() -> str:
    return lines(
        "\n",
        _listing(
            f"Columns with high cardinality (>{HIGH_CARDINALITY}): {{names}}.",
            "high_cardinality_cols",
        ),
        _listing("Constant columns (single unique value): {names}.", "constant_cols"),
    )


def correlation_text(correlation: DataFrame) -> DataFrame:
    """One row that lists the strongly correlated pairs, strongest first, equal ones by position."""
    limit = f"(|r| >= {STRONG_CORRELATION})"
    strong = f"abs(r) >= {STRONG_CORRELATION}D and not isnan(r) and pos_1 < pos_2"
    line = write("\n- {col_1} & {col_2}: r = {r}", r=fixed("r", 2))
    entry = f"struct(-round(abs(r), {RANKED_DIGITS}) as by, pos_1, pos_2, {line} as text)"
    none = write(f"No strongly correlated feature pairs {limit}.")
    some = write(
        f"Strongly correlated feature pairs {limit}:{{found}}",
        found="array_join(strong, '')",
    )
    return correlation.selectExpr(
        "count(1) as pairs",
        f"array_sort(collect_list(if({strong}, {entry}, null))).text as strong",
    ).selectExpr(
        "case when pairs = 0 then 'No correlation matrix available.' "
        f"when size(strong) = 0 then {none} else {some} end as correlation_text"
    )


def table_report(
    table: DataFrame,
    columns: DataFrame,
    correlation: DataFrame,
    sections: Collection[str] | None = None,
) -> DataFrame:
    """``info``: shape, missing values, target, correlations and cardinality.

    All inputs are profile frames, ``table`` with one row. With ``sections``
    the paragraphs about other parts of the profile are left out.
    """

    def of(section: str, part: str) -> str:
        return part if sections is None or section in sections else "string(null)"

    target = target_summary(columns).selectExpr("max(summary) as target_summary")
    pairs = correlation_text(correlation)
    parts = [
        _shape_section(),
        of("missing", _missing_section()),
        of("types", "target_summary"),
        of("correlation", "correlation_text"),
        of("types", _cardinality_section()),
    ]
    info = lines("\n\n", *(f"nullif({part}, '')" for part in parts))
    # Both texts are one value each, which Spark computes ahead as subqueries.
    return (
        table.withColumns(
            {"target_summary": target.scalar(), "correlation_text": pairs.scalar()}
        )
        .selectExpr(f"{info} as info")
    )


def missing_rate_markdown(columns: DataFrame) -> DataFrame:
    """Markdown table of the columns with missing values and their rates."""
    line = write("\n| {column} | {rate}% |", rate=fixed("(missing_rate * 100)", 4))
    entry = f"if(missing_rate > 0, struct(position, {line} as text), null)"
    head = "| Column | Missing Rate |\n| ------ | ----------- |"
    none = sql_text("\n| No missing values found | 0% |")
    return columns.selectExpr(
        f"array_sort(collect_list({entry})).text as found"
    ).selectExpr(
        write(f"{head}{{body}}", body=f"if(size(found) > 0, array_join(found, ''), {none})")
        + " as missing_table"
    )
