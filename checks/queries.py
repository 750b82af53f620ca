"""Every operator as a query over whole tables, with floats rounded to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tabgauge as tg
from checks.inputs import TABLES, lines, precise, signals, table
from tabgauge.functions.frames import union_all
from tabgauge.operators import histogram as hist
from tabgauge.operators.quantiles import QUANTILES
from tabgauge.operators.report import correlation_text
from tabgauge.operators.sketches import SKETCH_SIZE, rank_error
from tabgauge.operators.states import DISTINCT_ERROR

Query = Callable[[SparkSession, str], DataFrame]

# Columns of the views that the numeric queries use.
LINE_NUMBERS = [
    "l_orderkey", "l_linenumber", "l_quantity", "double_quantity", "discount_gap", "tax_gap", "low_var", "constant", "all_missing"
]
SIGNAL_NUMBERS = ["event_id", "user_id", "value", "value_gap", "value_nan", "value_inf", "value_far"]

# Fields of an estimated profile that are exact.
ESTIMATED_FIELDS = (
    "column", "type", "row_count", "missing_count", "missing_rate", "inf_count", "min", "max", "min_exact", "max_exact", "mean", "std",
    "char_length_min", "char_length_max", "char_length_mean", "char_length_std", "temporal_min", "temporal_max",
    "temporal_diff_seconds", "has_low_variation",
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles of a result, so that the order of sums does not show."""
    return df.selectExpr(
        *(
            f"round(`{name}`, {digits}) as `{name}`" if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        )
    )


def load_shape(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(
        [
            tg.table_shape(table(spark, sf, name)).select(
                F.lit(name).alias("table_name"), "num_rows", "num_cols"
            )
            for name in TABLES
        ]
    )


def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    roles = tg.column_roles(df, target="o_totalprice")
    return roles.join(tg.cardinality(df), "column").selectExpr(
        "column",
        "position",
        "is_target",
        "is_feature",
        "coalesce(nullif(cardinality, 0), -1) as cardinality",
    )


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.column_types(lines(spark, sf)))


def columns_by_type(spark: SparkSession, sf: str) -> DataFrame:
    types = tg.columns_by_type(tg.column_types(lines(spark, sf)))
    return types.selectExpr("type", "array_join(columns, ',') as columns")


def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tg.type_counts(tg.column_types(lines(spark, sf)))


def cardinality(spark: SparkSession, sf: str) -> DataFrame:
    found = [tg.cardinality(view(spark, sf)) for view in (lines, signals)]
    return rounded(union_all(found))


def cardinality_documents(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.cardinality(table(spark, sf, "documents")))


def cardinality_flags(spark: SparkSession, sf: str) -> DataFrame:
    return tg.cardinality_flags(tg.cardinality(lines(spark, sf)))


def drop_missing(spark: SparkSession, sf: str) -> DataFrame:
    return tg.drop_missing(signals(spark, sf), "value_nan").select(
        "event_id", "user_id", "value_nan"
    )


def inf_count(spark: SparkSession, sf: str) -> DataFrame:
    return tg.missing_counts(signals(spark, sf)).select("column", "inf_count")


def keep_infinite(spark: SparkSession, sf: str) -> DataFrame:
    return tg.keep_infinite(signals(spark, sf), "value_inf").selectExpr(
        "event_id", "value_inf > 0 as is_positive"
    )


def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = [tg.missing_counts(view(spark, sf)) for view in (lines, signals)]
    return rounded(union_all(counts))


def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tg.missing_columns(tg.missing_counts(lines(spark, sf)))


def high_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.high_missing_columns(tg.missing_counts(lines(spark, sf))))


def missing_rate_table(spark: SparkSession, sf: str) -> DataFrame:
    return tg.missing_rate_table(tg.missing_counts(lines(spark, sf)))


def missing_rate_markdown(spark: SparkSession, sf: str) -> DataFrame:
    profile = tg.profile_table(lines(spark, sf), sections={"missing"})
    return tg.missing_rate_markdown(profile.columns)


def all_missing_defaults(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf).selectExpr(
        "all_missing",
        "cast(all_missing as string) as no_text",
        "cast(all_missing as boolean) as no_flag",
        "cast(cast(all_missing as string) as date) as no_date",
    )
    return tg.data_quality(df)


def numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        union_all(
            [
                tg.numeric_stats(table(spark, sf, "lineitem")),
                tg.numeric_stats(lines(spark, sf), LINE_NUMBERS),
                tg.numeric_stats(signals(spark, sf), SIGNAL_NUMBERS),
            ]
        )
    )


def numeric_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        union_all(
            [
                tg.numeric_moments(table(spark, sf, "lineitem")),
                tg.numeric_moments(signals(spark, sf), SIGNAL_NUMBERS),
            ]
        )
    )


def numeric_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        union_all(
            [
                tg.numeric_quantiles(table(spark, sf, "lineitem")),
                tg.numeric_quantiles(lines(spark, sf), LINE_NUMBERS),
                tg.numeric_quantiles(signals(spark, sf), SIGNAL_NUMBERS),
            ]
        )
    )


def numeric_stats_exact(spark: SparkSession, sf: str) -> DataFrame:
    return tg.numeric_stats(precise(spark, sf)).select("column", "min_exact", "max_exact")


def quantiles_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each estimate lies between the exact quantiles three bounds below and above its share."""
    reach = 3 * rank_error(SKETCH_SIZE)
    found = []
    for df, columns in ((table(spark, sf, "lineitem"), None), (signals(spark, sf), SIGNAL_NUMBERS)):
        near = tg.numeric_quantiles(df, columns, approx=True)
        # The exact ends of all intervals come from one call, which reads the table as often as for one of them.
        ends = {f"low_{k}": s - reach for k, s in QUANTILES.items()} | {f"high_{k}": s + reach for k, s in QUANTILES.items()}
        both = near.join(tg.numeric_quantiles(df, columns, ends), "column")
        found.append(both.selectExpr("column", *(f"{k} between low_{k} and high_{k} as {k}_close" for k in QUANTILES)))
    return union_all(found)


def profile_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """What is exact in an estimated profile, and whether distinct values are within five standard errors."""
    found = []
    for df in (lines(spark, sf), signals(spark, sf)):
        near = tg.profile_table(df, approx=True).columns
        counted = tg.cardinality(df).select("column", F.col("cardinality").alias("counted"))
        close = f"abs(cardinality - counted) <= {5 * DISTINCT_ERROR} * counted as cardinality_close"
        found.append(near.join(counted, "column").selectExpr(*ESTIMATED_FIELDS, close))
    return rounded(union_all(found), 4)


def frequent_values(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(
        [
            tg.frequent_values(lines(spark, sf)),
            tg.frequent_values(table(spark, sf, "documents"), ["lang", "source"]),
        ]
    )


def data_quality_given(spark: SparkSession, sf: str) -> DataFrame:
    df = signals(spark, sf)
    given = tg.numeric_stats(df).filter("column <> 'value_gap'").selectExpr(
        "column", "round(mean) as mean", "if(column = 'user_id', null, round(std) / 2) as std"
    )
    return rounded(tg.data_quality(df, stats=given))


def string_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        union_all(
            [
                tg.string_length_stats(table(spark, sf, name))
                for name in ("documents", "pages", "customer")
            ]
            + [tg.string_length_stats(lines(spark, sf), ["flag_gap"])]
        )
    )


def temporal_stats(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(
        [
            tg.temporal_stats(table(spark, sf, "orders")),
            tg.temporal_stats(lines(spark, sf)),
            tg.temporal_stats(signals(spark, sf)),
        ]
    )


def temporal_span_text(spark: SparkSession, sf: str) -> DataFrame:
    return tg.temporal_span_text(temporal_stats(spark, sf))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tg.sorted_counts(tg.value_counts(lines(spark, sf)))


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    counts = [
        tg.value_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]),
        tg.value_counts(lines(spark, sf), ["flag_gap", "l_quantity"]),
    ]
    return tg.top_categories(union_all(counts))


def low_variation_numeric(spark: SparkSession, sf: str) -> DataFrame:
    found = tg.outliers_zscore(lines(spark, sf))
    return found.select("column", "has_low_variation")


def low_variation_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return tg.low_variation_boolean(lines(spark, sf))


def low_variation_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return tg.low_variation_categorical(lines(spark, sf))


def low_variation_temporal(spark: SparkSession, sf: str) -> DataFrame:
    found = tg.outliers_iqr_temporal(lines(spark, sf))
    return found.select("column", "has_low_variation")


def outliers_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        union_all(
            [
                tg.outliers_zscore(table(spark, sf, "lineitem"), zscore=1.5),
                tg.outliers_zscore(signals(spark, sf), SIGNAL_NUMBERS),
            ]
        )
    )


def outliers_zscore_given(spark: SparkSession, sf: str) -> DataFrame:
    df = signals(spark, sf)
    given = tg.numeric_stats(df, SIGNAL_NUMBERS).selectExpr(
        "column", "round(mean) as mean", "round(std) / 2 as std"
    )
    return rounded(tg.outliers_zscore(df, SIGNAL_NUMBERS, stats=given))


def outliers_iqr_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        union_all(
            [
                tg.outliers_iqr_temporal(lines(spark, sf)),
                tg.outliers_iqr_temporal(signals(spark, sf)),
            ]
        )
    )


def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.data_quality(lines(spark, sf)))


def _bins(found: DataFrame) -> DataFrame:
    return found.select("column", "bin_idx", "bin_key", "n")


def histogram_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return _bins(
        union_all(
            [
                tg.histogram_numeric(table(spark, sf, "lineitem")),
                tg.histogram_numeric(signals(spark, sf), ["value_nan", "value_inf"]),
            ]
        )
    )


def histogram_custom_bins(spark: SparkSession, sf: str) -> DataFrame:
    def square_root(value: F.Column) -> F.Column:
        return F.ceil(F.sqrt(F.count(value)))

    df = table(spark, sf, "events")
    return _bins(tg.histogram_numeric(df, ["user_id", "value"], square_root))


def histogram_sturges(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    return _bins(tg.histogram_numeric(df, ["o_custkey", "o_totalprice"], hist.STURGES))


def _bin_rule(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    found = []
    for df, columns in (
        (table(spark, sf, "lineitem"), None),
        (signals(spark, sf), SIGNAL_NUMBERS),
    ):
        bins = tg.histogram_numeric(df, columns, rule)
        found.append(bins.groupBy("column").agg((F.count("*") - 2).alias("bins")))
    return union_all(found)


def bins_sturges(spark: SparkSession, sf: str) -> DataFrame:
    return _bin_rule(spark, sf, hist.STURGES)


def bins_freedman_diaconis(spark: SparkSession, sf: str) -> DataFrame:
    return _bin_rule(spark, sf, hist.FREEDMAN_DIACONIS)


def histogram_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return tg.histogram_categorical(table(spark, sf, "orders"))


def histogram_all(spark: SparkSession, sf: str) -> DataFrame:
    return tg.histogram_all(table(spark, sf, "lineitem"))


def pearson_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.pearson_long(table(spark, sf, "lineitem")))


def pearson_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.pearson_long(lines(spark, sf)).select("col_1", "col_2", "r"))


def pearson_signals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.pearson_long(signals(spark, sf)))


def pearson_propagate(spark: SparkSession, sf: str) -> DataFrame:
    found = tg.pearson_long(lines(spark, sf), missing="propagate")
    return rounded(found.select("col_1", "col_2", "r"))


def pearson_wide(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part")
    names = ["p_partkey", "p_size", "p_retailprice"]
    return rounded(tg.pearson_wide(tg.pearson_long(df, names), names))


def pearson_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = tg.pearson_long(table(spark, sf, "lineitem"))
    return rounded(tg.pearson_lookup(found, "l_quantity", "l_extendedprice"))


def strong_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tg.strong_correlations(tg.pearson_long(lines(spark, sf))))


def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    profile = tg.profile_table(table(spark, sf, "lineitem"), target="l_quantity")
    return rounded(profile.columns.drop("info"))


def profile_gaps(spark: SparkSession, sf: str) -> DataFrame:
    profile = tg.profile_table(lines(spark, sf))
    return rounded(profile.columns.drop("info"))


def profile_column(spark: SparkSession, sf: str) -> DataFrame:
    found = tg.profile_column(table(spark, sf, "orders"), "o_totalprice", is_target=True)
    return rounded(found.drop("info"))


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = tg.profile_table(
        lines(spark, sf), target="is_returned", sections={"types", "missing"}
    )
    lists = [name for name, kind in profile.table.dtypes if kind == "array<string>"]
    return profile.table.selectExpr(
        "num_rows", "num_cols", "target", *(f"array_join({n}, ',') as {n}" for n in lists)
    )


def column_report(spark: SparkSession, sf: str) -> DataFrame:
    reports = [
        tg.profile_table(table(spark, sf, "lineitem"), target="l_linestatus"),
        tg.profile_table(lines(spark, sf).select("flag_gap", "is_returned", "ship_date")),
    ]
    return union_all([p.columns.select("column", "info") for p in reports])


def table_report(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf)
    return tg.profile_table(df, target="is_returned").table.select("info")


def correlation_section(spark: SparkSession, sf: str) -> DataFrame:
    return correlation_text(tg.pearson_long(lines(spark, sf)))


def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = []
    for name, target in (
        ("lineitem", "l_returnflag"),
        ("lineitem", "l_shipdate"),
        ("orders", "o_custkey"),
        ("orders", "o_totalprice"),
    ):
        profile = tg.profile_table(
            table(spark, sf, name),
            target=target,
            features=[],
            sections={"types", "numeric"},
        )
        found.append(tg.target_summary(rounded(profile.columns, 2)))
    return union_all(found)


def registered() -> dict[str, Query]:
    """Queries by name."""
    return {
        query.__name__: query
        for query in (
            load_shape,
            column_roles,
            column_types,
            columns_by_type,
            type_counts,
            cardinality,
            cardinality_documents,
            cardinality_flags,
            drop_missing,
            inf_count,
            keep_infinite,
            missing_counts,
            missing_columns,
            high_missing_columns,
            missing_rate_table,
            missing_rate_markdown,
            all_missing_defaults,
            numeric_stats,
            numeric_stats_exact,
            numeric_moments,
            numeric_quantiles,
            quantiles_estimated,
            string_length_stats,
            temporal_stats,
            temporal_span_text,
            value_counts,
            top_categories,
            frequent_values,
            low_variation_numeric,
            low_variation_boolean,
            low_variation_categorical,
            low_variation_temporal,
            outliers_zscore,
            outliers_zscore_given,
            outliers_iqr_temporal,
            data_quality,
            data_quality_given,
            histogram_numeric,
            histogram_custom_bins,
            histogram_sturges,
            bins_sturges,
            bins_freedman_diaconis,
            histogram_categorical,
            histogram_all,
            pearson_long,
            pearson_gaps,
            pearson_signals,
            pearson_propagate,
            pearson_wide,
            pearson_lookup,
            strong_correlations,
            profile_table,
            profile_gaps,
            profile_column,
            profile_estimated,
            table_profile,
            column_report,
            table_report,
            correlation_section,
            target_summary,
        )
    }
