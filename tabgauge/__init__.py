"""Profile tables of any size with Spark."""

from tabgauge.operators.correlation import (
    pearson_long,
    pearson_lookup,
    pearson_value,
    pearson_wide,
    strong_correlations,
)
from tabgauge.operators.frequent import frequent_values
from tabgauge.operators.histogram import (
    histogram_all,
    histogram_categorical,
    histogram_numeric,
)
from tabgauge.operators.missing import (
    drop_missing,
    high_missing_columns,
    keep_infinite,
    missing_columns,
    missing_counts,
    missing_rate_table,
)
from tabgauge.operators.quality import (
    data_quality,
    low_variation_boolean,
    low_variation_categorical,
    outliers_iqr_temporal,
    outliers_zscore,
)
from tabgauge.operators.quantiles import numeric_quantiles
from tabgauge.operators.report import (
    column_report,
    missing_rate_markdown,
    table_profile,
    table_report,
    target_summary,
    temporal_span_text,
)
from tabgauge.operators.stats import (
    numeric_moments,
    numeric_stats,
    string_length_stats,
    temporal_stats,
)
from tabgauge.operators.types import (
    column_roles,
    column_types,
    columns_by_type,
    table_shape,
    type_counts,
)
from tabgauge.operators.values import (
    cardinality,
    cardinality_flags,
    sorted_counts,
    top_categories,
    value_counts,
)
from tabgauge.plans.profile import Profile, profile_column, profile_table
from tabgauge.plans.store import StoredProfile, profile_files
from tabgauge.sources import read_csv, read_parquet

__all__ = [
    "Profile",
    "StoredProfile",
    "cardinality",
    "cardinality_flags",
    "column_report",
    "column_roles",
    "column_types",
    "columns_by_type",
    "data_quality",
    "drop_missing",
    "frequent_values",
    "high_missing_columns",
    "histogram_all",
    "histogram_categorical",
    "histogram_numeric",
    "keep_infinite",
    "low_variation_boolean",
    "low_variation_categorical",
    "missing_columns",
    "missing_counts",
    "missing_rate_markdown",
    "missing_rate_table",
    "numeric_moments",
    "numeric_quantiles",
    "numeric_stats",
    "outliers_iqr_temporal",
    "outliers_zscore",
    "pearson_long",
    "pearson_lookup",
    "pearson_value",
    "pearson_wide",
    "profile_column",
    "profile_files",
    "profile_table",
    "read_csv",
    "read_parquet",
    "sorted_counts",
    "string_length_stats",
    "strong_correlations",
    "table_profile",
    "table_report",
    "table_shape",
    "target_summary",
    "temporal_span_text",
    "temporal_stats",
    "top_categories",
    "type_counts",
    "value_counts",
]
