"""Profile one column or a whole table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.frames import kept, small_frame, union_all
from tabgauge.operators.correlation import PEARSON_SCHEMA, pearson_around
from tabgauge.operators.histogram import HISTOGRAM_SCHEMA, BinRule, grids, histogram_on
from tabgauge.operators.quality import (
    DOMINANT_SHARE,
    VARIANCE_THRESHOLD,
    ZSCORE_THRESHOLD,
    check_thresholds,
    given_stats,
    outliers_around,
    outliers_fenced,
    preferred,
)
from tabgauge.operators.quantiles import QUANTILES
from tabgauge.operators.report import column_report, table_profile, table_report
from tabgauge.operators.states import Estimate, estimates, table_states
from tabgauge.operators.types import is_categorical
from tabgauge.operators.values import TOP_CATEGORIES, top_categories, value_counts
from tabgauge.plans.estimated import CATEGORY_SCHEMA, add_estimates, add_times, categories_of, histogram_of
from tabgauge.plans.facts import Facts

# Parts of a profile that can be asked for one by one.
SECTIONS = (
    "types",
    "missing",
    "numeric",
    "text",
    "temporal",
    "histogram",
    "quality",
    "correlation",
)

COLUMN_FIELDS = {
    "column": "string",
    "position": "int",
    "is_target": "boolean",
    "is_feature": "boolean",
    "type": "string",
    "is_categorical": "boolean",
    "is_numeric": "boolean",
    "is_temporal": "boolean",
    "timezone": "string",
    "row_count": "bigint",
    "missing_count": "bigint",
    "missing_rate": "double",
    "inf_count": "bigint",
    "cardinality": "bigint",
    "unique_rate": "double",
    "min": "double",
    "max": "double",
    "min_exact": "string",
    "max_exact": "string",
    "mean": "double",
    "median": "double",
    "p5": "double",
    "q1": "double",
    "q3": "double",
    "p95": "double",
    "std": "double",
    "skewness": "double",
    "kurtosis": "double",
    "char_length_min": "int",
    "char_length_max": "int",
    "char_length_mean": "double",
    "char_length_std": "double",
    "temporal_min": "string",
    "temporal_max": "string",
    "temporal_diff_seconds": "bigint",
    "outlier_count": "bigint",
    "outlier_rate": "double",
    "has_low_variation": "boolean",
}


class Profile:
    """Frames that describe a table. Each is worked out when first asked for, and never reads the table again.

    ``columns`` has one row per column with its report in ``info``, ``table``
    one row about the table with its report in ``info``. ``categories`` lists
    the categories of the categorical columns, ``histogram`` the bins of the
    other numeric columns, ``correlation`` every pair of numeric columns.
    """

    def __init__(
        self,
        records: DataFrame,
        row_count: int,
        width: int,
        sections: Collection[str],
        categories: Callable[[], DataFrame],
        histogram: Callable[[], DataFrame],
        correlation: Callable[[], DataFrame],
    ) -> None:
        self._records, self._sections = records, set(sections)
        self._table = table_profile(records, row_count, width)
        self._make = {"categories": categories, "histogram": histogram, "correlation": correlation}

    @cached_property
    def categories(self) -> DataFrame:
        return self._make["categories"]()

    @cached_property
    def histogram(self) -> DataFrame:
        return self._make["histogram"]()

    @cached_property
    def correlation(self) -> DataFrame:
        return self._make["correlation"]()

    @cached_property
    def columns(self) -> DataFrame:
        info = column_report(self._records, self.categories, self.histogram, self._sections)
        return self._records.join(info, "column", "left")

    @cached_property
    def table(self) -> DataFrame:
        report = table_report(self._table, self._records, self.correlation, self._sections)
        return self._table.withColumn("info", report.scalar())


def profile_table(
    df: DataFrame,
    target: str | None = None,
    features: Sequence[str] | None = None,
    *,
    zscore: float = ZSCORE_THRESHOLD,
    variance: float = VARIANCE_THRESHOLD,
    bins: BinRule | None = None,
    missing: str = "pairwise",
    declared: Mapping[str, str] | None = None,
    sections: Collection[str] | None = None,
    approx: bool = False,
    stats: DataFrame | None = None,
) -> Profile:
    """Profile the target and the features, by default every column.

    The passes run now; each yields a bounded number of values per column.
    ``sections`` leaves out parts and the passes only they need. ``declared``
    overrides semantic types, ``bins`` sets the histogram rule and
    ``missing`` how correlations treat missing values.

    ``stats`` may give ``(column, mean, std)`` that outliers and low variation of numbers go by.

    ``approx=True`` takes one scan with sketches and one small shuffle for some 20 columns: counts, ranges,
    means and moments stay exact, the rest lies within the bounds of ``operators.states``.
    Correlations, which need a scan of their own, are then left out unless ``sections`` names them.
    """
    if sections is None:
        sections = [s for s in SECTIONS if not (approx and s == "correlation")]
    check_thresholds(zscore, variance)
    if isinstance(bins, int) and bins < 1:
        raise ValueError(f"A histogram needs at least one bin, got {bins}.")
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"Unknown sections: {', '.join(sorted(unknown))}.")
    roles = dtypes.assign_roles(df, target, features)
    if approx:
        names = [role.name for role in roles]
        found = estimates(table_states(df, names), names)
        return estimated_profile(df, roles, found, zscore, variance, bins, missing, declared, sections, given_stats(stats))
    facts = Facts(df, [role.name for role in roles], declared)
    asked = set(sections)
    facts.summarised = _summarised(facts, asked)
    if not asked & {"types", "histogram"}:
        facts.counted = facts.of(*_DOMINATED) if "quality" in asked else []
    records = {
        role.name: _record(df, role, facts.kinds[role.name], facts.row_count) for role in roles
    }
    categorical = _add_types(facts, records) if asked & {"types", "histogram"} else []
    for section, fields in (
        ("missing", ("missing_count", "missing_rate", "inf_count")),
        ("numeric", ("min", "max", "min_exact", "max_exact", "mean")),
        ("text", ("char_length_min", "char_length_max", "char_length_mean", "char_length_std")),
        ("temporal", ("temporal_min", "temporal_max", "temporal_diff_seconds")),
    ):
        if section in sections:
            for name in facts.summarised:
                records[name] |= {field: facts.basics[name][field] for field in fields}
    if "numeric" in sections:
        _add_numbers(facts, records)
    if "quality" in sections:
        _add_quality(facts, records, zscore, variance, given_stats(stats))
    return Profile(
        _frame_of(df, records),
        facts.row_count,
        len(df.columns),
        asked,
        lambda: _categories(facts, categorical, asked),
        lambda: _histogram(facts, categorical, bins, asked),
        lambda: _correlation(facts, missing, asked),
    )


def _record(df: DataFrame, role: dtypes.Role, kind: str, row_count: int) -> dict:
    return {
        "column": role.name,
        "position": role.position,
        "is_target": role.is_target,
        "is_feature": role.is_feature,
        "type": kind,
        "is_numeric": kind in dtypes.NUMERIC,
        "is_temporal": kind in dtypes.TEMPORAL,
        "timezone": dtypes.timezone_of(df, role.name),
        "row_count": row_count,
    }


def _frame_of(df: DataFrame, records: Mapping[str, dict]) -> DataFrame:
    return small_frame(
        df,
        [tuple(r.get(field) for field in COLUMN_FIELDS) for r in records.values()],
        ", ".join(f"{field} {kind}" for field, kind in COLUMN_FIELDS.items()),
    )


def estimated_profile(
    df: DataFrame,
    roles: Sequence[dtypes.Role],
    found: Mapping[str, Estimate],
    zscore: float,
    variance: float,
    bins: BinRule | None,
    missing: str,
    declared: Mapping[str, str] | None,
    sections: Collection[str],
    given: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> Profile:
    """The profile that states of the columns give; only correlations read the table."""
    asked = set(sections)
    facts = Facts(df, [role.name for role in roles], declared)
    records = {role.name: _record(df, role, facts.kinds[role.name], 0) for role in roles}
    categorical = add_estimates(df, records, found, asked, zscore, variance, given or {})
    if "temporal" in asked:
        add_times(df, records, found)
    binned = "histogram" in asked
    numbers = [name for name in facts.numeric if name not in categorical] if binned else []
    if binned and callable(bins):
        raise ValueError("A bin rule that aggregates a column needs an exact profile.")
    row_count = next((r["row_count"] for r in records.values()), 0) if records else df.count()
    return Profile(
        _frame_of(df, records),
        row_count,
        len(df.columns),
        asked,
        lambda: categories_of(df, categorical if binned else [], found),
        lambda: histogram_of(df, numbers, found, bins),
        lambda: _correlation(facts, missing, asked),
    )


def profile_column(
    df: DataFrame, name: str, *, is_target: bool = False, **settings
) -> DataFrame:
    """Profile of one column; takes the settings of ``profile_table``."""
    dtypes.require_columns(df, [name])
    sections = set(settings.pop("sections", None) or SECTIONS) - {"correlation"}
    one = df.select(df[f"`{name.replace('`', '``')}`"])
    profile = profile_table(
        one, target=name if is_target else None, sections=sections, **settings
    )
    return profile.columns


# Types whose low variation is read off the most frequent value.
_DOMINATED = (dtypes.TEXT, dtypes.BOOLEAN, dtypes.CATEGORICAL, dtypes.STRING)


def _summarised(facts: Facts, sections: set[str]) -> list[str]:
    """Columns that the sections need counts, ranges or lengths of."""
    if sections & {"missing", "quality"}:
        return facts.columns
    kinds: set[str] = set()
    if sections & {"numeric", "histogram", "correlation"}:
        kinds |= set(dtypes.NUMERIC)
    if "temporal" in sections:
        kinds |= set(dtypes.TEMPORAL)
    wanted = [n for n in facts.columns if facts.kinds[n] in kinds]
    if "text" in sections:
        # Lengths follow from what a column holds, whatever it was declared to be.
        wanted += [
            n
            for n in facts.columns
            if n not in wanted and dtypes.semantic_type(facts.df.schema[n].dataType) == dtypes.TEXT
        ]
    return [n for n in facts.columns if n in wanted]


def _add_types(facts: Facts, records: Mapping[str, dict]) -> list[str]:
    """Types, flags and cardinality; returns the categorical columns."""
    categorical = []
    for name, record in records.items():
        kind, distinct = facts.kinds[name], facts.distinct[name].cardinality
        record |= {
            "is_categorical": is_categorical(kind, distinct),
            "cardinality": distinct,
            "unique_rate": distinct / facts.row_count if facts.row_count else 0.0,
        }
        if record["is_categorical"]:
            categorical.append(name)
    return categorical


def _add_numbers(facts: Facts, records: Mapping[str, dict]) -> None:
    for name in facts.numeric:
        for field, share in QUANTILES.items():
            records[name][field] = facts.quantile(name, share)
        moments = facts.moments[name]
        for field in ("std", "skewness", "kurtosis"):
            records[name][field] = moments[field]


def _add_quality(
    facts: Facts,
    records: Mapping[str, dict],
    zscore: float,
    variance: float,
    given: Mapping[str, tuple[float | None, float | None]],
) -> None:
    parts = []
    if facts.numeric:
        own = {n: (facts.basics[n]["mean"], facts.moments[n]["std"]) for n in facts.numeric}
        known = preferred(given, own)
        parts.append(outliers_around(facts.df, facts.numeric, known, zscore, variance))
    if facts.temporal:
        quartiles = facts.nearest_quartiles(facts.temporal)
        parts.append(outliers_fenced(facts.df, facts.temporal, facts.basics, quartiles))
    for row in union_all(parts).collect() if parts else []:
        records[row["column"]] |= row.asDict()
    for name in facts.of(*_DOMINATED):
        share = facts.distinct[name].top_count / facts.row_count if facts.row_count else 1.0
        records[name] |= {
            "outlier_count": 0,
            "outlier_rate": 0.0,
            "has_low_variation": share > DOMINANT_SHARE or not facts.valid(name),
        }


def _categories(facts: Facts, categorical: Sequence[str], sections: Collection[str]) -> DataFrame:
    df = facts.df
    if "histogram" not in sections or not categorical:
        return small_frame(df, [], CATEGORY_SCHEMA)
    sizes = small_frame(
        df,
        [(name, facts.distinct[name].cardinality) for name in categorical],
        "column string, categories bigint",
    )
    listed = top_categories(value_counts(df, categorical), sizes=sizes)
    return kept(listed, CATEGORY_SCHEMA, TOP_CATEGORIES * len(categorical))


def _histogram(
    facts: Facts, categorical: Sequence[str], rule: BinRule | None, sections: Collection[str]
) -> DataFrame:
    df = facts.df
    numbers = [name for name in facts.numeric if name not in categorical]
    if "histogram" not in sections or not numbers:
        return small_frame(df, [], HISTOGRAM_SCHEMA)
    quartiles = None if rule is None else facts.nearest_quartiles(numbers)
    found = grids(df, numbers, facts.basics, rule, quartiles)
    return kept(histogram_on(df, found), HISTOGRAM_SCHEMA, sum(g.bins + 2 for g in found))


def _correlation(facts: Facts, missing: str, sections: Collection[str]) -> DataFrame:
    if "correlation" not in sections or not facts.numeric:
        return small_frame(facts.df, [], PEARSON_SCHEMA)
    pairs = pearson_around(facts.df, facts.numeric, facts.basics, missing)
    return kept(pairs, PEARSON_SCHEMA, len(facts.numeric) ** 2)
