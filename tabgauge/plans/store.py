"""Profiles of growing data: states of columns are kept per file, and only new files are read.

The store is a Parquet folder with one row per file and column. A file counts as known while its
path, size and time of change are; states of files that are gone stay unused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions import dtypes
from tabgauge.functions.tasks import FAN
from tabgauge.operators.quality import VARIANCE_THRESHOLD, ZSCORE_THRESHOLD, check_thresholds
from tabgauge.operators.states import STATE_KINDS, estimates, merged, states_by, whole_states
from tabgauge.plans.profile import SECTIONS, Profile, estimated_profile

_FILE = ["path", "size", "changed"]


@dataclass(frozen=True)
class StoredProfile:
    """A profile, and how many of its files were read for it."""

    profile: Profile
    files: int
    read: int


def profile_files(
    spark: SparkSession,
    paths: Sequence[str],
    store: str,
    read: Callable[[list[str]], DataFrame] | None = None,
    target: str | None = None,
    features: Sequence[str] | None = None,
    *,
    zscore: float = ZSCORE_THRESHOLD,
    variance: float = VARIANCE_THRESHOLD,
    bins: int | str | None = None,
    declared: dict[str, str] | None = None,
) -> StoredProfile:
    """Estimated profile (see ``profile_table(approx=True)``) of all files under ``paths``.

    ``read`` makes a frame of a list of files, by default as Parquet; rows must keep their file,
    so it may change columns but not shuffle. Files that ``store`` has no states of are read
    once and their states added; nothing else is scanned. All files have the columns of the first profile,
    else ``ValueError`` is raised. Correlations, which do not add up over files, are left out.
    """
    check_thresholds(zscore, variance)
    listed = _files(spark, paths)
    # Paths of all files come to the driver, as they do for any scan.
    now = {tuple(r) for r in listed.collect()}
    if not now:
        raise ValueError(f"No files under {', '.join(paths)}.")
    reader = read or (lambda files: spark.read.parquet(*files))
    kept = _states(spark, store)
    known = set() if kept is None else {tuple(r) for r in kept.select(*_FILE).distinct().collect()}
    new = sorted(now - known)
    frame = reader([f[0] for f in new] or [min(now)[0]])
    columns = frame.columns
    if new:
        _add(frame, columns, listed, store)
        kept = _states(spark, store)
    held = {r["column"] for r in kept.select("column").distinct().collect()}
    if held != set(columns):
        raise ValueError(f"The store holds other columns: {', '.join(sorted(held ^ set(columns)))}.")
    current = kept.join(listed, _FILE, "left_semi")
    groups = -(-len(now) // FAN)
    parts = current.withColumn("part", F.expr(f"pmod(xxhash64(path), {groups})"))
    whole = whole_states([merged(parts, ["column", "part"])], groups)
    found = estimates([states.drop("part") for states in whole], columns)
    sections = [s for s in SECTIONS if s != "correlation"]
    roles = dtypes.assign_roles(frame, target, features)
    profile = estimated_profile(frame, roles, found, zscore, variance, bins, "pairwise", declared, sections)
    return StoredProfile(profile, len(now), len(new))


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Path, size and time of change of every file; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    named = found.selectExpr(f"{_one_slash('path')} as path", "length as size", "unix_micros(modificationTime) as changed")
    return named.filter("not startswith(element_at(split(path, '/'), -1), '_')")


def _states(spark: SparkSession, store: str) -> DataFrame | None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    kinds = [("path", "string"), ("size", "bigint"), ("changed", "bigint"), ("column", "string"), *STATE_KINDS.items()]
    return spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds)).parquet(store)


def _add(frame: DataFrame, columns: Sequence[str], listed: DataFrame, store: str) -> None:
    """Read the new files and write a state per file and column."""
    # The name of a row's file is written as a URI, unlike the listed paths.
    plain = _one_slash("url_decode(replace(part, '+', '%2B'))")
    for states in states_by(frame, columns, "input_file_name()"):
        rows = states.withColumn("path", F.expr(plain)).join(listed, "path")
        rows.select(*_FILE, "column", *STATE_KINDS).write.mode("append").parquet(store)


def _one_slash(path: str) -> str:
    return f"regexp_replace({path}, '^file:/+', 'file:/')"
