"""Table readers."""

from tabgauge.sources.readers import read_csv, read_parquet

__all__ = ["read_csv", "read_parquet"]
