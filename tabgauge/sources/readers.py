"""Load the table to profile."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DateType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tabgauge.sources import quoted


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    *,
    multi_line: bool = False,
    split_files: bool = False,
    dates_as_text: bool = False,
) -> DataFrame:
    """Read a CSV file or folder with a header line; quotes are doubled inside quotes.

    Types are inferred, which takes one more pass over the files. Give
    ``schema`` to skip that pass on large inputs. ``multi_line`` allows line
    breaks inside quotes; Spark then reads each file in one task. With ``split_files``
    too many tasks read a file, for one more pass; quotes must then stand around whole values or
    be doubled inside, and lines end with a line feed. ``dates_as_text`` leaves inferred dates
    and timestamps as text.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line)
    source: str | DataFrame = path
    if multi_line and split_files:
        found = quoted.records(spark, path)
        header = found.filter("first").select("value").first()
        if header is None:
            return reader.schema(schema or StructType()).csv(path)
        # The header of each file goes; names come from one of them.
        names = next(csv.reader([header["value"]]))
        source = found.filter("not first and value <> ''").select("value")
        reader = reader.options(header=False, multiLine=True)
        if schema is None:
            kinds = _csv(spark, reader.option("inferSchema", True), source).schema.fields
            kinds += [StructField(n, StringType()) for n in names[len(kinds) :]]
            schema = StructType([StructField(n, k.dataType) for n, k in zip(names, kinds, strict=True)])
            if dates_as_text:
                schema = _without_times(schema)
        return _csv(spark, spark.read.options(quote='"', escape='"', multiLine=True).schema(schema), source)
    if schema is not None:
        return reader.schema(schema).csv(path)
    found = reader.option("inferSchema", True).csv(path)
    if not dates_as_text:
        return found
    return reader.schema(_without_times(found.schema)).csv(path)


def _without_times(schema: StructType) -> StructType:
    times = (DateType, TimestampType, TimestampNTZType)
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, times) else f.dataType) for f in schema.fields])


def _csv(spark: SparkSession, reader, source: DataFrame) -> DataFrame:
    """Spark's own parser over records that are rows already."""
    text = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(reader._jreader.csv(getattr(source._jdf, "as")(text)), spark)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet; the files carry their types."""
    return spark.read.parquet(path)
