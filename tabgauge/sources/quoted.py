"""CSV records whose quoted values hold line breaks, read by many tasks a file.

Whether a line break ends a record depends on the number of quotes before it in the file. A first scan
counts the quotes of every split; sums over the splits of a file, which are few, tell which splits begin inside
quotes. A second scan then puts the lines of each split together to records. Only what a split
boundary cuts in two is shuffled: at most two pieces a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINES = ("value", "path", "split")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines up to each line feed, with their file and where their split begins."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.selectExpr("value", "_metadata.file_path as path", "_metadata.file_block_start as split")


def _inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside quotes. Only those come to the driver."""
    quotes = "sum(length(value) - length(replace(value, '\\\"', '')))"
    per_split = lines.groupBy("path", "split").agg(F.expr(quotes).alias("quotes"))
    before = "coalesce(sum(quotes) over (partition by path order by split rows between unbounded preceding and 1 preceding), 0)"
    odd = per_split.selectExpr("path", "split", f"{before} as before").filter("before % 2 = 1")
    return {(r["path"], r["split"]) for r in odd.collect()}


def records(spark: SparkSession, path: str) -> DataFrame:
    """``value, path, start, first``: one row per record, ``first`` marking the first of its file."""
    lines = _lines(spark, path)
    inside = _inside(lines)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, odd, at, whole = None, [], False, 0, False
        out: list[tuple] = []

        def close(ended: bool) -> None:
            # A piece that began before the split, or goes on after it, is put together later.
            if parts:
                out.append(("\n".join(parts), *now, at, whole, ended))

        for batch in batches:
            for value, *place in zip(*(batch.column(c).to_pylist() for c in _LINES), strict=True):
                if tuple(place) != now:
                    close(False)
                    now = tuple(place)
                    odd, at, parts = now in inside, 0, []
                    whole = not odd
                parts.append(value)
                odd ^= value.count('"') % 2 == 1
                if not odd:
                    close(True)
                    at, parts, whole = at + 1, [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
                out = []
        close(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    found = lines.mapInArrow(split, "value string, path string, split bigint, place bigint, whole boolean, ended boolean")
    # The pieces of a cut record follow each other; it begins where a piece is whole at its start.
    order = "partition by path order by split, place"
    cut = found.filter("not (whole and ended)").selectExpr("*", f"sum(int(whole)) over ({order} rows unbounded preceding) as record")
    joined = cut.groupBy("path", "record").agg(
        F.sort_array(F.collect_list(F.struct("split", "place", "value"))).alias("pieces"), F.min("split").alias("split"), F.min_by("place", F.struct("split", "place")).alias("place")
    )
    stitched = joined.selectExpr("array_join(pieces.value, '\\n') as value", "path", "split", "place")
    rows = found.filter("whole and ended").select("value", "path", "split", "place").unionByName(stitched)
    # A carriage return before the line feed that ends a record is part of the line end; in a
    # file with such ends Spark's parser shows those inside quotes as line feeds too.
    return rows.selectExpr(
        "if(endswith(value, '\\r'), replace(left(value, length(value) - 1), '\\r\\n', '\\n'), value) as value", "path", "split", "place", "split = 0 and place = 0 as first"
    )


_NAMES = ["value", "path", "split", "place", "whole", "ended"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
