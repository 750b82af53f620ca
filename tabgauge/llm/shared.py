"""Tables in, and intermediate data in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own only where none is set on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='llm-')}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A path that nothing has used yet."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(frame: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = frame.sparkSession
    path = new_folder(spark, what)
    frame.write.parquet(path, **options)
    return spark.read.schema(frame.schema).parquet(path)


#: What a worker process keeps for its later tasks.
_kept: dict = {}


def per_worker(owner: str, key, make):
    """``make()``, kept by the worker process for later tasks of ``owner`` with this ``key``; an owner has one at a time."""
    if owner not in _kept or _kept[owner][0] != key:
        _kept.pop(owner, None)
        _kept[owner] = (key, make())
    return _kept[owner][1]


def release() -> None:
    """Give back what earlier operators left in a worker process, which Spark reuses; for the start of a task."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def filesystem(uri: str):
    """The Arrow file system of a URI, and the path in it. For use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bucket(column, buckets: int):
    """CRC-32 of the value as text, modulo ``buckets``; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))
