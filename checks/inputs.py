"""Tables the queries read, as SQL that Spark and DuckDB both understand.

The given tables hold no nulls, NaN, infinities, booleans or dates. Two views
over the whole of ``lineitem`` and ``events`` add columns that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

LINES = """
select
  l_orderkey, l_linenumber, l_quantity,
  l_quantity * 2 as double_quantity,
  nullif(l_discount, 0.0) as discount_gap,
  case when l_linenumber < 4 then null else l_tax end as tax_gap,
  l_discount * 0.01 as low_var,
  1 as constant,
  nullif(l_tax, l_tax) as all_missing,
  l_returnflag = 'R' as is_returned,
  l_linenumber > 0 as is_line,
  case when l_linenumber = 3 then null else l_returnflag end as flag_gap,
  case when l_linenumber = 7 then 'b' else 'a' end as dominant,
  l_linestatus,
  cast(l_shipdate as date) as ship_date,
  case when l_linenumber = 2 then null else l_shipdate end as ship_gap,
  cast('2020-02-29' as date) as one_day
from lineitem
"""

# Whole numbers that no double holds, and decimals.
PRECISE = """
select l_orderkey * 2 + 9007199254740993 as far_key, -l_partkey - 4611686018427387904 as low_key,
  cast(l_extendedprice as decimal(14, 2)) as price from lineitem
"""

SIGNALS = """
select
  event_id, user_id, ts, event_type, value,
  case when event_id % 7 = 0 then null else value end as value_gap,
  case when event_id % 11 = 0 then cast('NaN' as double)
       when event_id % 7 = 0 then null else value end as value_nan,
  case when event_id % 500 = 0 then cast('Infinity' as double)
       when event_id % 750 = 0 then cast('-Infinity' as double)
       else value end as value_inf,
  case when event_id % 900 = 0 then value * 1000 else value end as value_far,
  case when user_id = 3 then cast('1990-05-05' as date)
       else cast(ts as date) end as day_far
from events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with gaps, constants, booleans and dates."""
    return spark.sql(
        LINES.replace("from lineitem", "from {source}"),
        source=table(spark, sf_dir, "lineitem"),
    )


def precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of ``lineitem`` that need all their digits."""
    return spark.sql(
        PRECISE.replace("from lineitem", "from {source}"),
        source=table(spark, sf_dir, "lineitem"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with gaps, NaN, infinities and far values."""
    return spark.sql(
        SIGNALS.replace("from events", "from {source}"),
        source=table(spark, sf_dir, "events"),
    )
