"""How many tasks a frame has, and merging what they hand over in levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one merge takes at most; a table of more tasks takes more levels.
FAN = 64


def tasks_of(df: DataFrame) -> int:
    """Tasks of the stage that makes ``df``, as planned; nothing runs for it."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
        # Not run yet: adaptive execution only lowers what the first plan says, but for skewed joins.
        planned = plan.initialPlan().outputPartitioning().numPartitions()
        return max(planned, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, execution.toRdd().getNumPartitions())


def in_levels(
    states: DataFrame,
    groups: int,
    keys: Sequence[str],
    merge: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Merge rows of ``states`` with equal ``keys`` whose ``part`` lies in ``0..groups - 1``.

    ``merge`` groups a frame by the given columns. No group takes more than ``FAN`` rows
    per value of ``part`` and key, whatever the number of groups.
    """
    while groups > 1:
        states = merge(states.withColumn("part", F.expr(f"part div {FAN}")), [*keys, "part"])
        groups = -(-groups // FAN)
    return states


def by_task(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with ``part``, the number of its group of ``FAN`` tasks, and how many groups there are.

    Tasks beyond the planned ones, as adaptive execution may make of skewed joins, go to the last group.
    """
    groups = -(-tasks_of(df) // FAN)
    return df.withColumn("part", F.expr(f"least(bigint(spark_partition_id() div {FAN}), {groups - 1}L)")), groups
