"""Numbers of rows in a global order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch

_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def placed(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """`df` sorted by range and written once, with `_part` and `_pos`: the range of a row and its place there.

    `df` is read twice (range bounds come from a sample), so it should be a stored table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("_pos", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_pos", _BITS)).withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << _BITS) - 1)))
    return scratch.put(rows, name)


def ranked(rows: DataFrame, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rows of `placed` with their rank from 0 within `group` (columns that lead its order; none: over all rows).

    What is sent to every task has a row for each range and group of a range: groups are sorted, so there are at most as
    many as ranges and groups together.
    """
    group = group or []
    counts = rows.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_pos").alias("_least"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_ahead"))
    out = rows.join(F.broadcast(counts), ["_part", *group])
    return out.withColumn(name, F.col("_pos") + F.col("_ahead")).drop("_part", "_pos", "_ahead")
