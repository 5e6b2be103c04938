"""Ranks of rows in an order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch


def ranked(df: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order`` within each value of ``group``) and ``total`` (rows of the group).

    Rows are dealt into ranges of (group, order) and stored with the number of their range, so that no
    later reading deals them otherwise. What lies before a range within its group is a running sum over
    one small row for each group and range; within a range rows are numbered by themselves. A group that
    holds most rows is many ranges. ``group`` must not be null; nulls come first in ``order``. Rows equal
    in all of ``order`` get ranks in any order: the caller orders by all that tells them apart.
    """
    ranges = scratch.put(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    starts = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return ranges.join(starts, [group, "_range"]).withColumn("rank", F.col("_start") + within - 1).drop("_range", "_start")
