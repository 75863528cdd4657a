"""Ranks over a whole table, or over groups of any size, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.plans.session import shuffle_partitions
from echofold.plans.staging import staged


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with k, their 1-based rank within the group, by ascending order columns.

    A range partitioning is written out; ranks within each part get the count of the group's rows in
    earlier parts added. A part holds a bounded share of a group of any size.
    """
    parts = shuffle_partitions(rows.sparkSession)
    spread = staged(rows.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id()), "ranges")
    held = spread.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*(group or [F.lit(1)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("part", *group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part", *group).orderBy(*order)
    placed = spread.withColumn("nth", F.row_number().over(within)).join(offsets, ["part", *group])
    return placed.withColumn("k", F.col("ahead") + F.col("nth")).drop("part", "nth", "ahead")
