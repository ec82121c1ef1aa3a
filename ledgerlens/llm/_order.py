"""Places of rows in a sorted order, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._spark import cut


def ranked(rows: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """rows with pos, each row's place (from 0) in its group in the order given, and n, the rows of its group.

    Rows are dealt by ranges of group and order and sorted in their tasks, so a group may span any
    number of them; only each task's count of each group is added up afterwards. Group columns hold
    no nulls. rows must read alike each time, and rows that are equal in `order` are interchangeable.
    """
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [*group, *order]
    placed = cut(rows.repartitionByRange(wanted, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_rows").over(all_of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(all_of).alias("n"))
    found = placed.withColumn("_part", part).join(runs, [*group, "_part"])
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
