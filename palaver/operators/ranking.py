"""Row numbers within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.sources.shared import written


def dealt(rows: DataFrame, order: list[Column], name: str = "ranges") -> DataFrame:
    """rows written in ranges of `order`, each a task's: `_part`, the range, and `_at`, which ascends with the order."""
    # The last key spreads rows that agree in all others.
    out = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    out = written(out.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    return out.withColumn("_part", F.shiftright("_at", 33))


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their number from 1 within the group, by `order`; equal rows may swap places, a null group is one.

    Rows are dealt by ranges of group and order, so that a hot group spreads over tasks, sorted there and written; then
    each range counts its rows by group, and a row's number is its place in the range plus what the group has before it.
    Only these counts, one for each range and group that meet, go through a window.
    """
    ranges = dealt(rows, [F.col(group).asc_nulls_first(), *order]).withColumnRenamed("_part", "_in")
    counts = ranges.groupBy(F.col("_in").alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_part", "_group", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = ranges.join(counts, (F.col("_in") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")).drop("_at", "_in", "_part", "_group", "_first", "_before")
