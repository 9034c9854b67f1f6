"""Numbering rows in an order without a window that spans them.

Rows are dealt to ranges of the order of about equal size, sorted there, and kept: then each has a place in its
range, and what lies in the ranges before is one count for each group and range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]

RANGE, PLACE = "_range", "_place"


def in_ranges(df: DataFrame, order: list[str | Column], keep: Keep) -> DataFrame:
    """``df`` with its range of ``order`` and its place there, both from 0.

    ``keep`` stores it: the bounds of ranges are sampled, so all that reads them has to see the same ones.  Rows that
    are equal in all of ``order`` share a range; give enough columns to tell rows apart.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return keep(placed.withColumns({RANGE: F.spark_partition_id(), PLACE: place}))


def range_heads(placed: DataFrame, within: list[str], **more: Column) -> DataFrame:
    """(*within, range, first, done, *more): of each group in each range its first place, its rows in the ranges
    before, and aggregates ``more``.  A group has a row for each range it touches, however many rows it has."""
    before = Window.partitionBy(*within).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy(*within, RANGE).agg(
        F.count("*").alias("n"), F.min(PLACE).alias("first"), *[c.alias(name) for name, c in more.items()]
    )
    return counted.withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
