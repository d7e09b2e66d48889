"""Places of rows within their group, without a task that holds a group."""

from pyspark.sql import Window, functions as F

from .links import written


def numbered(rows, group, *order):
    """``rows`` with ``place``, a row's number from 0 within its ``group`` by ``order``, and ``n``, the group's rows.

    ``group`` must not be null. Rows are sorted across partitions by ranges of
    group and order, so that a hot group is cut wherever its order allows; each
    partition numbers its own rows, and running totals of one row per group and
    partition give what is ahead of it. ``order`` should tell all rows apart, or
    only such that are alike.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    pieces = ranged.groupBy(F.col(group).alias("_group"), F.shiftright("_at", 33).alias("_part")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(pieces.select(
        "_group", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_group")).alias("n")))
    placed = ranged.join(pieces, (F.col(group) == F.col("_group")) & (F.shiftright("_at", 33) == F.col("_part")))
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n")
