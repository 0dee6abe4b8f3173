"""Running totals over a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermill.functions.storage import shuffle_width, written


def running_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Add running sums in the given order, each with its row included, and ``<name>_all`` with the whole sum.

    The order must tell all rows apart. Rows are laid out in ranges of the order and stored; each range is summed
    where it lies, and only the sums of whole ranges, one row for each, are put in order in one place.
    """
    keys = list(order)
    laid = df.withColumns(dict(sums)).repartitionByRange(shuffle_width(df.sparkSession), *keys).withColumn("range_no", F.spark_partition_id())
    laid = written(laid, "ranges")
    whole = laid.groupBy("range_no").agg(*(F.sum(n).alias(f"in_{n}") for n in sums))
    upto = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    total = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = whole.select(
        F.col("range_no").alias("of_range"),
        *(F.coalesce(F.sum(f"in_{n}").over(upto), F.lit(0)).alias(f"before_{n}") for n in sums),
        *(F.sum(f"in_{n}").over(total).alias(f"{n}_all") for n in sums),
    )
    inside = Window.partitionBy("range_no").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joined = laid.join(F.broadcast(before), F.col("range_no") == F.col("of_range"))  # as many rows as there are ranges
    return joined.withColumns({n: F.sum(n).over(inside) + F.col(f"before_{n}") for n in sums}).drop("range_no", "of_range", *(f"before_{n}" for n in sums))


def group_ranks(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``rank``, from 0, of each row in its group, and ``group_size``; a group of any size is spread over many tasks.

    The order must tell a group's rows apart. Rows are laid out in ranges of group and order and stored; each range is
    numbered where it lies, and what a group has in the ranges before is added, from one count for each group and range.
    """
    laid = df.repartitionByRange(shuffle_width(df.sparkSession), group, *order).withColumn("__range", F.spark_partition_id())
    laid = written(laid, "ranks")
    counts = laid.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(group).orderBy("__range")  # a group's ranges, no more than there are tasks
    before = counts.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("group_size"))
    inside = F.row_number().over(Window.partitionBy("__range", group).orderBy(*order)) - 1
    joined = laid.withColumn("__i", inside).join(before, (F.col(group).eqNullSafe(F.col("__group"))) & (F.col("__range") == F.col("__of")))
    return joined.withColumn("rank", F.col("__before") + F.col("__i")).drop("__range", "__group", "__of", "__before", "__i")
