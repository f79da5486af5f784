"""Exact medians and first rows of groups of any size, without a buffer that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import settled


def running_totals(df: DataFrame, *keys: str, weight: str) -> DataFrame:
    """df with _before, the weights of all rows before it in the order of keys, which have to tell rows apart.

    Rows are dealt into ranges; each range adds up its own rows and starts at the total of the ranges before, one row each.
    """
    dealt = settled(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum(weight).alias("_w"))
    begin = sizes.select("_part", (F.sum("_w").over(Window.orderBy("_part")) - F.col("_w")).alias("_begin"))
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return own.join(F.broadcast(begin), "_part").withColumn("_before", F.col("_begin") + F.col("_own")).drop("_part", "_own", "_begin")  # a row for each range


def exact_medians(rows: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """group and the median of each of values as double: the mean of the two values in the middle; NULLs do not count.

    Equal values of a group are one row with a number before anything is sorted, so that neither a group nor one of its
    values with a third of all rows is a task's alone; the values in the middle are then those whose running numbers hold
    the middle places.  A group without values has NULL.
    """
    seen = rows.select(*group, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(group, values, "_item", "_value")
    counted = seen.where("_value is not null").groupBy(*group, "_item", "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = settled(running_totals(counted, *group, "_item", "_value", weight="_n"))
    sizes = settled(placed.groupBy(*group, "_item").agg(F.min("_before").alias("_first"), F.sum("_n").alias("_all")))
    keys = [*group, "_item"]
    same = [placed[k].eqNullSafe(sizes[k]) for k in keys]
    at = F.col("_before") - F.col("_first")
    holds = lambda place: (at <= place) & (place < at + F.col("_n"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    middle = placed.join(sizes, same).where(holds(low) | holds(high)).select(*(placed[k] for k in keys), "_value", (holds(low).cast("int") + holds(high).cast("int")).alias("_times"))
    found = middle.groupBy(*keys).agg((F.sum(F.col("_value") * F.col("_times")) / 2).alias("_median"))
    wide = found.groupBy(*group).agg(*(F.max(F.when(F.col("_item") == v, F.col("_median"))).alias(v) for v in values))
    return wide


def first_rows(rows: DataFrame, group: list[str], order: list[Column | str], k: int, name: str = "nth") -> DataFrame:
    """The first k rows of each group in an order, with their number (from 0).

    Spark limits each group before and after the shuffle, so at most k rows a group and task are moved.
    """
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(name, nth).where(F.col(name) <= k).withColumn(name, F.col(name) - 1)
