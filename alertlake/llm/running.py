"""Running totals over a whole table, without a window over everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import materialize


def running_total(df: DataFrame, order: list[Column], value: str, into: str, rows_per_part: int = 1_000_000) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over this row and all earlier ones in ``order``.

    The rows are range-partitioned and written once with their part number, so that the parts
    stay as they are if a task runs again. One total per part (a number of rows that depends on
    the number of parts alone) gives the offsets; inside a part a window runs over its own rows.
    ``order`` must settle all ties between rows that differ in what is read from the result.
    """
    spark = df.sparkSession
    frozen = materialize(df, "running")
    n = frozen.count()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / rows_per_part))
    ranged = materialize(frozen.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    # One row per part.
    before = totals.withColumn(
        "_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum(value).over(inside))
    return (
        summed.join(F.broadcast(before.select("_part", "_before")), "_part")
        .withColumn(into, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside"))


def running_by_group(df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df``, frozen, with a running sum inside ``group`` for each of ``sums``; rows of a group may be on many tasks.

    Rows are range-partitioned by group and order, so a large group covers several parts and each part
    begins inside at most one group: the sums that such a group brings along are one row per part.
    ``group`` must not be null; ``order`` must settle all ties between rows that differ.
    """
    ranged = materialize(
        df.select("*", *[c.alias(n) for n, c in sums.items()]).repartitionByRange(group, *order)
        .withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(group, "_part").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part at most.
    carried = totals.select(group, "_part", *[F.sum(n).over(earlier).alias(f"_{n}") for n in sums]).where(
        " and ".join(f"_{n} is not null" for n in sums))
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(*df.columns, "_part", *[F.sum(n).over(inside).alias(n) for n in sums])
    joined = summed.join(F.broadcast(carried), ["_part", group], "left")
    return joined.select(
        *df.columns, *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).cast(ranged.schema[n].dataType).alias(n) for n in sums])
