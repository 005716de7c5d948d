"""Sums over a whole table in one order, without one task for the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of the bigint ``value`` over all rows up to this one in the order of the columns ``order``.

    ``order`` tells rows apart. Rows are range-partitioned and written; each range is summed, and a row's sum is that
    within its range and those of the ranges before, of which the driver gets one number each.
    """
    cols = [F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c) for c in order]
    ranged = written(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()), "ranged")
    before, at = {}, 0
    for r in ranged.groupBy("_range").agg(F.sum(value).alias("s")).orderBy("_range").collect():
        before[r[0]], at = at, at + (r[1] or 0)
    base = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)])
    within = Window.partitionBy("_range").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, F.sum(value).over(within) + F.get(base, F.col("_range"))).drop("_range")
