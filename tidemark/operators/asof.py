"""Backward as-of joins of irregular series: by a union and what is carried forward, in buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """left with `value` of the last row of right at or before its `at`, null where there is none.

    Both have keys and `at`; `order` breaks ties among right rows of one `at`.  `bucket` is a non-decreasing function of
    `at`: within a bucket values are carried along the union of both sides, and the last value of each bucket, a row for
    each, goes on to the next ones, so a long series is many tasks.
    """
    columns = [c for c in left.columns if c not in keys]
    l_rows = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*columns).alias("__left"))
    r_rows = right.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(*order).alias("__order"), F.struct(F.col(value).alias("v")).alias("__value"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn(at, F.col("__at")).withColumn("__bucket", bucket).drop(at)
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__own", F.last("__value", ignorenulls=True).over(inside)).where("__side = 1")
    ends = both.where("__side = 0").groupBy(*keys, "__bucket").agg(F.max(F.struct("__at", "__order", "__value"))["__value"].alias("__end"))
    open_buckets = rows.select(*keys, "__bucket").distinct()
    steps = open_buckets.join(ends, [*keys, "__bucket"], "full")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    found = rows.join(carried, [*keys, "__bucket"], "left")
    return found.select(*keys, *[F.col(f"__left.{c}").alias(c) for c in columns], F.coalesce("__own.v", "__carried.v").alias(value))
