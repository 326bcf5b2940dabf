"""Alignment joins: as-of, nearest and interval, on buckets of the ordered key so that they stay equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_date(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Each (day, x) of left with the nearest (day, y) of right within so many days, the earlier one on ties; unmatched rows are dropped.

    Right rows go to every bucket of `tolerance + 1` days that they can reach, so the join is by equal bucket.
    """
    width = tolerance + 1
    number = F.datediff("day", F.lit("1970-01-01"))
    a = left.withColumn("bucket", F.floor(number / width))
    b = right.select(F.col("day").alias("other_day"), "y").withColumn("day", F.col("other_day")).withColumn("bucket", F.explode(F.array(*[F.floor(number / width) + k for k in (-1, 0, 1)]))).drop("day")
    near = a.join(b, "bucket").withColumn("gap", F.abs(F.datediff("day", "other_day"))).where(F.col("gap") <= tolerance)
    first = Window.partitionBy("day").orderBy("gap", "other_day")
    return near.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "bucket")


def in_windows(df: DataFrame, windows: DataFrame, day: str = "day", how: str = "inner") -> DataFrame:
    """Rows with the closed windows that hold them. A window is spread over its months, so that the join is by month, whatever the number of windows."""
    w = windows.withColumn("__month", F.explode(F.sequence(F.trunc("w_start", "month"), F.trunc("w_end", "month"), F.expr("interval 1 month"))))
    rows = df.withColumn("__month", F.trunc(day, "month"))
    return rows.join(w, (rows["__month"] == w["__month"]) & F.col(day).between(F.col("w_start"), F.col("w_end")), how).drop("__month")


def aligned(df: DataFrame, key: str, streams: list[str], value: str = "x") -> DataFrame:
    """Wide panel: a row for each date, a column for each of the named streams, null where there is no observation."""
    return df.groupBy(key).pivot("stream_key", streams).agg(F.first(value))


def carried_panel(panel: DataFrame, key: str, streams: list[str]) -> DataFrame:
    """Last values carried forward in every column; dates before all streams have begun are dropped.

    Works on one row for each date, as a panel has.
    """
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    filled = panel.select(key, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in streams])
    return filled.dropna(subset=streams)


def positions(df: DataFrame, keys: list[str], order: str, span: int = 1 << 16, ties: list[str] | None = None) -> DataFrame:
    """Adds __pos, each row's place from 0 in its keys by `order` (whole numbers), those of one number by `ties`.

    Rows are counted in ranges of this span of `order` and ranked within them, so a long series is many tasks.
    """
    rows = df.withColumn("__range", F.floor(F.col(order) / span))
    counts = rows.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order, *(ties or []))) - 1)
    return ranked.join(counts, [*keys, "__range"]).withColumn("__pos", F.col("__k") + F.col("__before")).drop("__range", "__k", "__before")


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: str, span: int = 1 << 16) -> DataFrame:
    """Rows of both sides that stand at one position of their keys by `order`, ties by the other columns; what one side has more is left out."""
    others = lambda df: [x for x in df.columns if x != order and x not in keys]
    a, b = positions(left, keys, order, span, others(left)), positions(right, keys, order, span, others(right))
    return a.join(b.drop(order), [*keys, "__pos"])
