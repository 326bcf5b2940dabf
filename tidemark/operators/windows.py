"""Window operators over ordered streams: one partition for each series, so series are the parallel axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import scalars


def along(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def pct_change(x: Column, w: WindowSpec, lag: int) -> Column:
    """100 * (x / x lag rows before - 1)."""
    return (x / F.lag(x, lag).over(w) - 1) * 100


def log_return(x: Column, w: WindowSpec) -> Column:
    return F.ln(x / F.lag(x).over(w)) * 100


def difference(x: Column, w: WindowSpec, lag: int = 1) -> Column:
    return x - F.lag(x, lag).over(w)


def simple_return(x: Column, w: WindowSpec, eps: float = 1e-10) -> Column:
    """Change relative to the size of the value before."""
    return (x - F.lag(x).over(w)) / (F.abs(F.lag(x).over(w)) + eps)


def carried_forward(x: Column, w: WindowSpec) -> Column:
    """The last value that is not null."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rolling_mean(x: Column, w: WindowSpec, rows: int, least: int) -> Column:
    """Mean of so many rows, null with fewer than `least` values."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))


def slope(x: Column, w: WindowSpec, steps: int) -> Column:
    """Change for each step over so many steps, 0 where the history is too short."""
    return F.coalesce((x - F.lag(x, steps).over(w)) / steps, F.lit(0.0))


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], x: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Lag-1 Pearson correlation of each series, clamped if bounds are given."""
    before = df.withColumn("__before", F.lag(x).over(along(keys, order))).where(F.col("__before").isNotNull())
    rho = scalars.correlation(x, "__before")
    if low is not None and high is not None:
        rho = F.when(rho.isNotNull(), F.least(F.greatest(rho, F.lit(low)), F.lit(high)))
    return before.groupBy(*keys).agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"))


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Adds run, a number for each maximal run of rows of equal flag, counted from 1 within a series."""
    w = along(keys, order)
    marked = df.withColumn("flag", flag).withColumn("__new", F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1)))
    return marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def warm_rows(df: DataFrame, order: str, skip: int) -> DataFrame:
    """Rows after the first `skip` distinct dates, numbered from 1 in column step. Dates are ranked once, on their own, then joined."""
    dates = df.select(order).distinct().withColumn("step", F.row_number().over(Window.orderBy(order)))
    return df.join(dates, order).where(F.col("step") > skip)


def warmed(df: DataFrame, owner: list[str], own: list[str], order: str, first: int, least: int, instead: int) -> DataFrame:
    """Rows of each series (owner and own keys) that its statistics start from: those among the first distinct values of `order` of its
    owner, or where these are under `least`, its first `instead` rows."""
    series = [*owner, *own]
    days = df.select(*owner, order).distinct().withColumn("__place", F.row_number().over(along(owner, [order]))).where(F.col("__place") <= first)
    rows = df.join(days.withColumn("__early", F.lit(1)), [*owner, order], "left")
    w = Window.partitionBy(*series)
    rows = rows.withColumns({"__k": F.row_number().over(along(series, [order])), "__n": F.count("__early").over(w)})
    return rows.where(F.when(F.col("__n") >= least, F.col("__early").isNotNull()).otherwise(F.col("__k") <= instead)).drop("__k", "__n", "__early", "__place")
