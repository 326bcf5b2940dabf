"""Ordered folds: recursions in which each row needs the state that the row before left.

Recursions that can be summed up over a range of a series run range by range (`ranged`).  Others of a few numbers run in
the JVM as aggregate() over a series' sorted observations, filters with matrices entity by entity (`lockstep`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranged


def series(df: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """One row for each series with obs, its sorted observations: arrays of struct(order..., values...)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("obs"))


#: Observations of a series that one inner fold takes; only its own results are copied as they grow.
CHUNK = 128


def scanned(obs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after every observation: an aggregate() over chunks, each of which appends its states one by one.

    The work grows with the series, not with its square.  A whole series is one row of one task: that is the limit.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(obs) - 1) / CHUNK).cast("int")), lambda i: F.slice(obs, i * CHUNK + 1, F.lit(CHUNK)))

    def chunk_states(done: Column, chunk: Column) -> Column:
        before = F.element_at(F.element_at(done, -1), -1)
        states = F.aggregate(chunk, F.array(before), lambda acc, o: F.concat(acc, F.array(step(F.element_at(acc, -1), o))))
        return F.concat(done, F.array(F.slice(states, F.lit(2), F.lit(CHUNK))))

    return F.slice(F.flatten(F.aggregate(chunks, F.array(F.array(start)), chunk_states)), F.lit(2), F.size(obs))


def final(obs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after the last observation."""
    return F.aggregate(obs, start, step)


def normalised(df: DataFrame, keys: list[str], order: list[str], x: str, a: float, mean: float, var: float, floor: float = 0.01, rolling: bool = False, range_rows: int = ranged.RANGE_ROWS) -> DataFrame:
    """Adds z, each value against the statistics m and v before it, which then move towards it.

    The variance takes in the squared step from the old mean, or with rolling the one from the new mean.  A missing value
    moves nothing and has no z.
    """
    return ranged.scan(df, keys, order, ranged.Normaliser(x, a, mean, var, floor, rolling), range_rows)


def novel(df: DataFrame, keys: list[str], order: list[str], x: str, least: float, range_rows: int = ranged.RANGE_ROWS) -> DataFrame:
    """Rows whose value differs by more than `least`, relative, from the last accepted one; the first is accepted, missing values aren't."""
    return ranged.scan(df, keys, order, ranged.Novelty(x, least), range_rows).where("ok = 1").select(*keys, *order, x)


def cooled(df: DataFrame, keys: list[str], order: list[str], seconds: int | Column, range_rows: int = ranged.RANGE_ROWS) -> DataFrame:
    """Events at least so long after the last event of the same keys that was let through; a suppressed one does not restart the clock.

    `seconds` may be a column that is constant for the keys, such as the cooldown of a trigger's type.
    """
    wait = seconds if isinstance(seconds, Column) else F.lit(seconds)
    timed = df.withColumns({"__at": F.unix_micros(F.col(order[0]).cast("timestamp")), "__wait": wait.cast("double") * 1_000_000})
    return ranged.scan(timed, keys, order, ranged.Cooldown("__at", "__wait"), range_rows).where("ok = 1").select(*keys, *order)


def gas_noise(df: DataFrame, keys: list[str], order: list[str], ratio: str, log_r0: float, beta: float, a: float, most: float, low: float, high: float, range_rows: int = ranged.RANGE_ROWS) -> DataFrame:
    """Score-driven log noise after each series: log R' = clip((1 - beta) log R0 + beta log R + a (min(ratio, most) - 1), low, high)."""
    rows = ranged.last(df, keys, order, ranged.ClippedNoise(ratio, log_r0, beta, a, most, low, high), range_rows)
    return rows.select(*keys, "n", F.element_at("__state", 1).alias("log_r"))
