"""Joins whose left side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import partitions

#: Rows of one key that are always left together.
LEAST_SHARE = 256


def most_of(df: DataFrame, *keys: str) -> tuple[int, int]:
    """(rows of the most frequent key, rows), counted with partial sums."""
    row = df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, most: int, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose rows are unique by `on`.

    Where a key has more left rows (`most` of `rows`) than a quarter of an even task, left rows are dealt to shares by a
    hash of `by`, and a copy of the right row goes to each share in use: no task gets a whole hot key.
    """
    fair = max(LEAST_SHARE, rows // (4 * partitions(left.sparkSession)))
    shares = -(-most // fair)
    if shares <= 1:
        return left.join(right, on, how)
    left = left.withColumn("__share", F.pmod(F.xxhash64(by), F.lit(shares)))
    copies = left.select(*on, "__share").distinct().join(right, on)
    return left.join(copies, [*on, "__share"], how).drop("__share")
