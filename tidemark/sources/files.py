"""Files in and out: panels as CSV or Parquet, result logs as JSON, engine states as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_panel(spark: SparkSession, path: str, streams: list[str], kind: str = "csv") -> DataFrame:
    """(day, stream_key, raw) of a wide file with a date column and one column FRED_<key> or YAHOO_<key> for each stream; nulls and NaN are no observations."""
    schema = T.StructType([T.StructField("date", T.DateType())] + [T.StructField(s, T.DoubleType()) for s in streams])
    wide = spark.read.schema(schema).csv(path, header=True) if kind == "csv" else spark.read.schema(schema).parquet(path)
    long = wide.unpivot(["date"], streams, "column", "raw").where(F.col("raw").isNotNull() & ~F.isnan("raw"))
    return long.select(F.col("date").alias("day"), F.regexp_extract("column", "^[^_]*_(.*)$", 1).alias("stream_key"), "raw")


def write_panel(long: DataFrame, path: str, streams: list[str]) -> None:
    """The same wide layout back, as Parquet."""
    long.groupBy(F.col("day").alias("date")).pivot("stream_key", streams).agg(F.first("raw")).write.mode("overwrite").parquet(path)


def read_innovations(spark: SparkSession, path: str) -> DataFrame:
    """(stream_key, observed, predicted, innovation, z) from JSON logs that keep their records under innovation_history or updates."""
    record = "array<struct<stream_key:string,observed:double,predicted:double,innovation:double,innovation_zscore:double>>"
    rows = spark.read.schema(f"innovation_history {record}, updates {record}").json(path, multiLine=True)
    r = rows.select(F.explode(F.coalesce("innovation_history", "updates")).alias("r"))
    return r.select("r.stream_key", "r.observed", "r.predicted", "r.innovation", F.col("r.innovation_zscore").alias("z"))


def read_trajectories(spark: SparkSession, path: str, factors: list[str]) -> DataFrame:
    """(day, a column for each factor) from JSON results that keep a daily_log of dates with their factors; a factor that is missing is null."""
    log = f"daily_log array<struct<date:date,factors:struct<{','.join(f'{x}:double' for x in factors)}>>>"
    e = spark.read.schema(log).json(path, multiLine=True).select(F.explode("daily_log").alias("e"))
    return e.select(F.col("e.date").alias("day"), *[F.col(f"e.factors.{x}").alias(x) for x in factors])


def write_results(df: DataFrame, path: str) -> None:
    """One JSON record for each row."""
    df.write.mode("overwrite").json(path)


def save_states(states: DataFrame, path: str) -> None:
    """Engine states by entity and configuration, one version for each run."""
    states.write.mode("append").partitionBy("config_id").parquet(path)


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last saved state of each entity and configuration."""
    states = spark.read.parquet(path)
    rest = [c for c in states.columns if c not in ("entity", "config_id")]
    last = states.groupBy("entity", "config_id").agg(F.max_by(F.struct(*rest), "step").alias("s"))
    return last.select("entity", "config_id", "s.*")
