"""Observation tables read from Parquet: long streams, daily panels, probability snapshots and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: event type, stream key, order within a date
STREAMS = (("click", "SP500", 0), ("error", "INITIAL_CLAIMS", 1), ("purchase", "RETAIL_SALES", 2), ("signup", "US_CPI_YOY", 3), ("view", "UNEMPLOYMENT_RATE", 4))
#: start, end (closed), label
WINDOWS = (
    ("1995-06-01", "1996-03-31", "stagflation"),
    ("1996-10-01", "1997-06-30", "expansion"),
    ("1998-01-01", "1998-12-31", "contraction"),
    ("1999-05-01", "2000-02-28", "expansion"),
    ("2000-06-01", "2001-05-31", "contraction"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STREAMS, "event_type string, stream_key string, ord int")


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "w_start string, w_end string, label string").select(F.to_date("w_start").alias("w_start"), F.to_date("w_end").alias("w_end"), "label")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, ts, seq, stream_key, raw): the long observation table; NaN is null."""
    e = table(spark, sf_dir, "events")
    dim = F.broadcast(stream_dimension(spark))  # a row for each stream
    raw = F.when(~F.isnan("value"), F.col("value"))
    return e.join(dim, "event_type").select(F.col("user_id").alias("entity"), "ts", F.col("event_id").alias("seq"), "stream_key", raw.alias("raw"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, stream_key, x): the mean of each stream on each day."""
    return observations(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "stream_key").agg(F.avg("raw").alias("x"))


def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, series, x): order totals by month and priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_orderpriority").alias("series")).agg(F.sum("o_totalprice").alias("x"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, expansion, stagflation, contraction): shares of three order classes as regime probabilities."""
    o = table(spark, sf_dir, "orders")
    kind = F.pmod(F.col("o_custkey"), F.lit(3))
    share = lambda k: F.avg(F.when(kind == k, 1.0).otherwise(0.0))
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(share(0).alias("expansion"), share(1).alias("stagflation"), share(2).alias("contraction"))


def snapshots_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, regime, p)."""
    s = snapshots(spark, sf_dir)
    return s.unpivot(["day"], ["expansion", "stagflation", "contraction"], "regime", "p")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, scenario, seq, p, outcome): a forecast in [0, 1] with its outcome, a row for each line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("model_id"), F.col("l_returnflag").alias("scenario"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_quantity") / 50.0).alias("p"), F.when(F.col("l_extendedprice") > 40000, 1).otherwise(0).alias("outcome"))


#: The same tables as DuckDB common table expressions.
SQL = {
    "streams": "streams(event_type, stream_key, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in STREAMS) + ")",
    "windows": "windows(w_start, w_end, label) AS (SELECT CAST(a AS DATE), CAST(b AS DATE), c FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in WINDOWS) + ") v(a, b, c))",
    "obs": "obs AS (SELECT user_id AS entity, ts, event_id AS seq, stream_key, CASE WHEN isnan(value) THEN NULL ELSE value END AS raw FROM events JOIN streams USING (event_type))",
    "daily": "daily AS (SELECT CAST(ts AS DATE) AS day, stream_key, avg(raw) AS x FROM obs GROUP BY 1, 2)",
    "monthly": "monthly AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS series, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2)",
    "snap": "snap AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS expansion, avg(CASE WHEN o_custkey % 3 = 1 THEN 1.0 ELSE 0.0 END) AS stagflation, avg(CASE WHEN o_custkey % 3 = 2 THEN 1.0 ELSE 0.0 END) AS contraction FROM orders GROUP BY 1)",
    "long": "long AS (SELECT day, 'expansion' AS regime, expansion AS p FROM snap UNION ALL SELECT day, 'stagflation', stagflation FROM snap UNION ALL SELECT day, 'contraction', contraction FROM snap)",
    "fc": "fc AS (SELECT l_linestatus AS model_id, l_returnflag AS scenario, l_orderkey * 10 + l_linenumber AS seq, l_quantity / 50.0 AS p, CASE WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END AS outcome FROM lineitem)",
}
_NEEDS = {"obs": ["streams"], "daily": ["streams", "obs"], "long": ["snap"]}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """WITH ... for these tables and those they need; further CTEs may follow after a comma."""
    order: list[str] = []
    for name in names:
        order += [x for x in [*_NEEDS.get(name, []), name] if x not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[x] for x in order)
