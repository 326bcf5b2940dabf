"""Calibration of the engine and its rival as queries: components, loading match, estimated parameters, refits, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.operators import calibration, filters, joins, lockstep, regimes, rival, windows
from tidemark.plans.registry import query
from tidemark.plans.state import _daily_z
from tidemark.plans.verify import _INNOVATIONS, _innovations
from tidemark.sources import tables
from tidemark.sources.tables import with_ctes

_KEYS = [s for _, s, _ in tables.STREAMS]


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, stream_key, x): daily means carried forward, from the day on which every stream has begun."""
    panel = joins.carried_panel(joins.aligned(tables.daily(spark, sf_dir), "day", _KEYS), "day", _KEYS)
    return panel.unpivot(["day"], _KEYS, "stream_key", "x")


def _weekly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, pc1..pc4): weekly order totals of the priorities, complete, along their first four components."""
    o = tables.table(spark, sf_dir, "orders")
    series = [f"p{k}" for k in range(1, 6)]
    weekly = o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("day"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("stream_key")).agg(F.sum("o_totalprice").cast("double").alias("x"))
    panel = joins.carried_panel(joins.aligned(weekly, "day", series), "day", series).unpivot(["day"], series, "stream_key", "x")
    found = calibration.components(calibration.correlations(panel), 4, scaled=False)
    s = calibration.scores(panel, found)
    return s.groupBy("day").pivot("component", [1, 2, 3, 4]).agg(F.first("score")).toDF("day", "pc1", "pc2", "pc3", "pc4")


@query("m2_component_residuals")
def component_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three components of the standardised streams leave of each, with the engine's own noise beside it."""
    found = calibration.components(calibration.correlations(_complete(spark, sf_dir)), 3)
    hand = spark.createDataFrame([(k, c.STREAM_NOISE.get(k, 0.10) * c.FREQUENCY_SCALE.get(k, 1.0)) for k in _KEYS], "stream_key string, hand_r double")  # a row for each stream
    g = found.groupBy("stream_key").agg(F.max("residual").alias("residual"), F.sum("share").alias("explained"))
    return g.join(F.broadcast(hand), "stream_key").withColumn("ratio", F.col("residual") / F.col("hand_r"))


@query("m4_loading_match")
def loading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotated component that each factor's loadings by hand resemble most."""
    found = calibration.components(calibration.correlations(_complete(spark, sf_dir)), rotated=True)
    return calibration.loading_match(found, calibration.hand_loadings(spark))


@query("m5_monthly_components")
def monthly_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the monthly totals, loadings over 0.2 in size."""
    monthly = tables.monthly_sales(spark, sf_dir).select(F.col("month").alias("day"), F.col("series").alias("stream_key"), F.col("x").cast("double").alias("x"))
    return calibration.components(calibration.correlations(monthly), scaled=False).where(F.abs("loading") > 0.2).select("stream_key", "component", F.round("loading", 3).alias("loading"), F.round("share", 4).alias("share"))


def _events() -> list[tuple]:
    return [(a, b, label) for a, b, label in tables.WINDOWS]


@query("m6_r38_equalised_refits")
def equalised_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rival on four weekly components, refitted every 13 weeks on all weeks before."""
    rows = _weekly_scores(spark, sf_dir).withColumn("g", F.lit(0))
    return rival.expanding(rows, ["g"], "pc1", ["pc2", "pc3", "pc4"], _events(), first=104, every=13).drop("g")


@query("r38_r39_expanding_refits")
def expanding_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rival on every series' monthly returns given the month before's, refitted every six months."""
    w = windows.along(["series"], ["day"])
    rows = tables.monthly_sales(spark, sf_dir).select("series", F.col("month").alias("day"), F.col("x").cast("double").alias("x"))
    rows = rows.withColumn("y", windows.log_return(F.col("x"), w)).withColumn("before", F.lag("y").over(w))
    return rival.expanding(rows, ["series"], "y", ["before"], _events(), first=48, every=6)


@query("r38_many_starts")
def many_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest of ten fits of the rival to every series' monthly returns given the month before's."""
    w = windows.along(["series"], ["day"])
    rows = tables.monthly_sales(spark, sf_dir).select("series", F.col("month").alias("day"), F.col("x").cast("double").alias("x"))
    rows = rows.withColumn("y", windows.log_return(F.col("x"), w)).withColumn("before", F.lag("y").over(w))
    return rival.best_of_starts(rows, ["series"], "day", "y", ["before"])


@query("m11_estimated_parameters")
def estimated_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings, noise, persistence and channels that the streams' daily means give."""
    return calibration.estimated(_complete(spark, sf_dir))


@query("m12_calibrated_replay")
def calibrated_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity under the engine's parameters and, where innovations ask for it, under estimated ones."""
    obs, base = _daily_z(spark, sf_dir), filters.Config()
    u = lockstep.updates(obs, {"base": base}).withColumn("at", F.struct("day", "entity", "n"))
    panel = _complete(spark, sf_dir).withColumn("x", (F.col("x") - 50) / 50)
    new = calibration.auto_calibrated(base, u, panel, updates_order="at")
    variants = {"base": base} | ({} if new is None else {"calibrated": new})
    last = lockstep.replay(obs, {k: filters.replace(v, config_id=k) for k, v in variants.items()}, every=1_000_000)
    return last.select("entity", "config_id", "n_updates", F.col("log_likelihood").alias("ll"), "anomalies")


@query(
    "m12_diagnosis",
    _INNOVATIONS + ", r AS (SELECT stream_key, seq, z, row_number() OVER (PARTITION BY stream_key ORDER BY seq DESC) AS k FROM z), l AS (SELECT *, lag(z) OVER (PARTITION BY stream_key ORDER BY seq) AS b FROM r WHERE k <= 500), g AS (SELECT stream_key, count(*) AS n, avg(z) AS m, stddev_pop(z) AS sd, corr(CASE WHEN b IS NOT NULL THEN z END, b) AS a, avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0.0 END) AS big FROM l GROUP BY 1) SELECT stream_key, n, round(m, 6) AS mean_z, round(sd, 6) AS std_z, round(a, 6) AS autocorrelation, round(big, 6) AS anomaly_rate, CASE WHEN n < 10 THEN 'insufficient_data' WHEN abs(m) < 0.5 AND sd > 0.5 AND sd < 2 AND coalesce(abs(a) < 0.3, false) AND big < 0.15 THEN 'healthy' ELSE 'needs_recalibration' END AS status FROM g",
)
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each stream's last 500 innovations."""
    d = calibration.diagnosis(_innovations(spark, sf_dir), ["stream_key"], "seq")
    return d.select("stream_key", "n", *[F.round(k, 6).alias(k) for k in ("mean_z", "std_z", "autocorrelation", "anomaly_rate")], "status")


@query("r18_ensemble")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's sub-regimes at its last day: the bank's probabilities and the factors' distances to their targets, blended and scaled to one."""
    obs = _daily_z(spark, sf_dir)
    x = lockstep.replay(obs, {"base": filters.Config()}, every=1_000_000).groupBy("entity").agg(F.max_by("factors", "step").alias("x"))
    cols = {k: v for r in c.REGIMES for k, v in regimes.discriminant(F.col("x"), r).items()}
    scored = x.select("entity", *[v.alias(k) for k, v in cols.items()]).unpivot(["entity"], list(cols), "sub_regime", "scored")
    both = lockstep.nested(obs).select("entity", "regime", "sub_regime", "p").join(scored, ["entity", "sub_regime"]).withColumn("e", regimes.ensemble(F.col("p"), F.col("scored")))
    total = F.sum("e").over(Window.partitionBy("entity", "regime"))
    return both.select("entity", "regime", "sub_regime", F.round(F.col("e") / total, 4).alias("p"))


@query(
    "a27_correlation_summary",
    _INNOVATIONS + ", d AS (SELECT CAST(ts AS DATE) AS day, stream_key, avg(z) AS z FROM z GROUP BY 1, 2), p AS (SELECT a.stream_key AS first, b.stream_key AS second, corr(a.z, b.z) AS r FROM d a JOIN d b ON a.day = b.day AND a.stream_key < b.stream_key GROUP BY 1, 2) SELECT first, second, round(r, 6) AS r, row_number() OVER (ORDER BY round(abs(r), 6) DESC, first, second) AS place, round(avg(abs(r)) OVER (), 6) AS mean_size, round(max(abs(r)) OVER (), 6) AS max_size FROM p",
)
def correlation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the streams' daily innovations, strongest first, with mean and largest size off the diagonal; a row for each pair of streams."""
    d = _innovations(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "stream_key").agg(F.avg("z").alias("x"))
    p = calibration.correlations(d).where("i < j").select(F.col("i").alias("first"), F.col("j").alias("second"), "r")
    size, everything = F.abs("r"), Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.round(size, 6).desc(), "first", "second")).cast("long")
    return p.select("first", "second", F.round("r", 6).alias("r"), place.alias("place"), F.round(F.avg(size).over(everything), 6).alias("mean_size"), F.round(F.max(size).over(everything), 6).alias("max_size"))


@query(
    "w13_w14_long_proxies",
    with_ctes("obs") + " SELECT entity, seq, round(sum(CASE WHEN stream_key = 'RETAIL_SALES' THEN raw ELSE 0 END) OVER e, 6) AS growth_sum, round(sum(raw) OVER s60, 6) AS sum_60, round(raw - lag(raw, 10) OVER s, 6) AS change_10 FROM obs WHERE raw IS NOT NULL WINDOW e AS (PARTITION BY entity ORDER BY ts, seq ROWS 9 PRECEDING), s AS (PARTITION BY entity, stream_key ORDER BY ts, seq), s60 AS (PARTITION BY entity, stream_key ORDER BY ts, seq ROWS 59 PRECEDING)",
)
def long_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over an entity's last ten observations, and a stream's sum over 60 and change over 10 of its own."""
    e, s, raw = windows.along(["entity"], ["ts", "seq"]), windows.along(["entity", "stream_key"], ["ts", "seq"]), F.col("raw")
    growth = F.sum(F.when(F.col("stream_key") == "RETAIL_SALES", raw).otherwise(0.0)).over(e.rowsBetween(-9, 0))
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    return obs.select("entity", "seq", F.round(growth, 6).alias("growth_sum"), F.round(F.sum(raw).over(s.rowsBetween(-59, 0)), 6).alias("sum_60"), F.round(windows.difference(raw, s, 10), 6).alias("change_10"))
