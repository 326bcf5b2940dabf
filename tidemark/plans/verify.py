"""Checkpoint statistics, forecast verification and innovation diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import joins, verification, windows
from tidemark.plans.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import with_ctes

_BIN = "CAST(least(floor(p * 10), 9) AS INTEGER)"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "a1_warmup",
    with_ctes("obs") + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY ts, seq) AS k FROM obs WHERE raw IS NOT NULL), s AS (SELECT stream_key, avg(raw) AS m, stddev_samp(raw) AS sd FROM r WHERE k <= 50 GROUP BY 1) SELECT stream_key, round(m, 6) AS mean, round(greatest(sd, abs(m) * 0.01, 0.1), 6) AS scale FROM s",
)
def warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and floored deviation of the first 50 values of each stream; the rank limit is found by a top-k of each partition."""
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    first = obs.withColumn("k", F.row_number().over(windows.along(["stream_key"], ["ts", "seq"]))).where("k <= 50")
    s = first.groupBy("stream_key").agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("sd"))
    return s.select("stream_key", F.round("m", 6).alias("mean"), F.round(F.greatest("sd", F.abs("m") * 0.01, F.lit(0.1)), 6).alias("scale"))


_TRUTH = ", t AS (SELECT l.day, l.regime, l.p, w.label, w.w_start, w.w_end FROM long l JOIN windows w ON l.day BETWEEN w.w_start AND w.w_end)"


@query(
    "a2_checkpoints",
    with_ctes("long", "windows") + _TRUTH + " SELECT w_start, label, round(avg(CASE WHEN regime = label THEN p END), 6) AS mean_p, round(max(CASE WHEN regime = label THEN p END), 6) AS max_p, min(CASE WHEN regime = label AND p >= 0.5 THEN day END) AS first_crossing, avg(CASE WHEN regime = label THEN p END) >= 0.3 AS pass FROM t GROUP BY 1, 2",
)
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark)).where("regime = label")
    g = t.groupBy("w_start", "label").agg(F.avg("p").alias("m"), F.max("p").alias("x"), F.min(F.when(F.col("p") >= 0.5, F.col("day"))).alias("first_crossing"))
    return g.select("w_start", "label", F.round("m", 6).alias("mean_p"), F.round("x", 6).alias("max_p"), "first_crossing", (F.col("m") >= 0.3).alias("pass"))


@query(
    "a3_joint_ratio",
    with_ctes("snap", "windows") + " SELECT w_start, label, round(avg(expansion * stagflation), 6) AS joint, round(avg(expansion), 6) AS parent, round(avg(CASE WHEN expansion > 0.05 THEN stagflation / expansion END), 6) AS ratio FROM snap JOIN windows ON day BETWEEN w_start AND w_end GROUP BY 1, 2",
)
def joint_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots(spark, sf_dir), tables.windows(spark))
    ratio = F.avg(F.when(F.col("expansion") > 0.05, F.col("stagflation") / F.col("expansion")))
    return t.groupBy("w_start", "label").agg(F.round(F.avg(F.col("expansion") * F.col("stagflation")), 6).alias("joint"), F.round(F.avg("expansion"), 6).alias("parent"), F.round(ratio, 6).alias("ratio"))


@query(
    "a4_false_positives",
    with_ctes("snap", "windows") + " SELECT w_start, sum(CASE WHEN contraction > 0.35 THEN 1 ELSE 0 END) AS alarms, count(*) AS n FROM snap JOIN windows ON day BETWEEN w_start AND w_end WHERE label = 'expansion' GROUP BY ROLLUP (w_start)",
)
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms in expansion windows, each and in all."""
    t = joins.in_windows(tables.snapshots(spark, sf_dir), tables.windows(spark).where("label = 'expansion'"))
    return t.rollup("w_start").agg(F.sum((F.col("contraction") > 0.35).cast("long")).alias("alarms"), F.count(F.lit(1)).alias("n"))


@query(
    "a6_murphy",
    with_ctes("fc") + f", b AS (SELECT model_id, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(outcome) AS mo, sum((p - outcome) * (p - outcome)) AS se, sum(outcome) AS so FROM fc GROUP BY 1, 2), t AS (SELECT model_id, sum(n) AS total, sum(so) * 1.0 / sum(n) AS base, sum(se) / sum(n) AS brier FROM b GROUP BY 1) SELECT model_id, round(max(brier), 6) AS brier, round(sum(n * (mp - mo) * (mp - mo)) / max(total), 6) AS reliability, round(sum(n * (mo - base) * (mo - base)) / max(total), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty, round(1 - max(brier) / max(base * (1 - base)), 6) AS skill FROM b JOIN t USING (model_id) GROUP BY 1",
)
def murphy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verification.murphy(tables.forecasts(spark, sf_dir), ["model_id"]), "brier", "reliability", "resolution", "uncertainty", "skill")


@query(
    "a7_bias_corrected",
    with_ctes("fc") + f", b AS (SELECT scenario, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(outcome) AS mo FROM fc GROUP BY 1, 2), t AS (SELECT scenario, sum(n) AS total, sum(n * mo) / sum(n) AS base FROM b GROUP BY 1), j AS (SELECT *, CASE WHEN n > 1 THEN mo * (1 - mo) / (n - 1) ELSE 0 END AS noise FROM b JOIN t USING (scenario)) SELECT scenario, round(greatest(sum(n / total * ((mp - mo) * (mp - mo) - noise)), 0), 6) AS reliability, round(greatest(sum(n / total * ((mo - base) * (mo - base) - noise)) + max(base * (1 - base) / (total - 1)), 0), 6) AS resolution FROM j GROUP BY 1",
)
def bias_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verification.bias_corrected(tables.forecasts(spark, sf_dir), ["scenario"]), "reliability", "resolution")


_ROC = with_ctes("fc") + ", th AS (SELECT unnest(range(0, 101)) AS k), r AS (SELECT model_id, k, sum(CASE WHEN floor(round(p * 100, 9)) >= k THEN outcome ELSE 0 END) * 1.0 / sum(outcome) AS tpr, sum(CASE WHEN floor(round(p * 100, 9)) >= k THEN 1 - outcome ELSE 0 END) * 1.0 / sum(1 - outcome) AS fpr FROM fc CROSS JOIN th GROUP BY 1, 2)"


@query("a8_roc", _ROC + " SELECT model_id, round(k / 100.0, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verification.roc(tables.forecasts(spark, sf_dir), ["model_id"]), "threshold", "tpr", "fpr")


@query("a8_auc", _ROC + ", a AS (SELECT *, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS area, row_number() OVER (PARTITION BY model_id ORDER BY round(tpr - fpr, 9) DESC, k DESC) AS rn FROM r WINDOW w AS (PARTITION BY model_id ORDER BY k DESC)) SELECT model_id, round(sum(area), 6) AS auc, round(max(CASE WHEN rn = 1 THEN k END) / 100.0, 6) AS best FROM a GROUP BY 1")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verification.auc(tables.forecasts(spark, sf_dir), ["model_id"]), "auc", "best")


@query(
    "a9_diebold_mariano",
    with_ctes("snap") + ", x AS (SELECT day, (expansion - 0.4) * (expansion - 0.4) - (stagflation - 0.3) * (stagflation - 0.3) AS d FROM snap), c AS (SELECT day, d, avg(d) OVER () AS m, count(*) OVER () AS n FROM x), l AS (SELECT m, n, (d - m) AS c, lag(d - m, 1) OVER (ORDER BY day) AS c1, lag(d - m, 2) OVER (ORDER BY day) AS c2 FROM c), s AS (SELECT max(m) AS m, max(n) AS n, sum(c * c) AS g0, sum(c * c1) AS g1, sum(c * c2) AS g2 FROM l) SELECT n, round(m / sqrt((g0 + 2 * (g1 + g2)) / n / n) * sqrt((n + 1 - 2 * 3 + 3 * 2 / CAST(n AS DOUBLE)) / n), 6) AS statistic FROM s",
)
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = lambda c, t: F.pow(F.col(c) - t, 2)
    d = tables.snapshots(spark, sf_dir).select("day", F.lit(1).alias("pair"), (loss("expansion", 0.4) - loss("stagflation", 0.3)).alias("d"))
    return _rounded(verification.diebold_mariano(d, ["pair"], ["day"], 3), "statistic").drop("pair")


@query("a12_sharpness", with_ctes("snap") + ", m AS (SELECT greatest(expansion, stagflation, contraction) AS p FROM snap) SELECT round(avg(p), 6) AS mean_max, round(stddev_pop(p), 6) AS deviation, round(avg(CASE WHEN p > 0.8 THEN 1.0 ELSE 0.0 END), 6) AS over_80, round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS over_50 FROM m")
def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.snapshots(spark, sf_dir).select(F.greatest("expansion", "stagflation", "contraction").alias("p"))
    over = lambda t: F.round(F.avg((F.col("p") > t).cast("double")), 6)
    return m.agg(F.round(F.avg("p"), 6).alias("mean_max"), F.round(F.stddev_pop("p"), 6).alias("deviation"), over(0.8).alias("over_80"), over(0.5).alias("over_50"))


@query(
    "a13_detection_lag",
    with_ctes("long", "windows") + _TRUTH + ", d AS (SELECT w_start, label, min(CASE WHEN p >= 0.5 THEN day END) AS d50, min(CASE WHEN p >= 0.8 THEN day END) AS d80, max(p) AS peak, avg(p) AS mean FROM t WHERE regime = label GROUP BY 1, 2) SELECT w_start, label, round(date_diff('day', w_start, d50) / 7.0, 6) AS weeks_50, round(date_diff('day', w_start, d80) / 7.0, 6) AS weeks_80, round(peak, 6) AS peak, round(mean, 6) AS mean FROM d",
)
def detection_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark)).where("regime = label")
    first = lambda bound: F.min(F.when(F.col("p") >= bound, F.col("day")))
    g = t.groupBy("w_start", "label").agg(first(0.5).alias("d50"), first(0.8).alias("d80"), F.max("p").alias("peak"), F.avg("p").alias("mean"))
    weeks = lambda c: F.round(F.datediff(c, "w_start") / 7.0, 6)
    return g.select("w_start", "label", weeks("d50").alias("weeks_50"), weeks("d80").alias("weeks_80"), F.round("peak", 6).alias("peak"), F.round("mean", 6).alias("mean"))


@query(
    "a15_sustained_detection",
    with_ctes("long", "windows") + _TRUTH + ", f AS (SELECT w_start, label, day, p >= 0.4 AS flag, lag(p >= 0.4) OVER (PARTITION BY w_start ORDER BY day) AS b FROM t WHERE regime = label), g AS (SELECT *, sum(CASE WHEN flag = b THEN 0 ELSE 1 END) OVER (PARTITION BY w_start ORDER BY day) AS run FROM f), r AS (SELECT w_start, label, run, min(day) AS first_day, count(*) AS n FROM g WHERE flag GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT w_start, label, min(first_day) AS detected FROM r GROUP BY 1, 2",
)
def sustained_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first start of three snapshots in a row at 0.4 or more."""
    t = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark)).where("regime = label")
    runs = windows.islands(t, ["w_start", "label"], ["day"], F.col("p") >= 0.4).where("flag")
    long = runs.groupBy("w_start", "label", "run").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return long.groupBy("w_start", "label").agg(F.min("first_day").alias("detected"))


@query("a16_crossing_month", with_ctes("long") + " SELECT regime, min(CASE WHEN p >= 0.7 THEN date_trunc('month', day) END)::DATE AS first_above, min(CASE WHEN p <= 0.1 THEN date_trunc('month', day) END)::DATE AS first_below, round(max(p), 6) AS peak, round(min(p), 6) AS trough FROM long GROUP BY 1")
def crossing_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "day"))
    return tables.snapshots_long(spark, sf_dir).groupBy("regime").agg(F.min(F.when(F.col("p") >= 0.7, month)).alias("first_above"), F.min(F.when(F.col("p") <= 0.1, month)).alias("first_below"), F.round(F.max("p"), 6).alias("peak"), F.round(F.min("p"), 6).alias("trough"))


@query("a17_calibration_curve", with_ctes("fc") + f" SELECT scenario, {_BIN} AS bucket, count(*) AS n, round(avg(p), 6) AS forecast, round(avg(outcome), 6) AS observed, round(abs(avg(p) - avg(outcome)), 6) AS deviation FROM fc GROUP BY 1, 2")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verification.calibration_curve(tables.forecasts(spark, sf_dir), ["scenario"]), "forecast", "observed", "deviation")


@query("a18_brier_grouping_sets", with_ctes("fc") + " SELECT model_id, scenario, count(*) AS n, round(avg((p - outcome) * (p - outcome)), 6) AS brier FROM fc GROUP BY GROUPING SETS ((model_id), (model_id, scenario))")
def brier_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.forecasts(spark, sf_dir).withColumn("e", F.pow(F.col("p") - F.col("outcome"), 2))
    return f.groupingSets([["model_id"], ["model_id", "scenario"]], "model_id", "scenario").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("brier"))


@query(
    "a19_fusion_weights",
    with_ctes("fc") + ", b AS (SELECT model_id, scenario, avg((p - outcome) * (p - outcome)) AS brier FROM fc GROUP BY 1, 2), w AS (SELECT *, CASE WHEN brier = 0 THEN 10.0 ELSE 1 / brier END AS w FROM b) SELECT model_id, scenario, round(w / sum(w) OVER (), 4) AS weight FROM w",
)
def fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by inverse Brier score over a row for each model."""
    b = tables.forecasts(spark, sf_dir).groupBy("model_id", "scenario").agg(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)).alias("brier"))
    w = b.withColumn("w", F.when(F.col("brier") == 0, 10.0).otherwise(1 / F.col("brier")))
    total = w.agg(F.sum("w").alias("total"))
    return w.crossJoin(F.broadcast(total)).select("model_id", "scenario", F.round(F.col("w") / F.col("total"), 4).alias("weight"))


@query("a20_reliability_index", with_ctes("fc") + f", b AS (SELECT scenario, {_BIN} AS bin, count(*) AS n, abs(avg(p) - avg(outcome)) AS dev FROM fc GROUP BY 1, 2) SELECT scenario, round(coalesce(avg(CASE WHEN n >= 3 THEN dev END), 1.0), 6) AS reliability FROM b GROUP BY 1")
def reliability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = verification.calibration_curve(tables.forecasts(spark, sf_dir), ["scenario"])
    return c.groupBy("scenario").agg(F.round(F.coalesce(F.avg(F.when(F.col("n") >= 3, F.col("deviation"))), F.lit(1.0)), 6).alias("reliability"))


@query("a21_regime_means", with_ctes("long", "windows") + _TRUTH + " SELECT label, regime, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, count(*) AS n FROM t GROUP BY 1, 2")
def regime_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark))
    return t.groupBy("label", "regime").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("a22_discriminator", with_ctes("long", "windows") + _TRUTH + ", m AS (SELECT label, regime, avg(p) AS m FROM t GROUP BY 1, 2) SELECT regime, round(max(m) - min(m), 6) AS spread, CASE WHEN max(m) - min(m) > 0.30 THEN 'STRONG' WHEN max(m) - min(m) > 0.10 THEN 'MODERATE' ELSE 'WEAK' END AS verdict FROM m GROUP BY 1")
def discriminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark)).groupBy("label", "regime").agg(F.avg("p").alias("m"))
    spread = t.groupBy("regime").agg((F.max("m") - F.min("m")).alias("s"))
    return spread.select("regime", F.round("s", 6).alias("spread"), F.when(F.col("s") > 0.30, "STRONG").when(F.col("s") > 0.10, "MODERATE").otherwise("WEAK").alias("verdict"))


_INNOVATIONS = with_ctes("obs") + ", s AS (SELECT stream_key, avg(raw) AS m, stddev_pop(raw) AS sd FROM obs GROUP BY 1), z AS (SELECT stream_key, entity, ts, seq, (raw - m) / sd AS z FROM obs JOIN s USING (stream_key) WHERE raw IS NOT NULL)"


def _innovations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    stats = obs.groupBy("stream_key").agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("sd"))
    return obs.join(F.broadcast(stats), "stream_key").select("stream_key", "entity", "ts", "seq", ((F.col("raw") - F.col("m")) / F.col("sd")).alias("z"))


@query("a24_a26_innovations", _INNOVATIONS + ", k AS (SELECT stream_key, count(*) AS n, avg(z * z * z) AS s, kurtosis_pop(z) AS k FROM z GROUP BY 1) SELECT stream_key, n, round(s, 5) AS skew, round(k, 5) AS kurtosis, round(n / 6.0 * (s * s + k * k / 4), 3) AS jarque_bera FROM k")
def innovations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _innovations(spark, sf_dir).groupBy("stream_key").agg(F.count(F.lit(1)).alias("n"), F.skewness("z").alias("s"), F.kurtosis("z").alias("k"))
    return g.select("stream_key", "n", F.round("s", 5).alias("skew"), F.round("k", 5).alias("kurtosis"), F.round(F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4), 3).alias("jarque_bera"))


_LAGS = ", ".join(f"sum(z * l{k}) AS s{k}" for k in range(1, 6))


@query(
    "a25_ljung_box",
    _INNOVATIONS + ", c AS (SELECT entity, ts, seq, z - avg(z) OVER (PARTITION BY entity) AS z FROM z), l AS (SELECT entity, z, " + ", ".join(f"lag(z, {k}) OVER w AS l{k}" for k in range(1, 6)) + f" FROM c WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)), q AS (SELECT entity, count(*) AS n, sum(z * z) AS v, {_LAGS} FROM l GROUP BY 1) SELECT entity, n, round(n * (n + 2) * (" + " + ".join(f"(s{k} / v) * (s{k} / v) / (n - {k})" for k in range(1, 6)) + "), 5) AS q FROM q WHERE n > 20",
)
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(verification.ljung_box(_innovations(spark, sf_dir), ["entity"], ["ts", "seq"], "z", 5), "q", digits=5).where("n > 20")


@query(
    "a27_innovation_correlation",
    with_ctes("daily") + " SELECT a.stream_key AS first, b.stream_key AS second, round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM daily a JOIN daily b ON a.day = b.day AND a.stream_key < b.stream_key GROUP BY 1, 2",
)
def innovation_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.daily(spark, sf_dir)
    a, b = d.select("day", F.col("stream_key").alias("first"), F.col("x").alias("x1")), d.select("day", F.col("stream_key").alias("second"), F.col("x").alias("x2"))
    return a.join(b, "day").where("first < second").groupBy("first", "second").agg(F.round(scalars.correlation("x1", "x2"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query(
    "a29_acf_runs",
    _INNOVATIONS + ", l AS (SELECT entity, z, lag(z, 1) OVER w AS l1, lag(z, 2) OVER w AS l2, lag(z, 5) OVER w AS l5 FROM z WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)) SELECT entity, round(corr(z, l1), 6) AS acf_1, round(corr(z, l2), 6) AS acf_2, round(corr(z, l5), 6) AS acf_5, round(avg(CASE WHEN (z > 0) = (l1 > 0) THEN 1.0 ELSE 0.0 END), 6) AS same_sign FROM l GROUP BY 1",
)
def acf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.along(["entity"], ["ts", "seq"])
    z = _innovations(spark, sf_dir).select("entity", "z", *[F.lag("z", k).over(w).alias(f"l{k}") for k in (1, 2, 5)])
    same = F.when((F.col("z") > 0) == (F.col("l1") > 0), 1.0).otherwise(0.0)
    return z.groupBy("entity").agg(*[F.round(scalars.correlation("z", f"l{k}"), 6).alias(f"acf_{k}") for k in (1, 2, 5)], F.round(F.avg(same), 6).alias("same_sign"))


@query(
    "a31_filter_health",
    _INNOVATIONS + ", r AS (SELECT entity, z, lag(z) OVER (PARTITION BY entity ORDER BY ts, seq) AS b, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS k FROM z), h AS (SELECT entity, avg(z) AS m, stddev_samp(z) AS sd, corr(z, b) AS rho, avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0.0 END) AS tail FROM r WHERE k <= 100 GROUP BY 1) SELECT entity, round(m, 6) AS mean, round(sd, 6) AS sd, abs(m) < 0.5 AND sd > 0.5 AND sd < 2 AND abs(rho) < 0.3 AND tail < 0.15 AS healthy FROM h",
)
def filter_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.along(["entity"], ["ts", "seq"])
    back = Window.partitionBy("entity").orderBy(F.desc("ts"), F.desc("seq"))
    r = _innovations(spark, sf_dir).withColumns({"b": F.lag("z").over(w), "k": F.row_number().over(back)}).where("k <= 100")
    h = r.groupBy("entity").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"), scalars.correlation("z", "b").alias("rho"), F.avg((F.abs("z") > 2).cast("double")).alias("tail"))
    return h.select("entity", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.expr("abs(m) < 0.5 and s > 0.5 and s < 2 and abs(rho) < 0.3 and tail < 0.15").alias("healthy"))


@query("a33_wins", with_ctes("fc") + ", b AS (SELECT scenario, model_id, avg((p - outcome) * (p - outcome)) AS brier FROM fc GROUP BY 1, 2), w AS (SELECT scenario, arg_min(model_id, brier) AS winner FROM b GROUP BY 1) SELECT winner, count(*) AS wins FROM w GROUP BY 1")
def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.forecasts(spark, sf_dir).groupBy("scenario", "model_id").agg(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)).alias("brier"))
    return b.groupBy("scenario").agg(F.min_by("model_id", "brier").alias("winner")).groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))


@query("a37_distress", with_ctes("snap", "windows") + " SELECT w_start, round(avg(1 - expansion), 6) AS mean_distress, round(max(1 - expansion), 6) AS peak, min(CASE WHEN 1 - expansion >= 0.5 THEN day END) AS first_day FROM snap JOIN windows ON day BETWEEN w_start AND w_end WHERE label = 'contraction' GROUP BY 1")
def distress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots(spark, sf_dir), tables.windows(spark).where("label = 'contraction'")).withColumn("d", 1 - F.col("expansion"))
    return t.groupBy("w_start").agg(F.round(F.avg("d"), 6).alias("mean_distress"), F.round(F.max("d"), 6).alias("peak"), F.min(F.when(F.col("d") >= 0.5, F.col("day"))).alias("first_day"))


@query(
    "a39_verdict",
    with_ctes("fc") + ", b AS (SELECT scenario, model_id, sum(ln(CASE WHEN outcome = 1 THEN greatest(p, 0.01) ELSE greatest(1 - p, 0.01) END)) AS ll, avg(outcome) AS hold FROM fc GROUP BY 1, 2) SELECT a.scenario, a.model_id AS baseline, c.model_id AS candidate, CASE WHEN c.ll > a.ll AND c.hold >= a.hold THEN 'SHIPS' WHEN c.hold < a.hold THEN 'REGRESSES' ELSE 'NEUTRAL' END AS verdict FROM b a JOIN b c ON a.scenario = c.scenario AND a.model_id < c.model_id",
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("outcome") == 1, F.greatest("p", F.lit(0.01))).otherwise(F.greatest(1 - F.col("p"), F.lit(0.01)))
    b = tables.forecasts(spark, sf_dir).groupBy("scenario", "model_id").agg(F.sum(F.ln(p)).alias("ll"), F.avg("outcome").alias("hold"))
    a, c = b.toDF("scenario", "baseline", "ll_a", "hold_a"), b.toDF("scenario", "candidate", "ll_c", "hold_c")
    rule = F.when((F.col("ll_c") > F.col("ll_a")) & (F.col("hold_c") >= F.col("hold_a")), "SHIPS").when(F.col("hold_c") < F.col("hold_a"), "REGRESSES").otherwise("NEUTRAL")
    return a.join(c, "scenario").where("baseline < candidate").select("scenario", "baseline", "candidate", rule.alias("verdict"))


@query("a10_pit_histogram", with_ctes("fc") + f", h AS (SELECT scenario, {_BIN} AS bin, count(*) AS n FROM fc GROUP BY 1, 2) SELECT scenario, round(sum((n - t / 10.0) * (n - t / 10.0) / (t / 10.0)) + (10 - count(*)) * max(t) / 10.0, 4) AS chi_squared, count(*) AS bins FROM (SELECT *, sum(n) OVER (PARTITION BY scenario) AS t FROM h) GROUP BY 1")
def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-squared of ten bins against uniform; a bin without values adds the expected count."""
    h = verification.pit_histogram(tables.forecasts(spark, sf_dir), ["scenario"], F.col("p"))
    return h.select("scenario", F.round("chi_squared", 4).alias("chi_squared"), "bins")
