"""Triggers, comparisons, regime segments and small models over the observation tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants, distributions, scalars
from tidemark.operators import estimation, folds, joins, ranged, triggers, verification, windows
from tidemark.plans.registry import query
from tidemark.plans.verify import _INNOVATIONS, _innovations
from tidemark.sources import tables
from tidemark.sources.tables import with_ctes

#: trigger kind, action, priority
ACTIONS = (("anomaly", "review", 1), ("surge", "refresh", 2), ("lapse", "archive", 3))
_ACTIONS_SQL = "actions(kind, action, priority) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in ACTIONS) + ")"
_KIND = "CASE WHEN abs(z) > 3 THEN 'anomaly' WHEN z > 2 THEN 'surge' WHEN z < -0.97 THEN 'lapse' END"


def _kind(z: Column) -> Column:
    return F.when(F.abs(z) > 3, "anomaly").when(z > 2, "surge").when(z < -0.97, "lapse")


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _innovations(spark, sf_dir).withColumn("kind", _kind(F.col("z"))).where("kind is not null")


@query("e1_a34_triggers", _INNOVATIONS + f", {_ACTIONS_SQL}, t AS (SELECT *, {_KIND} AS kind FROM z) SELECT kind, action, priority, stream_key, count(*) AS n, max(seq) AS last_seq FROM t JOIN actions USING (kind) GROUP BY 1, 2, 3, 4")
def trigger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers by kind with their default actions, counted by stream."""
    actions = spark.createDataFrame(ACTIONS, "kind string, action string, priority int")
    t = _triggers(spark, sf_dir).join(F.broadcast(actions), "kind")
    return t.groupBy("kind", "action", "priority", "stream_key").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query("e5_structural_break", with_ctes("daily") + " SELECT day, count(*) AS uncovered FROM daily d WHERE NOT EXISTS (SELECT 1 FROM (VALUES (40.0), (50.0), (56.0)) b(level) WHERE abs(d.x - b.level) < 2.5) GROUP BY day HAVING count(*) >= 2")
def structural_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which at least two streams are near no branch's level."""
    levels = spark.createDataFrame([(40.0,), (50.0,), (56.0,)], "level double")  # a row for each branch
    d = tables.daily(spark, sf_dir)
    return d.join(F.broadcast(levels), F.abs(F.col("x") - F.col("level")) < 2.5, "left_anti").groupBy("day").agg(F.count(F.lit(1)).alias("uncovered")).where("uncovered >= 2")


@query("e7_numbered_history", _INNOVATIONS + f", t AS (SELECT *, {_KIND} AS kind, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS id, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS back FROM z WHERE {_KIND} IS NOT NULL) SELECT entity, id, seq, kind FROM t WHERE back <= 20")
def numbered_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's triggers numbered in order, the last 20 kept."""
    back = Window.partitionBy("entity").orderBy(F.desc("ts"), F.desc("seq"))
    t = _triggers(spark, sf_dir).withColumns({"id": F.row_number().over(windows.along(["entity"], ["ts", "seq"])).cast("long"), "back": F.row_number().over(back)})
    return t.where("back <= 20").select("entity", "id", "seq", "kind")


@query("e4_p16_stale_signals", with_ctes("obs") + ", s AS (SELECT entity, stream_key, max(ts) AS seen FROM obs GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM obs) SELECT entity, stream_key, round(date_diff('second', seen, now) / 3600.0, 4) AS age_hours, round(0.1 * power(2, date_diff('second', seen, now) / 3600.0 / 168), 6) AS r FROM s, n WHERE date_diff('second', seen, now) / 3600.0 > 168")
def stale_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals older than a half-life of 168 hours by event time, and the noise that their age gives them."""
    obs = tables.observations(spark, sf_dir)
    now = obs.agg(F.max("ts").alias("now"))
    s = obs.groupBy("entity", "stream_key").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(now))
    whole = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    s = s.withColumn("age", (whole("now") - whole("seen")) / 3600.0).where("age > 168")
    return s.select("entity", "stream_key", F.round("age", 4).alias("age_hours"), F.round(0.1 * F.pow(F.lit(2.0), F.col("age") / 168), 6).alias("r"))


@query(
    "w19_streak_fires",
    _INNOVATIONS.replace("WITH ", "WITH RECURSIVE ", 1) + ", n AS (SELECT entity, seq, z, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS k FROM z), f AS (SELECT entity, k, seq, CASE WHEN abs(z) > 0.8 THEN 1 ELSE 0 END AS run, false AS fired FROM n WHERE k = 1 UNION ALL SELECT n.entity, n.k, n.seq, CASE WHEN abs(n.z) <= 0.8 THEN 0 WHEN f.run + 1 >= 4 THEN 0 ELSE f.run + 1 END, abs(n.z) > 0.8 AND f.run + 1 >= 4 FROM f JOIN n ON n.entity = f.entity AND n.k = f.k + 1) SELECT entity, seq FROM f WHERE fired",
)
def streak_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four large innovations in a row fire once and start the count anew."""
    return ranged.scan(_innovations(spark, sf_dir), ["entity"], ["ts", "seq"], ranged.Streak("z", 0.8, 4)).where("fired = 1").select("entity", "seq")


@query(
    "w17_convergence",
    with_ctes("long") + ", p AS (SELECT a.day, a.regime AS first, b.regime AS second, abs(a.p - b.p) < 0.15 AS flag FROM long a JOIN long b ON a.day = b.day AND a.regime < b.regime), g AS (SELECT *, sum(CASE WHEN flag = b THEN 0 ELSE 1 END) OVER (PARTITION BY first, second ORDER BY day) AS run FROM (SELECT *, lag(flag) OVER (PARTITION BY first, second ORDER BY day) AS b FROM p)) SELECT first, second, min(day) AS first_day, count(*) AS n FROM g WHERE flag GROUP BY first, second, run HAVING count(*) >= 2",
)
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two snapshots in which two branches are close."""
    long = tables.snapshots_long(spark, sf_dir)
    a, b = long.select("day", F.col("regime").alias("first"), F.col("p").alias("p1")), long.select("day", F.col("regime").alias("second"), F.col("p").alias("p2"))
    pairs = a.join(b, "day").where("first < second")
    return triggers.convergence(pairs, ["first", "second"], ["day"], F.col("p1") - F.col("p2"), near=0.15, length=2).select("first", "second", "first_day", "n")


_TRUTH = ", t AS (SELECT s.*, coalesce(w.label, 'none') AS label FROM snap s LEFT JOIN windows w ON s.day BETWEEN w.w_start AND w.w_end)"


@query("a5_a42_signals", with_ctes("snap", "windows") + _TRUTH + " SELECT label, round(avg(CASE WHEN contraction > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS alarm_rate, round(avg(abs(contraction - 0.33)), 6) AS gap, CASE WHEN avg(contraction) > avg(stagflation) + 0.02 THEN 'BETTER' WHEN avg(contraction) < avg(stagflation) - 0.02 THEN 'WORSE' ELSE 'SAME' END AS verdict FROM t GROUP BY 1")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = joins.in_windows(tables.snapshots(spark, sf_dir), tables.windows(spark), how="left").withColumn("label", F.coalesce("label", F.lit("none")))
    c, s = F.avg("contraction"), F.avg("stagflation")
    return t.groupBy("label").agg(F.round(F.avg((F.col("contraction") > 0.5).cast("double")), 6).alias("alarm_rate"), F.round(F.avg(F.abs(F.col("contraction") - 0.33)), 6).alias("gap"), F.when(c > s + 0.02, "BETTER").when(c < s - 0.02, "WORSE").otherwise("SAME").alias("verdict"))


@query("a23_match_rate", with_ctes("long") + " SELECT regime, round(avg(CASE WHEN abs(p - 0.333) < 0.25 THEN 1.0 ELSE 0.0 END), 6) AS matched, count(*) AS n FROM long GROUP BY 1")
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.snapshots_long(spark, sf_dir).groupBy("regime").agg(F.round(F.avg((F.abs(F.col("p") - 0.333) < 0.25).cast("double")), 6).alias("matched"), F.count(F.lit(1)).alias("n"))


@query(
    "a32_era_persistence",
    with_ctes("long", "windows") + ", t AS (SELECT w.w_start, l.regime, l.p, lag(l.p) OVER (PARTITION BY w.w_start, l.regime ORDER BY l.day) AS b FROM long l JOIN windows w ON l.day BETWEEN w.w_start AND w.w_end) SELECT w_start, round(corr(CASE WHEN regime = 'expansion' THEN p END, CASE WHEN regime = 'expansion' THEN b END), 6) AS expansion, round(corr(CASE WHEN regime = 'contraction' THEN p END, CASE WHEN regime = 'contraction' THEN b END), 6) AS contraction FROM t WHERE b IS NOT NULL GROUP BY 1",
)
def era_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag-1 correlation of each regime in each window, one column for each regime."""
    t = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark))
    rho = windows.autocorrelation(t, ["w_start", "regime"], ["day"], "p")
    return rho.groupBy("w_start").pivot("regime", ["expansion", "contraction"]).agg(F.round(F.first("rho"), 6))


@query(
    "a36_model_correlation",
    with_ctes("monthly") + " SELECT a.series AS first, b.series AS second, CASE WHEN count(*) >= 10 THEN round(corr(a.x, -b.x), 6) END AS r, count(*) AS n FROM monthly a JOIN monthly b ON a.month = b.month AND a.series < b.series GROUP BY 1, 2",
)
def model_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation on common months, the second series with its sign turned; too few months give null."""
    m = tables.monthly_sales(spark, sf_dir)
    a, b = m.select("month", F.col("series").alias("first"), F.col("x").alias("x1")), m.select("month", F.col("series").alias("second"), (-F.col("x")).alias("x2"))
    g = a.join(b, "month").where("first < second").groupBy("first", "second").agg(scalars.correlation("x1", "x2").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("first", "second", F.when(F.col("n") >= 10, F.round("r", 6)).alias("r"), "n")


@query("a38_timeline", with_ctes("daily") + " SELECT day, string_agg(stream_key, ',' ORDER BY stream_key) AS streams, count(*) AS n FROM daily GROUP BY 1")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.daily(spark, sf_dir).groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("stream_key")), ",").alias("streams"), F.count(F.lit(1)).alias("n"))


@query("a40_success", _INNOVATIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS k FROM z) SELECT entity, round(arg_min(z, k), 6) AS first_z, round(arg_max(z, k), 6) AS last_z, avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0.0 END) < 0.2 AS success FROM r WHERE k > 10 GROUP BY 1")
def success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After ten warm-up rows: the first and last value, and whether anomalies stay under a fifth."""
    r = _innovations(spark, sf_dir).withColumn("k", F.row_number().over(windows.along(["entity"], ["ts", "seq"]))).where("k > 10")
    return r.groupBy("entity").agg(F.round(F.min_by("z", "k"), 6).alias("first_z"), F.round(F.max_by("z", "k"), 6).alias("last_z"), (F.avg((F.abs("z") > 2).cast("double")) < 0.2).alias("success"))


@query(
    "r21_sticky_smoothing",
    with_ctes("snap", recursive=True) + ", n AS (SELECT *, row_number() OVER (PARTITION BY year(day) ORDER BY day) AS k, year(day) AS y FROM snap), f AS (SELECT y, k, 1.0::DOUBLE / 3 AS a, 1.0::DOUBLE / 3 AS b, 1.0::DOUBLE / 3 AS c FROM n WHERE k = 1 UNION ALL SELECT n.y, n.k, ea / (ea + eb + ec), eb / (ea + eb + ec), ec / (ea + eb + ec) FROM (SELECT n.y, n.k, (n.expansion + 0.1) * (0.95 * f.a + 0.025 * f.b + 0.025 * f.c) AS ea, (n.stagflation + 0.1) * (0.025 * f.a + 0.95 * f.b + 0.025 * f.c) AS eb, (n.contraction + 0.1) * (0.025 * f.a + 0.025 * f.b + 0.95 * f.c) AS ec FROM f JOIN n ON n.y = f.y AND n.k = f.k + 1) n) SELECT y AS year, max(k) AS n, round(arg_max(a, k), 6) AS expansion, round(arg_max(b, k), 6) AS stagflation, round(arg_max(c, k), 6) AS contraction FROM f GROUP BY 1",
)
def sticky_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p moves with the evidence times what the sticky transitions carry over, year by year."""
    third = F.lit(1.0) / 3
    start = F.struct(F.lit(0).alias("k"), third.alias("a"), third.alias("b"), third.alias("c"))
    stay, move = 0.95, 0.025

    def step(s: Column, o: Column) -> Column:
        e = [(o[x] + 0.1) * ((stay - move) * s[y] + move) for x, y in (("expansion", "a"), ("stagflation", "b"), ("contraction", "c"))]
        total = e[0] + e[1] + e[2]
        first = s["k"] == 0  # the first snapshot only starts the recursion
        return F.struct((s["k"] + 1).alias("k"), *[F.when(first, third).otherwise(x / total).alias(n) for x, n in zip(e, "abc")])

    rows = folds.series(tables.snapshots(spark, sf_dir).withColumn("year", F.year("day")), ["year"], ["day"], "expansion", "stagflation", "contraction")
    rows = rows.withColumn("s", folds.final(F.col("obs"), start, step))
    return rows.select(F.col("year").cast("long").alias("year"), F.col("s.k").cast("long").alias("n"), F.round("s.a", 6).alias("expansion"), F.round("s.b", 6).alias("stagflation"), F.round("s.c", 6).alias("contraction"))


_STREAK = "g AS (SELECT *, sum(CASE WHEN top = b THEN 0 ELSE 1 END) OVER (ORDER BY day) AS run FROM (SELECT *, lag(top) OVER (ORDER BY day) AS b FROM d)), k AS (SELECT day, top, row_number() OVER (PARTITION BY run ORDER BY day) AS age FROM g)"


@query(
    "r28_duration_transitions",
    with_ctes("snap") + ", d AS (SELECT day, CASE WHEN expansion >= contraction THEN 'expansion' ELSE 'contraction' END AS top FROM snap), " + _STREAK + " SELECT day, top, age, round(greatest(0.97 - 0.2 / (1 + exp(-(age - 5) / 2.0)), 0.5), 6) AS stay FROM k",
)
def duration_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance to stay falls along a logistic ramp with the age of a regime."""
    s = tables.snapshots(spark, sf_dir).withColumn("g", F.lit(0))
    runs = windows.islands(s, ["g"], ["day"], F.when(F.col("expansion") >= F.col("contraction"), "expansion").otherwise("contraction"))
    age = F.row_number().over(Window.partitionBy("run").orderBy("day")).cast("long")
    k = runs.select("day", F.col("flag").alias("top"), age.alias("age"))
    return k.select("day", "top", "age", F.round(F.greatest(0.97 - 0.2 / (1 + F.exp(-(F.col("age") - 5) / 2.0)), F.lit(0.5)), 6).alias("stay"))


@query("m7_gram_matrix", with_ctes("daily") + " SELECT a.stream_key AS i, b.stream_key AS j, count(*) AS n, round(sum(a.x * b.x), 3) AS s FROM daily a JOIN daily b USING (day) WHERE a.stream_key <= b.stream_key GROUP BY 1, 2")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of every pair of streams: all that least squares needs."""
    d = tables.daily(spark, sf_dir)
    a, b = d.select("day", F.col("stream_key").alias("i"), F.col("x").alias("xi")), d.select("day", F.col("stream_key").alias("j"), F.col("x").alias("xj"))
    return a.join(b, "day").where("i <= j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("xi") * F.col("xj")), 3).alias("s"))


@query("m10_m13_noise_and_likelihood", _INNOVATIONS + " SELECT stream_key, round(var_pop(z), 6) AS r, round(sum(-0.5 * (ln(2 * pi() * 1.2) + z * z / 1.2)), 3) AS log_likelihood, round(greatest(power(count(*), 1.0 / 3), 2), 6) AS block_length FROM z GROUP BY 1")
def noise_and_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = -0.5 * (F.ln(F.lit(2 * np.pi * 1.2)) + F.col("z") * F.col("z") / 1.2)
    return _innovations(spark, sf_dir).groupBy("stream_key").agg(F.round(F.var_pop("z"), 6).alias("r"), F.round(F.sum(term), 3).alias("log_likelihood"), F.round(F.greatest(F.pow(F.count(F.lit(1)), F.lit(1.0 / 3)), F.lit(2.0)), 6).alias("block_length"))


@query("m1_m3_principal_loadings")
def principal_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of the streams' daily correlation matrix, loadings by varimax; the matrix has a row for each stream."""
    d = tables.daily(spark, sf_dir)
    a, b = d.select("day", F.col("stream_key").alias("i"), F.col("x").alias("xi")), d.select("day", F.col("stream_key").alias("j"), F.col("x").alias("xj"))
    cells = a.join(b, "day").groupBy("i", "j").agg(scalars.correlation("xi", "xj").alias("r"))

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.pivot(index="i", columns="j", values="r").fillna(0.0)
        value, vec = np.linalg.eigh(r.to_numpy())
        load = estimation.varimax(vec[:, ::-1][:, :3] * np.sqrt(np.maximum(value[::-1][:3], 0)))
        return pd.DataFrame([(k, c + 1, float(load[n, c]), float(value[::-1][c] / value.sum())) for n, k in enumerate(r.index) for c in range(load.shape[1])], columns=["stream_key", "component", "loading", "share"])

    return cells.groupBy(F.lit(0).alias("g")).applyInPandas(components, "stream_key string, component int, loading double, share double")


@query("r38_markov_switching")
def markov_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-state Gaussian switching model of each series' monthly returns; states are told apart by their means."""
    w = windows.along(["series"], ["month"])
    r = tables.monthly_sales(spark, sf_dir).withColumn("r", windows.log_return(F.col("x"), w)).where("r is not null")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        mean, sd, stay, p = estimation.switching_model(pdf["r"].to_numpy(float))
        return pd.DataFrame({"series": pdf["series"], "month": pdf["month"], "p_low": p, "low_mean": mean[0], "high_mean": mean[1], "stay": stay})

    return r.groupBy("series").applyInPandas(fit, "series string, month date, p_low double, low_mean double, high_mean double, stay double")


@query("a11_berkowitz")
def berkowitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood ratio of an AR(1) on the normal scores of forecasts against independent standard ones, by entity, with its p-value."""
    z = tables.forecasts(spark, sf_dir).withColumn("z", distributions.normal_quantile(F.col("p") - 0.01))
    g = verification.berkowitz(z, ["scenario", "model_id"], "seq", "z")
    return g.withColumn("p_value", distributions.chi_squared_p("lr", F.lit(3)))


@query("a25_whiteness_p_values")
def whiteness_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ljung-Box statistics of each entity with their chi-squared p-values."""
    q = verification.ljung_box(_innovations(spark, sf_dir), ["entity"], ["ts", "seq"], "z", 5).where("n > 20")
    return q.withColumn("p_value", distributions.chi_squared_p("q", F.lit(5))).withColumn("white", F.col("p_value") > 0.05)


@query("a35_covariance_health")
def covariance_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition number and effective rank of the streams' daily correlations, a matrix with a row for each stream."""
    d = tables.daily(spark, sf_dir)
    a, b = d.select("day", F.col("stream_key").alias("i"), F.col("x").alias("xi")), d.select("day", F.col("stream_key").alias("j"), F.col("x").alias("xj"))
    cells = a.join(b, "day").groupBy("i", "j").agg(scalars.correlation("xi", "xj").alias("r"))

    def health(pdf: pd.DataFrame) -> pd.DataFrame:
        value = np.maximum(np.linalg.eigvalsh(pdf.pivot(index="i", columns="j", values="r").fillna(0.0).to_numpy()), 1e-12)
        share = value / value.sum()
        return pd.DataFrame([(float(value.max() / value.min()), float(np.exp(-(share * np.log(share)).sum())))], columns=["condition", "effective_rank"])

    return cells.groupBy(F.lit(0).alias("g")).applyInPandas(health, "condition double, effective_rank double")


@query(
    "w21_boundary_approach",
    with_ctes("long", recursive=True) + ", n AS (SELECT regime, day, p, row_number() OVER (PARTITION BY regime ORDER BY day) AS k FROM long), f AS (SELECT regime, k, day, p, 0 AS run, false AS fired FROM n WHERE k = 1 UNION ALL SELECT n.regime, n.k, n.day, n.p, CASE WHEN NOT (n.p < f.p AND n.p > 0.3 AND n.p - 0.3 < 0.2) THEN 0 WHEN f.run + 1 >= 2 THEN 0 ELSE f.run + 1 END, n.p < f.p AND n.p > 0.3 AND n.p - 0.3 < 0.2 AND f.run + 1 >= 2 FROM f JOIN n ON n.regime = f.regime AND n.k = f.k + 1) SELECT regime, day FROM f WHERE fired",
)
def boundary_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two falls in a row that come near the bound from above fire once and start the count anew."""
    return ranged.scan(tables.snapshots_long(spark, sf_dir), ["regime"], ["day"], ranged.Approach("p", 0.3, 0.2, 2)).where("fired = 1").select("regime", "day")


@query("w14_raw_proxies", with_ctes("obs") + " SELECT entity, stream_key, seq, round(sum(raw) OVER w20, 6) AS sum_20, round(raw - lag(raw, 3) OVER w, 6) AS change_3, round(raw - lag(raw, 5) OVER w, 6) AS change_5 FROM obs WHERE raw IS NOT NULL WINDOW w AS (PARTITION BY entity, stream_key ORDER BY ts, seq), w20 AS (PARTITION BY entity, stream_key ORDER BY ts, seq ROWS 19 PRECEDING)")
def raw_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and changes over numbers of observations of each stream."""
    w, raw = windows.along(["entity", "stream_key"], ["ts", "seq"]), F.col("raw")
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    return obs.select("entity", "stream_key", "seq", F.round(F.sum(raw).over(w.rowsBetween(-19, 0)), 6).alias("sum_20"), *[F.round(windows.difference(raw, w, k), 6).alias(f"change_{k}") for k in (3, 5)])


@query("r26_regime_noise", with_ctes("snap") + " SELECT day, round(expansion * 1.0 + stagflation * 2.0 + contraction * 3.0, 6) AS financial, round(expansion * 1.0 + stagflation * 2.5 + contraction * 2.0, 6) AS commodity, round(expansion * 1.0 + stagflation * 1.5 + contraction * 2.0, 6) AS q_scale FROM snap")
def regime_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise multipliers blended by the regimes' probabilities."""
    p = [F.col(x) for x in ("expansion", "stagflation", "contraction")]
    blend = lambda values: F.round(p[0] * values[0] + p[1] * values[1] + p[2] * values[2], 6)
    by_class = lambda k: [constants.REGIME_NOISE[r][k] for r in constants.REGIMES]
    return tables.snapshots(spark, sf_dir).select("day", blend(by_class("financial")).alias("financial"), blend(by_class("commodity")).alias("commodity"), blend([constants.REGIME_Q[r] for r in constants.REGIMES]).alias("q_scale"))
