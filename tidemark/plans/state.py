"""Ordered folds, filters, regime scoring and estimation over the observation tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import estimation, filters, folds, lockstep
from tidemark.plans.registry import query
from tidemark.sources import shared, tables
from tidemark.sources.tables import with_ctes
from tidemark.streaming import online

_KEYS, _ORDER = ["entity", "stream_key"], ["ts", "seq"]
_ALPHA = "(1 - exp(-ln(2) / 20.0))"
_NUMBERED = with_ctes("obs", recursive=True) + ", n AS (SELECT entity, stream_key, ts, seq, raw, row_number() OVER (PARTITION BY entity, stream_key ORDER BY ts, seq) AS k FROM obs WHERE raw IS NOT NULL)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.observations(spark, sf_dir).where("raw is not null")


def _normalised_sql(variance: str, floor: str) -> str:
    v = variance.format(a=_ALPHA, x="n.raw", m="f.m")
    return _NUMBERED + f""", f AS (
  SELECT entity, stream_key, k, seq, 50.0::DOUBLE + {_ALPHA} * (raw - 50.0) AS m, {variance.format(a=_ALPHA, x='raw', m='50.0::DOUBLE').replace('f.v', '2500.0::DOUBLE')} AS v, (raw - 50.0) / greatest(sqrt(2500.0), {floor}) AS z FROM n WHERE k = 1
  UNION ALL
  SELECT n.entity, n.stream_key, n.k, n.seq, f.m + {_ALPHA} * (n.raw - f.m), {v}, (n.raw - f.m) / greatest(sqrt(f.v), {floor}) FROM f JOIN n ON n.entity = f.entity AND n.stream_key = f.stream_key AND n.k = f.k + 1
) SELECT entity, stream_key, seq, round(m, 6) AS m, round(z, 6) AS z FROM f"""


def _normalised(spark: SparkSession, sf_dir: str, floor: float, rolling: bool) -> DataFrame:
    a = 1 - 2 ** (-1 / 20)
    z = folds.normalised(_observed(spark, sf_dir), _KEYS, _ORDER, "raw", a, 50.0, 2500.0, floor, rolling)
    return z.select("entity", "stream_key", "seq", F.round("m", 6).alias("m"), F.round("z", 6).alias("z"))


@query("r1_adaptive_normaliser", _normalised_sql("(1 - {a}) * (f.v + {a} * power({x} - {m}, 2))", "0.01"))
def adaptive_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, 0.01, rolling=False)


@query("r2_rolling_normaliser", _normalised_sql("(1 - {a}) * f.v + {a} * power({x} - ({m} + {a} * ({x} - {m})), 2)", "1e-8"))
def rolling_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, 1e-8, rolling=True)


@query(
    "p5_novelty",
    _NUMBERED + ", f AS (SELECT entity, stream_key, k, seq, raw AS last, true AS ok FROM n WHERE k = 1 UNION ALL SELECT n.entity, n.stream_key, n.k, n.seq, CASE WHEN abs(n.raw - f.last) / greatest(abs(f.last), abs(n.raw), 1e-10) > 0.25 THEN n.raw ELSE f.last END, abs(n.raw - f.last) / greatest(abs(f.last), abs(n.raw), 1e-10) > 0.25 FROM f JOIN n ON n.entity = f.entity AND n.stream_key = f.stream_key AND n.k = f.k + 1) SELECT entity, stream_key, seq FROM f WHERE ok",
)
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ by a quarter or more from the last accepted one."""
    return folds.novel(_observed(spark, sf_dir), _KEYS, _ORDER, "raw", 0.25).select("entity", "stream_key", "seq")


@query(
    "e6_cooldown",
    _NUMBERED + ", e AS (SELECT entity, ts, seq, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS k FROM n WHERE raw > 60), f AS (SELECT entity, k, ts, seq, ts AS last, true AS ok FROM e WHERE k = 1 UNION ALL SELECT e.entity, e.k, e.ts, e.seq, CASE WHEN e.ts - f.last >= INTERVAL 24 HOUR THEN e.ts ELSE f.last END, e.ts - f.last >= INTERVAL 24 HOUR FROM f JOIN e ON e.entity = f.entity AND e.k = f.k + 1) SELECT entity, seq FROM f WHERE ok",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of large values, at most one in 24 hours for each entity."""
    return folds.cooled(_observed(spark, sf_dir).where("raw > 60").select("entity", "ts", "seq"), ["entity"], ["ts", "seq"], 86_400).select("entity", "seq")


@query(
    "r25_gas_noise",
    _NUMBERED + ", f AS (SELECT entity, stream_key, k, greatest(least(0.05 * ln(0.8) + 0.95 * ln(0.8) + 0.1 * (least(raw / 40.0, 50.0) - 1), 4.0), -6.0) AS r FROM n WHERE k = 1 UNION ALL SELECT n.entity, n.stream_key, n.k, greatest(least(0.05 * ln(0.8) + 0.95 * f.r + 0.1 * (least(n.raw / 40.0, 50.0) - 1), 4.0), -6.0) FROM f JOIN n ON n.entity = f.entity AND n.stream_key = f.stream_key AND n.k = f.k + 1) SELECT entity, stream_key, max(k) AS n, round(arg_max(r, k), 6) AS log_r FROM f GROUP BY 1, 2",
)
def gas_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _observed(spark, sf_dir).withColumn("ratio", F.col("raw") / 40.0)
    out = folds.gas_noise(obs, _KEYS, _ORDER, "ratio", math.log(0.8), 0.95, 0.1, 50.0, -6.0, 4.0)
    return out.select("entity", "stream_key", F.col("n").cast("long").alias("n"), F.round("log_r", 6).alias("log_r"))


@query("r24_gap_noise", with_ctes("daily") + ", g AS (SELECT day, stream_key, date_diff('day', lag(day) OVER (PARTITION BY stream_key ORDER BY day), day) AS gap FROM daily WHERE x > 48) SELECT day, stream_key, round(CASE WHEN gap > 1 THEN 0.8 * (1 + 0.05 * ln(gap)) ELSE 0.8 END, 6) AS r FROM g")
def gap_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation noise grows with the days since the stream was last seen."""
    w = Window.partitionBy("stream_key").orderBy("day")
    g = tables.daily(spark, sf_dir).where("x > 48").withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    return g.select("day", "stream_key", F.round(F.when(F.col("gap") > 1, 0.8 * (1 + 0.05 * F.ln("gap"))).otherwise(0.8), 6).alias("r"))


_SOFT = ", s AS (SELECT day, -sqrt(power(expansion - 0.6, 2) + power(contraction - 0.1, 2)) AS s1, -sqrt(power(expansion - 0.3, 2) + power(contraction - 0.5, 2)) AS s2, -sqrt(power(expansion - 0.2, 2) + power(contraction - 0.2, 2)) AS s3, expansion FROM snap), e AS (SELECT *, greatest(s1, s2, s3) AS top FROM s), x AS (SELECT day, expansion, exp((s1 - top) / 0.5) AS e1, exp((s2 - top) / 0.5) AS e2, exp((s3 - top) / 0.5) AS e3 FROM e)"


@query(
    "r15_r16_sub_regimes",
    with_ctes("snap") + _SOFT + " SELECT day, round(e1 / (e1 + e2 + e3), 4) AS goldilocks, round(e2 / (e1 + e2 + e3), 4) AS boom, round(e3 / (e1 + e2 + e3), 4) AS disinflation, expansion >= 0.2 AS active, round(expansion * e1 / (e1 + e2 + e3), 4) AS joint, round(0.6 * expansion + 0.4 * e1 / (e1 + e2 + e3), 4) AS ensemble FROM x",
)
def sub_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to sub-regime targets, softmax at temperature one half, joint with the parent's probability, ensemble of both."""
    s = tables.snapshots(spark, sf_dir)
    away = lambda e, c: -F.sqrt(F.pow(F.col("expansion") - e, 2) + F.pow(F.col("contraction") - c, 2))
    a, b, c = scalars.softmax([away(0.6, 0.1), away(0.3, 0.5), away(0.2, 0.2)], 0.5)
    return s.select("day", F.round(a, 4).alias("goldilocks"), F.round(b, 4).alias("boom"), F.round(c, 4).alias("disinflation"), (F.col("expansion") >= 0.2).alias("active"), F.round(F.col("expansion") * a, 4).alias("joint"), F.round(0.6 * F.col("expansion") + 0.4 * a, 4).alias("ensemble"))


@query(
    "r29_state_transitions",
    with_ctes("snap") + ", r AS (SELECT day, 0.01 + 0.09 / (1 + exp(-(3 * contraction - expansion))) AS out1, 0.01 + 0.05 / (1 + exp(-(2 * stagflation - expansion))) AS out2 FROM snap), d AS (SELECT *, greatest(1 - out1 - out2, 0.5) AS stay FROM r) SELECT day, round(stay / (stay + out1 + out2), 6) AS stay, round(out1 / (stay + out1 + out2), 6) AS to_contraction, round(out2 / (stay + out1 + out2), 6) AS to_stagflation FROM d",
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the transition matrix whose exits follow logistic rules of the state."""
    e, s, c = (F.col(x) for x in ("expansion", "stagflation", "contraction"))
    out1, out2 = 0.01 + 0.09 * scalars.logistic(3 * c - e), 0.01 + 0.05 * scalars.logistic(2 * s - e)
    rows = tables.snapshots(spark, sf_dir).select("day", out1.alias("out1"), out2.alias("out2")).withColumn("stay", F.greatest(1 - F.col("out1") - F.col("out2"), F.lit(0.5)))
    total = F.col("stay") + F.col("out1") + F.col("out2")
    return rows.select("day", F.round(F.col("stay") / total, 6).alias("stay"), F.round(F.col("out1") / total, 6).alias("to_contraction"), F.round(F.col("out2") / total, 6).alias("to_stagflation"))


@query(
    "r20_scorecards",
    with_ctes("snap") + ", w AS (SELECT day, expansion, stagflation, contraction, expansion - lag(expansion, 5) OVER (ORDER BY day) AS slope FROM snap) SELECT day, round(greatest(expansion - 0.3, 0) * 2 + greatest(coalesce(slope, 0), 0) - greatest(contraction - 0.4, 0), 6) AS growth, round(greatest(stagflation - 0.3, 0) * 2 + greatest(-coalesce(slope, 0), 0), 6) AS pressure FROM w",
)
def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive hinge terms of levels and slopes; the window is over a panel of one row for each date."""
    hinge = lambda x: F.greatest(x, F.lit(0.0))
    slope = F.coalesce(F.col("expansion") - F.lag("expansion", 5).over(Window.orderBy("day")), F.lit(0.0))
    s = tables.snapshots(spark, sf_dir).withColumn("slope", slope)
    growth = hinge(F.col("expansion") - 0.3) * 2 + hinge(F.col("slope")) - hinge(F.col("contraction") - 0.4)
    return s.select("day", F.round(growth, 6).alias("growth"), F.round(hinge(F.col("stagflation") - 0.3) * 2 + hinge(-F.col("slope")), 6).alias("pressure"))


@query(
    "f_scalars",
    with_ctes("obs") + " SELECT seq, round(1 - exp(-ln(2) / greatest(raw, 1.0)), 6) AS alpha, round(1 / (1 + exp(-(raw / 100 - 0.5))), 6) AS logistic, round(least(greatest(raw, 5), 90), 6) AS clamped, round(power(2, raw / 50.0), 6) AS decay, round(power(abs(raw / 500), 1.0 / 22), 6) AS daily, round(1 / (1 + raw), 6) AS influence, round(exp(-raw * raw / 5000) / sqrt(2 * pi() * 2500), 9) AS density FROM obs WHERE raw IS NOT NULL",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    cols = {"alpha": scalars.alpha(raw), "logistic": scalars.logistic(raw / 100 - 0.5), "clamped": scalars.clamp(raw, 5.0, 90.0), "decay": scalars.decay(raw, 50.0), "daily": scalars.daily_persistence(raw / 500), "influence": 1 / (1 + raw)}
    return _observed(spark, sf_dir).select("seq", *[F.round(v, 6).alias(k) for k, v in cols.items()], F.round(scalars.normal_density(raw, F.lit(2500.0)), 9).alias("density"))


@query("t2_top_k", with_ctes("obs") + ", r AS (SELECT stream_key, seq, raw, row_number() OVER (PARTITION BY stream_key ORDER BY abs(raw) DESC, seq) AS k FROM obs WHERE raw IS NOT NULL) SELECT stream_key, k, seq, round(raw, 6) AS raw FROM r WHERE k <= 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_key").orderBy(F.abs("raw").desc(), "seq")
    return _observed(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 5").select("stream_key", F.col("k").cast("long").alias("k"), "seq", F.round("raw", 6).alias("raw"))


@query("u_set_operations", "SELECT o_custkey AS k, 'both' AS side FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'P' UNION ALL (SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'F')")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    both, only = of("F").intersect(of("P")), of("P").subtract(of("F"))
    return both.withColumn("side", F.lit("both")).union(only.withColumn("side", F.lit("only")))


@query(
    "m8_lagged_regressions",
    with_ctes("daily") + " SELECT a.stream_key AS cause, b.stream_key AS effect, round(regr_slope(b.x, a.x), 6) AS slope, round(regr_intercept(b.x, a.x), 6) AS intercept, round(regr_r2(b.x, a.x), 6) AS r2, count(*) AS n FROM daily a JOIN daily b ON b.day = a.day + 1 WHERE a.stream_key <> b.stream_key GROUP BY 1, 2",
)
def lagged_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first-order regression of every ordered pair of streams, from sums of products."""
    d = tables.daily(spark, sf_dir)
    a = d.select(F.date_add("day", 1).alias("day"), F.col("stream_key").alias("cause"), F.col("x").alias("xa"))
    b = d.select("day", F.col("stream_key").alias("effect"), F.col("x").alias("xb"))
    g = a.join(b, "day").where("cause <> effect").groupBy("cause", "effect")
    return g.agg(F.round(F.regr_slope("xb", "xa"), 6).alias("slope"), F.round(F.regr_intercept("xb", "xa"), 6).alias("intercept"), F.round(F.regr_r2("xb", "xa"), 6).alias("r2"), F.count(F.lit(1)).alias("n"))


def _daily_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, day, ord, stream_key, z): the daily means of each entity's streams."""
    obs = _observed(spark, sf_dir).withColumn("entity", F.col("entity").cast("long"))
    dim = F.broadcast(tables.stream_dimension(spark).select("stream_key", "ord"))
    d = obs.groupBy("entity", F.to_date("ts").alias("day"), "stream_key").agg(((F.avg("raw") - 50) / 50).alias("z"))
    return d.join(dim, "stream_key").select("entity", "day", "ord", "stream_key", "z")


@query("r32_replay")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kalman filter and regime bank over every entity: factors, probabilities, likelihood, anomalies by snapshot."""
    return lockstep.replay(_daily_z(spark, sf_dir), filters.configs([{"config_id": "base"}]))


@query("r43_sweep")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the engine side by side: final states and which one explains the data best."""
    variants = filters.configs([
        {"config_id": "base"}, {"config_id": "r_half", "r_scale": 0.5}, {"config_id": "r_double", "r_scale": 2.0}, {"config_id": "q_double", "q_scale": 2.0},
        {"config_id": "no_pull", "pull": 0.0}, {"config_id": "ceiling_1", "ceiling": 1.0}, {"config_id": "gas", "gas": True}, {"config_id": "gap", "gap": True},
        {"config_id": "blended", "blended": True}, {"config_id": "shared_shocks", "shared_shocks": True}, {"config_id": "regime_noise", "regime_noise": True}, {"config_id": "cumulate", "cumulate": True},
        {"config_id": "full", "regime_noise": True, "state_tpm": True, "cumulate": True, "gas": True, "shared_shocks": True},
        {"config_id": "duration", "duration_tpm": True}, {"config_id": "no_mixing", "mixing": False}, {"config_id": "carry_prior", "carry_prior": True},
        *filters.SWEEP,
    ])
    last = lockstep.replay(_daily_z(spark, sf_dir), variants, every=1_000_000).groupBy("entity", "config_id").agg(F.max_by("log_likelihood", "step").alias("ll"), F.max("anomalies").alias("anomalies"))
    best = Window.partitionBy("entity").orderBy(F.desc("ll"), "config_id")
    return last.withColumn("rank", F.row_number().over(best)).select("entity", "config_id", F.round("ll", 4).alias("ll"), "anomalies", "rank")


@query("r17_r19_nested_regimes")
def nested_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockstep.nested(_daily_z(spark, sf_dir))


@query("r36_em_transitions")
def em_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.snapshots(spark, sf_dir).withColumn("year", F.year("day"))
    return estimation.transitions_by_group(s, ["year"], "day", ["expansion", "stagflation", "contraction"])


@query("r37_isotonic")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimation.isotonic(tables.forecasts(spark, sf_dir), ["scenario"])


@query("r40_r41_bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of mean probabilities from 200 stationary block replicates."""
    long = tables.snapshots_long(spark, sf_dir)
    return estimation.interval(estimation.bootstrap_means(long, ["regime"], "day", "p", 200), ["regime"])


@query("s4_online_replay")
def online_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a stream over written daily observations, a row for each entity and day; files cut days in two, and each is a micro-batch."""
    path = shared.folder(spark, "daily-z")
    _daily_z(spark, sf_dir).repartitionByRange(3, "day", "ord").write.parquet(path)
    stream = online.online_replay(online.files(spark, path, online.INPUT_SCHEMA, 1), filters.Config(), lateness=366)
    return online.states(online.run_to_end(spark, stream, "online-replay"))
