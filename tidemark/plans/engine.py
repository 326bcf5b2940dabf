"""The engine's own records as queries: updates and their diagnostics, warnings, sub-regime evidence, signals, checkpoints, estimation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import distributions, scalars
from tidemark.operators import estimation, filters, joins, lockstep, regimes, triggers, verification, windows
from tidemark.plans.registry import query
from tidemark.plans.state import _daily_z
from tidemark.plans.verify import _INNOVATIONS, _innovations
from tidemark.sources import tables
from tidemark.sources.tables import with_ctes

_REGIMES = ["expansion", "stagflation", "contraction"]


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockstep.updates(_daily_z(spark, sf_dir), filters.configs([{"config_id": "base"}]))


@query("d7_state_updates")
def state_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measurement update of every entity, with its innovation, variance and the gain's largest factor."""
    u = _updates(spark, sf_dir)
    top = F.array_position(F.transform("gain", F.abs), F.array_max(F.transform("gain", F.abs)))
    return u.select("entity", "day", "n", "stream_key", "observed", "predicted", "innovation", "s", "z", (F.abs("z") > c.ANOMALY_THRESHOLD).alias("is_anomalous"), F.element_at(F.array(*[F.lit(x) for x in c.FACTORS]), top.cast("int")).alias("most_informed"))


@query("a10_pit_uniformity")
def pit_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability integral transforms of each stream's innovations against uniform, with p-value."""
    u = _updates(spark, sf_dir).select("stream_key", distributions.normal_cdf("z").alias("pit"))
    h = verification.pit_histogram(u, ["stream_key"], F.col("pit"))
    return h.withColumn("p_value", distributions.chi_squared_p("chi_squared", F.lit(9))).withColumn("uniform", F.col("p_value") > 0.05)


@query("a11_innovation_berkowitz")
def innovation_berkowitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Berkowitz's test on each entity's standardised innovations in their order."""
    g = verification.berkowitz(_updates(spark, sf_dir), ["entity"], "n", "z")
    return g.withColumn("p_value", distributions.chi_squared_p("lr", F.lit(3)))


@query("a24_innovation_bias")
def innovation_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each stream: mean innovation and whether it is small, spread, tails, mean log likelihood, and the tests of normality."""
    u = _updates(spark, sf_dir)
    ll = -0.5 * (F.ln(2 * F.pi() * F.col("s")) + F.col("z") * F.col("z"))
    g = u.groupBy("stream_key").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd"), F.skewness("z").alias("skew"), F.kurtosis("z").alias("kurtosis"), F.avg(ll).alias("mean_ll"))
    g = g.withColumn("unbiased", F.abs("mean") < 0.2)
    g = g.withColumn("jarque_bera", F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4))
    return g.withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


@query("a28_segmented_whiteness")
def segmented_whiteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ljung-Box of each entity's innovations by the regime that led at the update, segments of more than 20."""
    lead = F.element_at(F.array(*[F.lit(r) for r in c.REGIMES]), F.array_position("probabilities", F.array_max("probabilities")).cast("int"))
    u = _updates(spark, sf_dir).select("entity", F.col("n").alias("at"), "z", lead.alias("regime"))
    q = verification.segmented_whiteness(u, ["entity"], "regime", ["at"], "z")
    return q.withColumn("p_value", distributions.chi_squared_p("q", F.lit(10))).withColumn("white", F.col("p_value") > 0.05)


@query("a30_anomaly_rate", _INNOVATIONS + " SELECT stream_key, sum(CASE WHEN abs(z) > 1.5 THEN 1 ELSE 0 END) AS anomalies, round(sum(CASE WHEN abs(z) > 1.5 THEN 1 ELSE 0 END) / greatest(count(*) - 540, 1.0), 6) AS rate FROM z GROUP BY 1")
def anomaly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies over the updates less an assumed warm-up of 180 days of three updates, as the engine reports it."""
    n = F.sum((F.abs("z") > 1.5).cast("long"))
    return _innovations(spark, sf_dir).groupBy("stream_key").agg(n.alias("anomalies"), F.round(n / F.greatest(F.count(F.lit(1)) - 540, F.lit(1.0)), 6).alias("rate"))


@query("a14_diagnostic_suite")
def diagnostic_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of each regime's probabilities against the windows' truth, with sharpness and detection lags, a row for each number."""
    truth = joins.in_windows(tables.snapshots(spark, sf_dir), tables.windows(spark), how="left").select("day", F.coalesce("label", F.lit("expansion")).alias("truth"), *_REGIMES).dropDuplicates(["day"])
    long = truth.unpivot(["day", "truth"], _REGIMES, "regime", "p").withColumn("outcome", (F.col("regime") == F.col("truth")).cast("int"))
    top = truth.select(F.greatest(*_REGIMES).alias("m")).agg(F.avg("m").alias("sharpness"), F.stddev_pop("m").alias("sharpness_sd")).withColumn("regime", F.lit("all")).unpivot(["regime"], ["sharpness", "sharpness_sd"], "metric", "value")
    hits = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark)).where("regime = label").groupBy("w_start", "regime").agg(F.min(F.when(F.col("p") >= 0.5, F.col("day"))).alias("first"))
    lags = hits.select("regime", F.concat(F.lit("weeks_to_half_"), F.col("w_start").cast("string")).alias("metric"), (F.datediff("first", "w_start") / 7.0).alias("value"))
    return verification.suite(long).unionByName(top).unionByName(lags)


@query("e3_early_warnings")
def early_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies, innovation streaks, surprise on several factors and nearing boundaries at the engine's thresholds and cooldowns."""
    return triggers.early_warnings(_updates(spark, sf_dir).withColumn("at", F.col("day").cast("timestamp")))


#: The five streams as factor levels of one panel: a row for each date.
_PANEL = (("inflation", "US_CPI_YOY", 1), ("growth", "RETAIL_SALES", 1), ("labor", "UNEMPLOYMENT_RATE", -1), ("finance", "SP500", 1), ("housing", "INITIAL_CLAIMS", -1))
_LEVEL_SQL = with_ctes("daily") + ", levels AS (SELECT day, " + ", ".join(f"coalesce(max(CASE WHEN stream_key = '{s}' THEN {sign} * (x - 50) / 10 END), 0.0) AS {k}" for k, s, sign in _PANEL) + " FROM daily GROUP BY day)"
_SLOPED = {"inflation_slope": ("inflation", 13), "growth_slope": ("growth", 13), "finance_slope": ("finance", 13), "housing_slope": ("housing", 13), "growth_slope_5": ("growth", 5), "labor_slope_5": ("labor", 5)}
_FEATURE_SQL = _LEVEL_SQL + ", sloped AS (SELECT *, " + ", ".join(f"coalesce((({k} - lag({k}, {n}) OVER (ORDER BY day)) / {n}) * 100, 0.0) AS {name}" for name, (k, n) in _SLOPED.items()) + ", 0.0 AS commodity, 0.0 AS sentiment, 0.0 AS policy, " + ", ".join(f"0.0 AS {k}" for k in regimes.OTHERS if k not in _SLOPED) + " FROM levels), features AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in regimes.DERIVED.items()) + " FROM sloped)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.daily(spark, sf_dir)
    return d.groupBy("day").agg(*[F.coalesce(F.max(F.when(F.col("stream_key") == s, sign * (F.col("x") - 50) / 10)), F.lit(0.0)).alias(k) for k, s, sign in _PANEL])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("day")  # a row for each date
    rows = _levels(spark, sf_dir).select("*", *[(windows.slope(F.col(k), w, n) * 100).alias(name) for name, (k, n) in _SLOPED.items()])
    return rows.withColumns({k: F.lit(0.0) for k in ("commodity", "sentiment", "policy", *[x for x in regimes.OTHERS if x not in _SLOPED])})


@query("r20_evidence", _FEATURE_SQL + " SELECT day, " + ", ".join(f"round({regimes.evidence_sql(k)}, 6) AS {k}" for k in c.EVIDENCE) + " FROM features")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven scorecards over the panel's levels and slopes."""
    return regimes.evidence(_features(spark, sf_dir)).select("day", *[F.round(k, 6).alias(k) for k in c.EVIDENCE])


@query("r21_smoothed_evidence")
def smoothed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each regime's sub-regimes from the scorecards, carried on by sticky transitions."""
    rows = regimes.shares(regimes.evidence(_features(spark, sf_dir))).withColumn("g", F.lit(0))
    out = None
    for regime in c.REGIMES:
        one = regimes.smoothed(rows, ["g"], ["day"], regime).drop("g").unpivot(["day"], list(c.SUB_REGIMES[regime]), "sub_regime", "p").withColumn("regime", F.lit(regime))
        out = one if out is None else out.unionByName(one)
    return out.select("day", "regime", "sub_regime", F.round("p", 4).alias("p"))


def _discriminant_sql() -> str:
    at = {v: k for k, v in regimes.LEVELS.items()}
    known, parts = {k for k, _, _ in _PANEL}, []
    for regime in c.REGIMES:
        goals, weight = regimes.targets(regime)
        away = {k: "-sqrt(" + " + ".join(f"{float(w)!r} * power({at[f] if at[f] in known else 0.0} - ({float(t[i])!r}), 2)" for i, (f, w) in enumerate(zip(c.FACTORS, weight)) if w) + ")" for k, t in goals.items()}
        total = " + ".join(f"exp(({x}) / {c.SOFTMAX_TEMPERATURE})" for x in away.values())
        parts += [f"round(exp(({x}) / {c.SOFTMAX_TEMPERATURE}) / ({total}), 4) AS {k}" for k, x in away.items()]
    return _LEVEL_SQL + " SELECT day, " + ", ".join(parts) + " FROM levels"


@query("r15_discriminant", _discriminant_sql())
def discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-regimes by weighted distance of the panel's levels to their targets."""
    rows = _levels(spark, sf_dir)
    x = F.array(*[F.col(k) if k in rows.columns else F.lit(0.0) for k in regimes.LEVELS])
    cols = {k: v for r in c.REGIMES for k, v in regimes.discriminant(x, r).items()}
    return rows.select("day", *[F.round(v, 4).alias(k) for k, v in cols.items()])


def _exit_sql() -> str:
    at = {v: k for k, v in regimes.LEVELS.items()}
    known = {k for k, _, _ in _PANEL}
    p = {(a, b): f"({low} + {high - low} / (1 + exp(-(" + " + ".join([f"{w} * {at[f]}" for f, w in weights.items() if at[f] in known] or ["0"]) + "))))" for a, b, weights, low, high in c.EXIT_RULES}
    cols = []
    for a in range(3):
        others = [p[a, b] for b in range(3) if b != a]
        stay = f"greatest(1 - {' - '.join(others)}, {c.LEAST_STAY})"
        cols += [f"round({stay if a == b else p[a, b]} / ({stay} + {' + '.join(others)}), 6) AS t{a}{b}" for b in range(3)]
    return _LEVEL_SQL + " SELECT day, " + ", ".join(cols) + " FROM levels"


@query("r29_exit_rules", _exit_sql())
def exit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition matrix that the factors' levels give, t<from><to>."""
    rows = _levels(spark, sf_dir)
    at = {v: k for k, v in regimes.LEVELS.items()}
    p = {(a, b): low + (high - low) * scalars.logistic(sum((w * F.col(at[f]) for f, w in weights.items() if at[f] in rows.columns), F.lit(0.0))) for a, b, weights, low, high in c.EXIT_RULES}
    cols = {}
    for a in range(3):
        out = sum((p[a, b] for b in range(3) if b != a), F.lit(0.0))
        stay = F.greatest(1 - out, F.lit(c.LEAST_STAY))
        cols |= {f"t{a}{b}": F.round((stay if a == b else p[a, b]) / (stay + out), 6) for b in range(3)}
    return rows.select("day", *[v.alias(k) for k, v in cols.items()])


@query(
    "r28_duration_ramps",
    with_ctes("snap") + ", d AS (SELECT day, CASE WHEN expansion >= stagflation AND expansion >= contraction THEN 0 WHEN stagflation >= contraction THEN 1 ELSE 2 END AS top FROM snap), g AS (SELECT *, sum(CASE WHEN top = b THEN 0 ELSE 1 END) OVER (ORDER BY day) AS run FROM (SELECT *, lag(top) OVER (ORDER BY day) AS b FROM d)), k AS (SELECT day, top, row_number() OVER (PARTITION BY run ORDER BY day) AS age FROM g), e AS (SELECT *, CASE WHEN top = 2 THEN greatest(0.05 + 0.1 / (1 + exp(-0.08 * (age - 39))), 0.05) WHEN top = 0 THEN greatest(0.03 + 0.03 / (1 + exp(-0.03 * (age - 180))), 0.03) ELSE 0.05 END AS out FROM k), s AS (SELECT *, CASE WHEN top = 2 THEN greatest(0.93 - (out - 0.05), 0.5) WHEN top = 0 THEN greatest(0.97 - (out - 0.03), 0.5) ELSE 0.95 END AS stay FROM e) SELECT day, top, age, round(stay / (stay + out + CASE WHEN top = 2 THEN 0.02 ELSE 0 END), 6) AS stay FROM s",
)
def duration_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading regime's chance to stay, by how many snapshots it has led."""
    e, s, x = (F.col(k) for k in _REGIMES)
    top = F.when((e >= s) & (e >= x), 0).when(s >= x, 1).otherwise(2)
    runs = windows.islands(tables.snapshots(spark, sf_dir).withColumn("g", F.lit(0)), ["g"], ["day"], top)
    rows = runs.select("day", F.col("flag").alias("top"), F.row_number().over(Window.partitionBy("run").orderBy("day")).cast("long").alias("age"))
    stay = F.lit(c.TRANSITIONS[1][1])
    for regime, targets, half, least, most, slope in c.DURATION_EXITS:
        now = sum(c.TRANSITIONS[regime][t] for t in targets)
        rest = 1 - now - c.TRANSITIONS[regime][regime]
        out = F.greatest(least + (most - least) * scalars.logistic(slope * (F.col("age") - half)), F.lit(now))
        keep = F.greatest(c.TRANSITIONS[regime][regime] - (out - now), F.lit(c.LEAST_STAY))
        stay = F.when(F.col("top") == regime, keep / (keep + out + rest)).otherwise(stay)
    return rows.select("day", "top", "age", F.round(stay, 6).alias("stay"))


_KINDS, _SIZES = list(c.SIGNAL_HALF_LIVES), list(c.SIGNAL_SIZES)


@query(
    "r34_e8_signals",
    "WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id AS entity, event_id AS seq, date_diff('second', ts, now) / 3600.0 AS age, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {24.0 * h}" for i, h in enumerate(c.SIGNAL_HALF_LIVES.values())) + " END AS hl, CASE event_id % 3 " + " ".join(f"WHEN {i} THEN {r}" for i, (r, _) in enumerate(c.SIGNAL_SIZES.values())) + " END AS r, CASE event_id % 3 " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(c.SIGNAL_SIZES.values())) + " END AS v, CASE WHEN value > 50 THEN 1 ELSE -1 END AS direction, least(value / 100, 1.0) AS confidence FROM events, n WHERE event_type = 'signup' AND value IS NOT NULL) SELECT entity, seq, round(direction * v * confidence, 6) AS z, round(r * power(2, age / hl), 4) AS r FROM s WHERE age / hl <= 5",
)
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as qualitative signals on growth: their values, and noises that double with every half-life; expired ones are gone."""
    obs = tables.table(spark, sf_dir, "events").where("event_type = 'signup' and value is not null")
    now = tables.table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    whole = lambda x: F.unix_seconds(F.date_trunc("second", x).cast("timestamp"))
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n + 1).cast("int"))
    s = obs.crossJoin(F.broadcast(now)).select(F.col("user_id").alias("entity"), F.col("event_id").alias("day"), pick(_KINDS, 8).alias("kind"), F.lit("growth_trend").alias("factor"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("direction"), pick(_SIZES, 3).alias("magnitude"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), ((whole("now") - whole("ts")) / 3600.0).alias("age_hours"))
    return filters.pseudo_observations(s).select("entity", F.col("day").alias("seq"), F.round("z", 6).alias("z"), F.round("r", 4).alias("r"))


@query("k3_s12_resumed_states")
def resumed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines stopped in the middle of the month and resumed from their saved states."""
    obs, variants = _daily_z(spark, sf_dir), filters.configs([{"config_id": "base"}, {"config_id": "full", "gas": True, "gap": True, "cumulate": True, "state_tpm": True}])
    half = filters.checkpoints(obs.where("day < date'2024-01-15'"), variants)
    done = filters.checkpoints(obs.where("day >= date'2024-01-15'"), variants, half)
    return done.select("entity", "config_id", "step", F.get_json_object("engine", "$.n").cast("long").alias("n"), F.get_json_object("engine", "$.ll").cast("double").alias("ll"))


@query("r37_recalibrated")
def recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic points fitted on the first 70 % of the dates, applied to the rest and scaled to one by date."""
    truth = joins.in_windows(tables.snapshots_long(spark, sf_dir), tables.windows(spark), how="left").withColumn("outcome", F.coalesce((F.col("regime") == F.col("label")).cast("int"), F.lit(0))).select("day", "regime", "p", "outcome").dropDuplicates(["day", "regime"])
    days = truth.select("day").distinct().withColumn("share", F.percent_rank().over(Window.orderBy("day")))  # a row for each date
    split = truth.join(days, "day")
    points = estimation.calibrators(split.where("share < 0.7"), ["regime"])
    return estimation.recalibrated(split.where("share >= 0.7"), points).select("day", "regime", "p", "calibrated", "outcome")


@query("r41_bootstrap_suite")
def bootstrap_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the ten metrics from 200 block replicates of the snapshots."""
    truth = joins.in_windows(tables.snapshots(spark, sf_dir), tables.windows(spark), how="left").select("day", F.coalesce("label", F.lit("expansion")).alias("truth"), *_REGIMES).dropDuplicates(["day"])
    return estimation.valid_interval(estimation.bootstrap_suite(truth, _REGIMES, replicates=200), ["metric"])


@query("m7_var_solution")
def var_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAR(1) of the streams' daily means with the residuals' covariance."""
    keys = [s for _, s, _ in tables.STREAMS]
    return estimation.var_one(joins.aligned(tables.daily(spark, sf_dir), "day", keys), "day", keys)


@query(
    "m8_granger",
    with_ctes("daily") + ", p AS (SELECT e.stream_key AS effect, s.stream_key AS cause, e.x AS y, b.x AS yb, s.x AS xb FROM daily e JOIN daily b ON b.stream_key = e.stream_key AND b.day = e.day - 1 JOIN daily s ON s.day = e.day - 1 AND s.stream_key <> e.stream_key), c AS (SELECT effect, cause, count(*) AS n, corr(y, yb) AS a, corr(y, xb) AS b, corr(yb, xb) AS c FROM p GROUP BY 1, 2), f AS (SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM c) SELECT cause, effect, n, round(r2 - a * a, 6) AS gain, round((r2 - a * a) * (n - 3) / (1 - r2), 4) AS f FROM f",
)
def granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another stream's day before adds to a stream's own, for every ordered pair."""
    g = _granger(spark, sf_dir)
    return g.select("cause", "effect", "n", F.round("gain", 6).alias("gain"), F.round("f", 4).alias("f"))


def _granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.daily(spark, sf_dir)
    before = d.select(F.date_add("day", 1).alias("day"), "stream_key", F.col("x").alias("b"))
    own = d.join(before, ["day", "stream_key"]).select("day", F.col("stream_key").alias("effect"), F.col("x").alias("y"), F.col("b").alias("y_before"))
    pairs = own.join(before.select("day", F.col("stream_key").alias("cause"), F.col("b").alias("x_before")), "day").where("cause <> effect")
    return estimation.granger(pairs, ["cause", "effect"])


@query("m8_granger_p_values")
def granger_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _granger(spark, sf_dir).withColumn("p_value", distributions.f_p("f", F.lit(1), F.col("n") - 3))


@query("m9_reference_correlation")
def reference_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's daily mean against every other as its reference: correlation, p-value, and whether it is at least 0.15 in size."""
    d = tables.daily(spark, sf_dir)
    a, b = d.select("day", F.col("stream_key").alias("factor"), F.col("x").alias("x1")), d.select("day", F.col("stream_key").alias("reference"), F.col("x").alias("x2"))
    g = a.join(b, "day").where("factor <> reference").groupBy("factor", "reference").agg(scalars.correlation("x1", "x2").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("p_value", distributions.correlation_p("r", "n")).withColumn("passed", F.abs("r") >= 0.15)


@query("u4_keep_last", "SELECT entity, day, stream_key, seq AS kept FROM (SELECT user_id AS entity, CAST(ts AS DATE) AS day, event_type AS stream_key, event_id AS seq, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each entity, day and stream."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), F.col("event_type").alias("stream_key"), "ts", "event_id")
    return e.groupBy("entity", "day", "stream_key").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("kept"))


@query("w4_online_change", with_ctes("obs") + " SELECT entity, stream_key, seq, round((raw - b) / abs(b) * 100, 6) AS change FROM (SELECT *, lag(raw) OVER (PARTITION BY entity, stream_key ORDER BY ts, seq) AS b FROM (SELECT * FROM obs WHERE raw IS NOT NULL)) WHERE b <> 0")
def online_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent change on the last observed value, none where there is none or it is zero."""
    obs = tables.observations(spark, sf_dir).where("raw is not null").withColumn("b", F.lag("raw").over(windows.along(["entity", "stream_key"], ["ts", "seq"])))
    return obs.where("b <> 0").select("entity", "stream_key", "seq", F.round((F.col("raw") - F.col("b")) / F.abs("b") * 100, 6).alias("change"))


@query("p15_p17_t6_model_scores", with_ctes("fc") + " SELECT model_id, scenario, round(brier, 6) AS brier, row_number() OVER (ORDER BY brier, model_id, scenario) AS place FROM (SELECT model_id, scenario, avg((p - outcome) * (p - outcome)) AS brier FROM fc WHERE scenario <> 'N' GROUP BY 1, 2) WHERE brier > 0.05")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the wanted scenarios over a threshold, best first; a row for each model."""
    f = tables.forecasts(spark, sf_dir).where("scenario <> 'N'").groupBy("model_id", "scenario").agg(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)).alias("b")).where("b > 0.05")
    place = F.row_number().over(Window.orderBy("b", "model_id", "scenario")).cast("long")
    return f.select("model_id", "scenario", F.round("b", 6).alias("brier"), place.alias("place"))


@query("f13_f14_f15_maps", with_ctes("snap") + " SELECT day, CASE WHEN expansion >= stagflation AND expansion >= contraction THEN 'expansion' WHEN stagflation >= contraction THEN 'stagflation' ELSE 'contraction' END AS top, round(expansion * 1.0 + stagflation * 2.0 + contraction * 3.0, 6) AS dot, round(expansion, 6) AS back FROM snap")
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities as a map: its argmax, its values times a vector, and a value read back from JSON."""
    s = tables.snapshots(spark, sf_dir).withColumn("m", F.create_map(*[x for k in _REGIMES for x in (F.lit(k), F.col(k))]))
    text = F.from_json(F.to_json("m"), "map<string,double>")
    return s.select("day", scalars.map_argmax(F.col("m")).alias("top"), F.round(scalars.dot(F.map_values("m"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), 6).alias("dot"), F.round(scalars.map_value(text, "expansion"), 6).alias("back"))


@query("f6_f8_values", with_ctes("obs") + ", s AS (SELECT stream_key, avg(raw) AS m, var_pop(raw) AS v FROM obs GROUP BY 1) SELECT seq, round(raw, 6) AS back, round(sign(raw - m) * 0.4::DOUBLE * 0.5::DOUBLE, 6) AS pseudo FROM obs JOIN s USING (stream_key) WHERE raw IS NOT NULL")
def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values normalised and brought back, and the pseudo value of their direction."""
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    stats = obs.groupBy("stream_key").agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"))
    rows = obs.join(F.broadcast(stats), "stream_key").withColumn("z", (F.col("raw") - F.col("m")) / F.sqrt("v"))  # a row for each stream
    return rows.select("seq", F.round(scalars.denormalised(F.col("z"), F.col("m"), F.col("v")), 6).alias("back"), F.round(scalars.pseudo_value(F.signum(F.col("raw") - F.col("m")), F.lit(0.4), F.lit(0.5)), 6).alias("pseudo"))
