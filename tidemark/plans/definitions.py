"""Queries at the full definitions of what other queries show in part: windows, tests with p-values, events, engine states, as-of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import scalars
from tidemark.operators import asof, filters, joins, lockstep, ranged, regimes, resampling, triggers, verification, windows
from tidemark.plans.engine import _LEVEL_SQL, _PANEL, _SLOPED, _features, _levels, _updates
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.state import _daily_z
from tidemark.plans.verify import _INNOVATIONS, _innovations
from tidemark.sources import tables
from tidemark.sources.tables import with_ctes

_REGIMES = ["expansion", "stagflation", "contraction"]
_SCORED = ["contraction", "stagflation"]
_WARM_DAYS = 10

_WARMUP_SQL = (
    with_ctes("obs")
    + f"""
, d AS (SELECT entity, stream_key, CAST(ts AS DATE) AS day, avg(raw) AS x FROM obs WHERE raw IS NOT NULL GROUP BY 1, 2, 3)
, r AS (
  SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY day) AS place, row_number() OVER (PARTITION BY entity, stream_key ORDER BY day) AS k FROM d
)
, e AS (SELECT *, count(*) FILTER (WHERE place <= {_WARM_DAYS}) OVER (PARTITION BY entity, stream_key) AS early FROM r)
, s AS (
  SELECT entity, stream_key, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM e
  WHERE CASE WHEN early >= 5 THEN place <= {_WARM_DAYS} ELSE k <= 50 END GROUP BY 1, 2
)
SELECT entity, stream_key, n, round(m, 6) AS mean, round(greatest(sd, abs(m) * 0.01, 0.1), 6) AS scale FROM s WHERE n >= 2
"""
)


@query("a1_warmup_window", _WARMUP_SQL)
def warmup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and floored deviation of each series in the first days of its entity's calendar, or of its first 50 values where those hold under five."""
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    d = obs.groupBy("entity", "stream_key", F.to_date("ts").alias("day")).agg(F.avg("raw").alias("x"))
    rows = windows.warmed(d, ["entity"], ["stream_key"], "day", _WARM_DAYS, 5, 50)
    s = rows.groupBy("entity", "stream_key").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return s.select("entity", "stream_key", "n", F.round("m", 6).alias("mean"), F.round(F.greatest("sd", F.abs("m") * 0.01, F.lit(0.1)), 6).alias("scale"))


_DM_SQL = (
    with_ctes("fc")
    + """
, l AS (SELECT model_id, seq, (p - outcome) * (p - outcome) AS loss, row_number() OVER (PARTITION BY model_id ORDER BY seq, (p - outcome) * (p - outcome)) - 1 AS pos FROM fc)
, d AS (SELECT a.pos, a.loss - b.loss AS d FROM l a JOIN l b ON a.pos = b.pos AND a.model_id = 'F' AND b.model_id = 'O')
, m AS (SELECT avg(d) AS m, count(*) AS n, var_samp(d) AS v FROM d)
, g AS (
  SELECT avg((d - m) * (l1 - m)) AS g1, avg((d - m) * (l2 - m)) AS g2
  FROM (SELECT d, lag(d, 1) OVER (ORDER BY pos) AS l1, lag(d, 2) OVER (ORDER BY pos) AS l2 FROM d), m
)
, s AS (SELECT n, m, m / sqrt((v + 2 * (g1 + g2)) / n) * sqrt((n + 1 - 2 * 3 + 3 * 2 / CAST(n AS DOUBLE)) / n) AS statistic FROM m, g)
SELECT n, round(m, 8) AS mean_difference, round(statistic, 5) AS statistic,
       CASE WHEN abs(statistic) < 1.959963984540054 THEN 'no significant difference' WHEN statistic < 0 THEN 'first better' ELSE 'second better' END AS verdict FROM s
"""
)


def _losses(spark: SparkSession, sf_dir: str, model: str, name: str) -> DataFrame:
    f = tables.forecasts(spark, sf_dir).where(F.col("model_id") == model)
    return f.select(F.lit(0).alias("pair"), "seq", F.pow(F.col("p") - F.col("outcome"), 2).alias(name))


@query("a9_j7_zipped_losses", _DM_SQL)
def zipped_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' losses, put together by position, and which model forecasts better."""
    both = joins.zipped(_losses(spark, sf_dir, "F", "a"), _losses(spark, sf_dir, "O", "b"), ["pair"], "seq").withColumn("d", F.col("a") - F.col("b"))
    t = verification.diebold_mariano_test(both, ["pair"], "d", 3)
    return t.select("n", F.round("mean_difference", 8).alias("mean_difference"), F.round("statistic", 5).alias("statistic"), "verdict")


#: The 95 % points of chi-squared with 1 to 10 degrees of freedom.
_CHI_95 = (3.841458820694124, 5.991464547107979, 7.814727903251179, 9.487729036781154, 11.070497693516351, 12.591587243743977, 14.067140449340169, 15.507313055865453, 16.918977604620448, 18.307038053275146)
_DETAIL_SQL = (
    _INNOVATIONS
    + f"""
, x AS (SELECT entity, ts, seq, round(z, 1) AS x FROM z)
, m AS (SELECT entity, avg(x) AS m, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 50)
, l AS (
  SELECT entity, ts, seq, n, x - m AS c, coalesce(abs(x - lag(x) OVER w) < 1e-10, false) AS same, {", ".join(f"lag(x - m, {k}) OVER w AS l{k}" for k in range(1, 11))}
  FROM x JOIN m USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)
)
, u AS (SELECT entity, run, count(*) AS k FROM (SELECT entity, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY ts, seq) AS run FROM l) GROUP BY 1, 2 HAVING count(*) > 1)
, r AS (SELECT entity, max(k) AS max_run, avg(k) AS avg_run, count(*) AS n_runs FROM u GROUP BY 1)
, sums AS (SELECT entity, max(n) AS n, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) * max(n) / (max(n) - 1) AS repeats, {", ".join(f"sum(c * l{k}) / sum(c * c) AS r{k}" for k in range(1, 11))} FROM l GROUP BY 1)
, q AS (SELECT *, {", ".join(f"n * (n + 2) * ({' + '.join(f'r{j} * r{j} / (n - {j})' for j in range(1, k + 1))}) AS q{k}" for k in range(1, 11))} FROM sums)
SELECT q.entity, n, round(r1, 6) AS acf_1, round(r2, 6) AS acf_2, round(r5, 6) AS acf_5, round(r10, 6) AS acf_10, round(repeats, 6) AS repeats,
       coalesce(max_run, 0) AS max_run, round(coalesce(avg_run, 0), 6) AS avg_run, coalesce(n_runs, 0) AS n_runs,
       CASE {" ".join(f"WHEN q{k} < {x} THEN {k}" for k, x in enumerate(_CHI_95, 1))} END AS first_pass_lag
FROM q LEFT JOIN r ON r.entity = q.entity
"""
)


@query("a29_whiteness_detail", _DETAIL_SQL)
def whiteness_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an entity's innovations, to a tenth, aren't white: autocorrelations, repeated values and their runs, the first lag that passes."""
    x = _innovations(spark, sf_dir).select("entity", "ts", "seq", F.round("z", 1).alias("x"))
    g = verification.whiteness_detail(x, ["entity"], ["ts", "seq"], "x")
    return g.withColumns({k: F.round(k, 6) for k in ("acf_1", "acf_2", "acf_5", "acf_10", "repeats", "avg_run")})


_EVENTS = [resampling.Event(a, b, label) for a, b, label in tables.WINDOWS]
_POINT_SQL = (
    with_ctes("snap", "long", "windows")
    + """
, y AS (
  SELECT l.day, l.regime, l.p, CASE WHEN EXISTS (SELECT 1 FROM windows w WHERE w.label = l.regime AND l.day BETWEEN w.w_start AND w.w_end) THEN 1 ELSE 0 END AS y
  FROM long l WHERE regime IN ('contraction', 'stagflation')
)
, t AS (SELECT range AS k, CASE range WHEN 199 THEN 1.0::DOUBLE ELSE range / 199.0::DOUBLE END AS threshold FROM range(200))
, c AS (
  SELECT regime, k, sum(CASE WHEN y = 1 AND p >= threshold THEN 1.0 ELSE 0 END) / sum(y) AS tpr, sum(CASE WHEN y = 0 AND p >= threshold THEN 1.0 ELSE 0 END) / sum(1 - y) AS fpr
  FROM y, t GROUP BY 1, 2
)
, a AS (SELECT regime, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS area FROM c WINDOW w AS (PARTITION BY regime ORDER BY k DESC))
, b AS (SELECT *, least(floor(p * 10), 9) AS bin, count(*) OVER (PARTITION BY regime) AS n, avg(y) OVER (PARTITION BY regime) AS base FROM y)
, k AS (SELECT regime, count(*) / max(n) * power(avg(p) - avg(y), 2) AS rel, count(*) / max(n) * power(avg(y) - max(base), 2) AS res FROM b GROUP BY regime, bin)
, f AS (
  SELECT w.w_start, round(date_diff('day', w.w_start, min(l.day)) / 7.0, 1) AS lag
  FROM windows w JOIN long l ON l.regime = w.label AND l.day BETWEEN w.w_start AND w.w_end AND l.p >= 0.5 GROUP BY w.w_start
)
SELECT regime || '_auc' AS metric, round(sum(area), 4) AS value FROM a GROUP BY regime
UNION ALL SELECT regime || '_brier', round(avg(power(p - y, 2)), 6) FROM y GROUP BY regime
UNION ALL SELECT regime || '_reliability', round(sum(rel), 6) FROM k GROUP BY regime
UNION ALL SELECT regime || '_resolution', round(sum(res), 6) FROM k GROUP BY regime
UNION ALL SELECT 'detection_count', count(*) FROM f
UNION ALL SELECT 'mean_detection_lag', round(avg(lag), 6) FROM f HAVING count(*) > 0
"""
)


@query("r41_point_metrics", _POINT_SQL)
def point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten metrics of the snapshots as they are: scores of two regimes, detected events and their mean lag."""
    suite = resampling.event_suite(tables.snapshots(spark, sf_dir), _REGIMES, _EVENTS, _SCORED, replicates=1)
    return suite.where(F.col("replicate") == resampling.ORIGINAL).select("metric", F.round("value", 6).alias("value"))


@query("r41_event_intervals")
def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten metrics with intervals from 200 stationary block replicates, each of which keeps the events' windows."""
    return resampling.event_intervals(resampling.event_suite(tables.snapshots(spark, sf_dir), _REGIMES, _EVENTS, _SCORED, replicates=200))


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, filters.Config]]:
    return _daily_z(spark, sf_dir), filters.configs([{"config_id": "base"}])


@query("e5_branch_break")
def branch_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the snapshots of every entity: factors of the shared filter that no branch comes near, and whether that is a structural break."""
    rows = triggers.structural_breaks(lockstep.branch_states(*_base(spark, sf_dir)))
    return rows.select("entity", "day", F.size("outside").alias("n_outside"), "broken", "detail")


@query("a27_factor_innovations")
def factor_innovations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations between the factors' shares of each entity's innovations: gain times standardised innovation; null where a factor never moves."""
    u = verification.by_factor(_updates(spark, sf_dir), "gain", "z", list(c.FACTORS))
    return verification.factor_correlations(u, ["entity"], list(c.FACTORS))


@query("a35_state_health")
def state_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition and effective rank of the filter's covariance at every entity's last day, with the factors' deviations."""
    return lockstep.covariance_health(*_base(spark, sf_dir))


@query("r27_r32b_regime_loadings")
def regime_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last states with noise by regime, and with loadings by regime as well, branches weighed by what they say after their update."""
    own = {"regime_noise": True, "branch_noise": True, "likelihood_after": True}
    variants = filters.configs([{"config_id": "regime_noise", **own}, {"config_id": "regime_loadings", "regime_loadings": True, **own}])
    last = lockstep.replay(_daily_z(spark, sf_dir), variants, every=1_000_000)
    return last.select("entity", "config_id", "n_updates", F.round("log_likelihood", 4).alias("ll"), "anomalies", "probabilities")


@query("r32d_smoothing_variants")
def smoothing_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each regime's sub-regimes day by day: from the scorecards alone, and carried on by the default and by stronger transitions, in one pass."""
    shares = regimes.shares(regimes.evidence(_features(spark, sf_dir))).withColumn("g", F.lit(0))
    out = None
    for regime, subs in c.SUB_REGIMES.items():
        subs = tuple(subs)
        both = ranged.Together((ranged.Sticky(subs, c.STICKY_TRANSITIONS[regime], "mild"), ranged.Sticky(subs, tuple(map(tuple, filters.sticky(len(subs), 0.92).tolist())), "strong")))
        rows = ranged.scan(shares.select("g", "day", *subs), ["g"], ["day"], both)
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("sub_regime"), F.col(s).alias("raw"), F.col(f"mild_{s}").alias("mild"), F.col(f"strong_{s}").alias("strong")) for s in subs]))
        rows = rows.select("day", F.lit(regime).alias("regime"), each.alias("r")).select("day", "regime", "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("t5_influence", "WITH active AS (" + ORACLES["r34_e8_signals"] + ") SELECT entity, seq, r, round(1.0 / (1.0 + r), 4) AS influence, row_number() OVER (PARTITION BY entity ORDER BY r, seq) AS place FROM active")
def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals of each entity, the most influential first: influence falls with the noise that age has given them."""
    from tidemark.plans.engine import signals

    place = F.row_number().over(Window.partitionBy("entity").orderBy("r", "seq")).cast("long")
    return signals(spark, sf_dir).select("entity", "seq", "r", F.round(1.0 / (1.0 + F.col("r")), 4).alias("influence"), place.alias("place"))


@query("p6_genuine_observations", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE coalesce(CAST(json_extract(props, '$.k') AS BIGINT) % 10, 1) <> 0 GROUP BY 1")
def genuine_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations without those whose properties mark them as mock ones (here, a tenth of the values of k)."""
    mock = F.get_json_object("props", "$.k").cast("long") % 10 == 0
    e = tables.table(spark, sf_dir, "events").where(~F.coalesce(mock, F.lit(False)))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


#: Levels and other quantities that the panel lacks, as changes of a level that it has over so many days.
_STAND_INS = {"commodity": ("inflation", 2), "sentiment": ("growth", 1), "policy": ("finance", 3)}
_STAND_INS |= {name: (_PANEL[i % len(_PANEL)][0], 1 + i % 6) for i, name in enumerate(x for x in regimes.OTHERS if x not in _SLOPED)}
_FULL_SQL = (
    _LEVEL_SQL
    + ", sloped AS (SELECT *, "
    + ", ".join(f"coalesce((({k} - lag({k}, {n}) OVER (ORDER BY day)) / {n}) * 100, 0.0) AS {name}" for name, (k, n) in _SLOPED.items())
    + ", "
    + ", ".join(f"coalesce(2 * ({k} - lag({k}, {n}) OVER (ORDER BY day)), 0.0) AS {name}" for name, (k, n) in _STAND_INS.items())
    + " FROM levels), features AS (SELECT *, "
    + ", ".join(f"{v} AS {k}" for k, v in regimes.DERIVED.items())
    + " FROM sloped) SELECT day, "
    + ", ".join(f"round({regimes.evidence_sql(k)}, 6) AS {k}" for k in c.EVIDENCE)
    + " FROM features"
)


@query("r20_full_evidence", _FULL_SQL)
def full_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven scorecards with every level, slope and proxy moving: those that the panel lacks are changes of those it has."""
    w = Window.orderBy("day")  # a row for each date
    slopes = [(F.coalesce((F.col(k) - F.lag(k, n).over(w)) / n, F.lit(0.0)) * 100).alias(name) for name, (k, n) in _SLOPED.items()]
    others = [F.coalesce(2 * (F.col(k) - F.lag(k, n).over(w)), F.lit(0.0)).alias(name) for name, (k, n) in _STAND_INS.items()]
    rows = regimes.evidence(_levels(spark, sf_dir).select("*", *slopes, *others))
    return rows.select("day", *[F.round(k, 6).alias(k) for k in c.EVIDENCE])


_REFERENCE_SQL = (
    with_ctes("daily")
    + """
, g AS (SELECT a.stream_key AS factor, b.stream_key AS reference, corr(a.x, b.x) AS r, count(*) AS n FROM daily a JOIN daily b ON a.day = b.day AND a.stream_key <> b.stream_key GROUP BY 1, 2)
SELECT factor, reference, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t, abs(r) >= 0.15 AS passed FROM g
"""
)


@query("m9_reference_t", _REFERENCE_SQL)
def reference_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream against every other as its reference: correlation, its t value on n - 2 degrees, and whether it is at least 0.15 in size."""
    from tidemark.plans.engine import reference_correlation

    g = reference_correlation(spark, sf_dir)
    return g.select("factor", "reference", "n", F.round("r", 6).alias("r"), F.round(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))), 4).alias("t"), "passed")


#: The proxies by name: a feature of one role, and less the same feature of another.
PROXIES = {
    "oil_impulse_20": ("sum_20", "OIL_PRICE", None), "oil_impulse_60": ("sum_60", "OIL_PRICE", None), "ppi_cpi_spread": ("last", "PPI", "US_CPI_YOY"), "core_headline_gap": ("last", "CORE_CPI", "US_CPI_YOY"),
    "sp500_ret_20": ("sum_20", "SP500", None), "sp500_ret_60": ("sum_60", "SP500", None), "unrate_change": ("change_3", "UNEMPLOYMENT_RATE", None), "claims_change": ("change_5", "INITIAL_CLAIMS", None),
    "fedfunds_change_short": ("change_3", "FED_FUNDS_RATE", None), "fedfunds_change_medium": ("change_10", "FED_FUNDS_RATE", None), "yield_curve": ("last", "10Y_YIELD", "FED_FUNDS_RATE"),
    "housing_change": ("change_3", "HOME_PRICES", None), "sentiment_level": ("last", "CONSUMER_CONFIDENCE", None),
}
#: The five streams of the tables in the parts of the streams that the proxies are made of.
ROLES = {
    "OIL_PRICE": "SP500", "SP500": "SP500", "PPI": "RETAIL_SALES", "US_CPI_YOY": "US_CPI_YOY", "CORE_CPI": "UNEMPLOYMENT_RATE", "UNEMPLOYMENT_RATE": "UNEMPLOYMENT_RATE", "INITIAL_CLAIMS": "INITIAL_CLAIMS",
    "FED_FUNDS_RATE": "INITIAL_CLAIMS", "10Y_YIELD": "SP500", "HOME_PRICES": "RETAIL_SALES", "CONSUMER_CONFIDENCE": "US_CPI_YOY",
}
_FEATURE_NAMES = ("last", "change_3", "change_5", "change_10", "sum_20", "sum_60")


def _proxy_sql(feature: str, role: str, less: str | None) -> str:
    one = lambda r: f"max(CASE WHEN s.stream_key = '{ROLES[r]}' THEN coalesce(f.{feature}, 0) END)"
    return one(role) + (f" - {one(less)}" if less else "")


_ASOF_SQL = (
    with_ctes("obs", "streams")
    + f"""
, o AS (SELECT entity, stream_key, ts, seq, raw FROM obs WHERE raw IS NOT NULL)
, f AS (
  SELECT entity, stream_key, ts, raw AS last, {", ".join(f"coalesce(raw - lag(raw, {k}) OVER w, 0) AS change_{k}" for k in (3, 5, 10))},
         {", ".join(f"CASE WHEN count(*) OVER w{k} = {k} THEN sum(raw) OVER w{k} ELSE 0 END AS sum_{k}" for k in (20, 60))}
  FROM o WINDOW w AS (PARTITION BY entity, stream_key ORDER BY ts, seq), {", ".join(f"w{k} AS (PARTITION BY entity, stream_key ORDER BY ts, seq ROWS {k - 1} PRECEDING)" for k in (20, 60))}
  QUALIFY row_number() OVER (PARTITION BY entity, stream_key, ts ORDER BY seq DESC) = 1
)
, n AS (SELECT DISTINCT entity, CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY AS "at" FROM o)
, s AS (SELECT entity, "at", stream_key FROM n, streams)
SELECT s.entity, s."at", {", ".join(f"round({_proxy_sql(*v)}, 6) AS {k}" for k, v in PROXIES.items())}
FROM s ASOF LEFT JOIN f ON s.entity = f.entity AND s.stream_key = f.stream_key AND s."at" >= f.ts GROUP BY 1, 2
"""
)


@query("w14_proxies_at_snapshots", _ASOF_SQL)
def proxies_at_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxies of every entity at the ends of its weeks: impulses, changes, levels and spreads of the streams as of then, 0 where there is too little."""
    obs = tables.observations(spark, sf_dir).where("raw is not null").select("entity", "stream_key", F.col("ts").cast("timestamp").alias("at"), "seq", "raw")
    w, raw = windows.along(["entity", "stream_key"], ["at", "seq"]), F.col("raw")
    full = lambda k: F.when(F.count(raw).over(w.rowsBetween(1 - k, 0)) == k, F.sum(raw).over(w.rowsBetween(1 - k, 0))).otherwise(0.0)
    values = [raw.alias("last"), *[F.coalesce(windows.difference(raw, w, k), F.lit(0.0)).alias(f"change_{k}") for k in (3, 5, 10)], *[full(k).alias(f"sum_{k}") for k in (20, 60)]]
    features = obs.select("entity", "stream_key", "at", "seq", F.struct(*values).alias("features"))
    ends = obs.select("entity", (F.date_trunc("week", "at") + F.expr("INTERVAL 7 DAYS")).alias("at")).distinct()
    ends = ends.withColumn("stream_key", F.explode(F.array(*[F.lit(s) for _, s, _ in tables.STREAMS])))
    found = asof.as_of(ends, features, ["entity", "stream_key"], "at", ["seq"], "features", F.floor(F.unix_seconds("at") / (86_400 * 16)))
    one = lambda feature, role: F.max(F.when(F.col("stream_key") == ROLES[role], F.coalesce(f"features.{feature}", F.lit(0.0))))
    columns = {k: one(feature, role) - one(feature, less) if less else one(feature, role) for k, (feature, role, less) in PROXIES.items()}
    g = found.groupBy("entity", "at").agg(*[F.round(v, 6).alias(k) for k, v in columns.items()])
    return g.withColumn("at", F.col("at").cast("timestamp_ntz"))


#: The series of the monthly totals in the place of five factors.
_SERIES_FACTORS = {"1-URGENT": "inflation_trend", "2-HIGH": "growth_trend", "3-MEDIUM": "labor_pressure", "4-NOT SPECIFIED": "housing_momentum", "5-LOW": "financial_conditions"}
_WINDOW_REGIMES = dict(zip(_REGIMES, c.REGIMES))
_USED = [(label, series, c.REGIME_ADJUSTMENTS[regime].get(factor, 0.0)) for label, regime in _WINDOW_REGIMES.items() for series, factor in _SERIES_FACTORS.items()]
_MATCH_SQL = (
    with_ctes("monthly", "windows")
    + f"""
, used(label, series, used) AS (VALUES {", ".join(f"('{a}', '{b}', {v})" for a, b, v in _USED)})
, z AS (SELECT month, series, (x - avg(x) OVER (PARTITION BY series)) / stddev_samp(x) OVER (PARTITION BY series) AS z FROM monthly)
, d AS (SELECT w.label, z.series, avg(z.z) AS derived FROM z JOIN windows w ON z.month BETWEEN w.w_start AND w.w_end GROUP BY 1, 2)
SELECT d.label, count(*) AS n, round(avg(CASE WHEN abs(d.derived - u.used) < 0.25 THEN 1.0 ELSE 0.0 END), 6) AS matched, round(max(abs(d.derived - u.used)), 6) AS largest
FROM d JOIN used u ON u.label = d.label AND u.series = d.series WHERE abs(d.derived) > 0.05 OR abs(u.used) > 0.05 GROUP BY 1
"""
)


@query("a23_adjustment_match", _MATCH_SQL)
def adjustment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each regime's adjustments, as the windows' standardised means give them, lie within a quarter of those in use; small ones on both sides don't count."""
    used = spark.createDataFrame(_USED, "label string, series string, used double")  # a row for each regime and factor
    w = Window.partitionBy("series")
    z = tables.monthly_sales(spark, sf_dir).withColumn("z", (F.col("x") - F.avg("x").over(w)) / F.stddev_samp("x").over(w))
    derived = joins.in_windows(z, tables.windows(spark), "month").groupBy("label", "series").agg(F.avg("z").alias("derived"))
    gap = F.abs(F.col("derived") - F.col("used"))
    g = derived.join(F.broadcast(used), ["label", "series"]).where((F.abs("derived") > 0.05) | (F.abs("used") > 0.05)).groupBy("label")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((gap < 0.25).cast("double")), 6).alias("matched"), F.round(F.max(gap), 6).alias("largest"))


@query("a40_engine_success")
def engine_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every entity after its first ten updates: the share of anomalies, how the regimes' probabilities changed from the first to the last, and whether under a fifth were anomalies."""
    u = _updates(spark, sf_dir).where("n > 10")
    first, last = F.min_by("probabilities", "n"), F.max_by("probabilities", "n")
    g = u.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs("z") > c.ANOMALY_THRESHOLD).cast("double")).alias("anomaly_rate"), first.alias("start"), last.alias("end"))
    changes = [(F.get("end", F.lit(i)) - F.get("start", F.lit(i))).alias(f"change_{r}") for i, r in enumerate(c.REGIMES)]
    return g.select("entity", "n", "anomaly_rate", *changes, (F.col("anomaly_rate") < 0.2).alias("success"))


_DATES_SQL = (
    with_ctes("windows")
    + """
, f AS (SELECT w.w_start, w.label, w.w_end, max(CAST(o.o_orderdate AS DATE)) AS last_day FROM windows w JOIN orders o ON CAST(o.o_orderdate AS DATE) BETWEEN w.w_start AND w.w_end AND o.o_totalprice > 300000 GROUP BY 1, 2, 3)
SELECT w_start, label, date_diff('day', w_start, last_day) AS days, round(date_diff('day', w_start, last_day) / 7.0, 4) AS weeks, round(date_diff('day', w_start, last_day) / 30.44, 4) AS months,
       CAST(w_start - INTERVAL 6 MONTH AS DATE) AS search_from, CAST(w_end + INTERVAL 1 MONTH AS DATE) AS search_to FROM f
"""
)


@query("f9_dates", _DATES_SQL)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, weeks and months of 30.44 days to the last large order of each window, and the window widened by months."""
    o = tables.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.to_date("o_orderdate").alias("day"))
    g = joins.in_windows(o, tables.windows(spark)).groupBy("w_start", "label", "w_end").agg(F.max("day").alias("last_day"))
    days = F.datediff("last_day", "w_start")
    return g.select("w_start", "label", days.cast("long").alias("days"), F.round(days / 7.0, 4).alias("weeks"), F.round(days / 30.44, 4).alias("months"), F.add_months("w_start", -6).alias("search_from"), F.add_months("w_end", 1).alias("search_to"))


_LAG_SQL = (
    with_ctes("monthly")
    + """
, l AS (SELECT series, month, x, lag(x) OVER (PARTITION BY series ORDER BY month) AS b FROM monthly)
SELECT a.series AS source, t.series AS target, count(*) AS n, round(corr(a.b, t.x), 6) AS r FROM l a JOIN l t ON a.month = t.month WHERE a.b IS NOT NULL AND t.b IS NOT NULL GROUP BY 1, 2
"""
)


@query("w11_lagged_correlations", _LAG_SQL)
def lagged_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every series' standardised value with every other's a month before, over the rows that have one."""
    rows = tables.monthly_sales(spark, sf_dir).withColumn("b", F.lag("x").over(windows.along(["series"], ["month"]))).where("b is not null")
    a, t = rows.select("month", F.col("series").alias("source"), "b"), rows.select("month", F.col("series").alias("target"), "x")
    return a.join(t, "month").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.round(scalars.correlation("b", "x"), 6).alias("r"))


_BRANCHES = [(sub, regime, f"{regime}: {sub.replace('_', ' ')}") for sub, regime in regimes.PARENT.items()]
_PARENT_SQL = f"""
WITH e AS ({_FULL_SQL})
, l AS (UNPIVOT e ON {", ".join(c.EVIDENCE)} INTO NAME sub VALUE score)
, b(sub, parent, name) AS (VALUES {", ".join(f"('{a}', '{p}', '{n}')" for a, p, n in _BRANCHES)})
SELECT day, parent, name, score FROM l JOIN b USING (sub) QUALIFY row_number() OVER (PARTITION BY day, parent ORDER BY score DESC, sub) = 1
"""


@query("j10_leading_branches", _PARENT_SQL)
def leading_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-regime that each day's evidence favours in every regime, by its parent and full name."""
    branches = spark.createDataFrame(_BRANCHES, "sub string, parent string, name string")  # a row for each sub-regime
    scores = full_evidence(spark, sf_dir).unpivot(["day"], list(c.EVIDENCE), "sub", "score").join(F.broadcast(branches), "sub")
    top = F.row_number().over(Window.partitionBy("day", "parent").orderBy(F.desc("score"), "sub"))
    return scores.withColumn("k", top).where("k = 1").select("day", "parent", "name", "score")


_CLASS_A, _CLASS_B = ("SP500", "INITIAL_CLAIMS"), ("INITIAL_CLAIMS", "US_CPI_YOY", "RETAIL_SALES")


@query("u2_union_of_classes", with_ctes("obs") + f" SELECT stream_key, count(*) AS n FROM obs WHERE stream_key IN (SELECT unnest({list(_CLASS_A)}) UNION SELECT unnest({list(_CLASS_B)})) GROUP BY 1")
def union_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the streams that either of two classes names."""
    classes = spark.createDataFrame([(k,) for k in _CLASS_A], "stream_key string").union(spark.createDataFrame([(k,) for k in _CLASS_B], "stream_key string")).distinct()  # a row for each stream
    return tables.observations(spark, sf_dir).join(F.broadcast(classes), "stream_key").groupBy("stream_key").agg(F.count(F.lit(1)).alias("n"))
