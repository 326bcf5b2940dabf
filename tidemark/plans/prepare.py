"""Filters, joins and window operators over the observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import joins, triggers, windows
from tidemark.plans.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import with_ctes

KEYS = [s for _, s, _ in tables.STREAMS]


@query("p1_stream_key", "SELECT DISTINCT 'FRED_' || event_type AS column_name, event_type AS stream_key FROM events")
def stream_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("FRED_"), "event_type").alias("column_name")).distinct()
    return names.withColumn("stream_key", F.regexp_extract("column_name", "^[^_]*_(.*)$", 1))


@query("p2_source_map", with_ctes("streams") + " SELECT stream_key, count(*) AS n, min(value) AS lowest, max(value) AS highest FROM events JOIN streams USING (event_type) WHERE event_type <> 'view' GROUP BY 1")
def source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = tables.stream_dimension(spark).where("event_type <> 'view'")  # unmapped sources are dropped
    e = tables.table(spark, sf_dir, "events").join(F.broadcast(mapped), "event_type")
    return e.groupBy("stream_key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query(
    "p8_anomalies",
    with_ctes("obs") + ", s AS (SELECT stream_key, avg(raw) AS m, stddev_samp(raw) AS sd FROM obs GROUP BY 1) SELECT seq, stream_key, round((raw - m) / sd, 6) AS z, abs((raw - m) / sd) > 3.5 AS is_anomalous FROM obs JOIN s USING (stream_key) WHERE raw IS NOT NULL AND abs((raw - m) / sd) > 2.5",
)
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.observations(spark, sf_dir).where("raw is not null")
    stats = obs.groupBy("stream_key").agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("sd"))
    z = obs.join(F.broadcast(stats), "stream_key").withColumn("z0", (F.col("raw") - F.col("m")) / F.col("sd"))  # a row for each stream
    return z.where(F.abs("z0") > 2.5).select("seq", "stream_key", F.round("z0", 6).alias("z"), (F.abs("z0") > 3.5).alias("is_anomalous"))


@query(
    "p10_p11_snapshots",
    with_ctes("snap") + ", d AS (SELECT *, row_number() OVER (ORDER BY day) AS step, count(*) OVER () AS n FROM snap) SELECT day, step, round(expansion, 6) AS expansion FROM d WHERE step > 60 AND ((step - 1) % 7 = 0 OR step = n)",
)
def weekly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After 60 dates of warm-up, every seventh date by number, and the last."""
    snap = windows.warm_rows(tables.snapshots(spark, sf_dir), "day", 0)
    last = snap.agg(F.max("step").alias("n"))
    rows = snap.crossJoin(F.broadcast(last)).where((F.col("step") > 60) & (((F.col("step") - 1) % 7 == 0) | (F.col("step") == F.col("n"))))
    return rows.select("day", "step", F.round("expansion", 6).alias("expansion"))


@query(
    "p12_completeness",
    "WITH w AS (SELECT user_id, count(DISTINCT date_trunc('week', ts)) AS weeks FROM events GROUP BY 1), t AS (SELECT count(DISTINCT date_trunc('week', ts)) AS total FROM events) SELECT user_id AS entity, weeks, round(weeks * 1.0 / total, 6) AS share FROM w, t WHERE weeks >= 0.5 * total",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select("user_id", F.date_trunc("week", "ts").alias("week")).distinct()
    total = e.agg(F.count_distinct("week").alias("total"))
    weeks = e.groupBy(F.col("user_id").alias("entity")).agg(F.count(F.lit(1)).alias("weeks"))
    return weeks.crossJoin(F.broadcast(total)).where("weeks >= 0.5 * total").select("entity", "weeks", F.round(F.col("weeks") / F.col("total"), 6).alias("share"))


@query("p14_minimum_sample", with_ctes("obs") + " SELECT entity, stream_key, count(raw) AS n, round(avg(raw), 6) AS mean FROM obs GROUP BY 1, 2 HAVING count(raw) >= 10")
def minimum_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.observations(spark, sf_dir).groupBy("entity", "stream_key").agg(F.count("raw").alias("n"), F.round(F.avg("raw"), 6).alias("mean"))
    return g.where("n >= 10")


@query("p18_clipped", with_ctes("obs") + ", s AS (SELECT stream_key, avg(raw) AS m, stddev_samp(raw) AS sd FROM obs GROUP BY 1) SELECT stream_key, round(sum(least(greatest((raw - m) / sd, -1.5), 1.5)), 4) AS clipped_sum, sum(CASE WHEN abs((raw - m) / sd) > 1.5 THEN 1 ELSE 0 END) AS n_clipped FROM obs JOIN s USING (stream_key) GROUP BY 1")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.observations(spark, sf_dir)
    stats = obs.groupBy("stream_key").agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("sd"))
    z = obs.join(F.broadcast(stats), "stream_key").withColumn("z", (F.col("raw") - F.col("m")) / F.col("sd"))
    return z.groupBy("stream_key").agg(F.round(F.sum(F.least(F.greatest("z", F.lit(-1.5)), F.lit(1.5))), 4).alias("clipped_sum"), F.sum((F.abs("z") > 1.5).cast("long")).alias("n_clipped"))


@query("p19_fuzzy_key", "SELECT q.q, min(p_name) AS resolved FROM (SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS q FROM part) q JOIN (SELECT DISTINCT p_name FROM part) p ON contains(p_name, q) GROUP BY 1 HAVING count(*) = 1")
def fuzzy_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial key resolves to the only full key that contains it.

    Both meet by an equi-join on grams as long as the shortest query: a query by its first, a key by all of its own.
    """
    keys = tables.table(spark, sf_dir, "part").select("p_name").distinct()
    asked = keys.select(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("q")).distinct()
    size = asked.agg(F.min(F.length("q"))).first()[0] or 1  # one number
    grams = keys.where(F.length("p_name") >= size).select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name") - size + 1)).alias("k"))
    grams = grams.withColumn("gram", F.expr(f"substring(p_name, k, {size})"))
    met = grams.join(asked.withColumn("gram", F.substring("q", 1, size)), "gram").where("substring(p_name, k, length(q)) = q")
    found = met.select("q", "p_name").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("resolved"))
    return found.where("n = 1").select("q", "resolved")


_PIVOT = ", ".join(f"round(max(CASE WHEN stream_key = '{k}' THEN x END), 6) AS \"{k}\"" for k in KEYS)


@query("j1_panel", with_ctes("daily") + f" SELECT day, {_PIVOT} FROM daily GROUP BY day")
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = joins.aligned(tables.daily(spark, sf_dir), "day", KEYS)
    return wide.select("day", *[F.round(k, 6).alias(k) for k in KEYS])


_FILLED = ", ".join(f'round(last_value("{k}" IGNORE NULLS) OVER w, 6) AS "{k}"' for k in KEYS)
_HOURLY = ", ".join(f"max(CASE WHEN stream_key = '{k}' THEN x END) AS \"{k}\"" for k in KEYS)


@query(
    "j2_carried_panel",
    with_ctes("obs") + f", h AS (SELECT date_trunc('hour', ts) AS hour, stream_key, avg(raw) AS x FROM obs GROUP BY 1, 2), wide AS (SELECT hour, {_HOURLY} FROM h GROUP BY hour), f AS (SELECT hour, {_FILLED} FROM wide WINDOW w AS (ORDER BY hour ROWS UNBOUNDED PRECEDING)) SELECT * FROM f WHERE " + " AND ".join(f'"{k}" IS NOT NULL' for k in KEYS),
)
def carried_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = tables.observations(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour"), "stream_key").agg(F.avg("raw").alias("x"))
    filled = joins.carried_panel(joins.aligned(hourly, "hour", KEYS), "hour", KEYS)
    return filled.select("hour", *[F.round(k, 6).alias(k) for k in KEYS])


@query("j3_common_dates", "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1) SELECT day, round(x, 2) AS x, round(y, 2) AS y FROM a JOIN b USING (day)")
def common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    b = tables.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    return a.join(b, "day")


@query(
    "j4_nearest_date",
    "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS other_day, sum(l_extendedprice) AS y FROM lineitem WHERE l_quantity > 48 AND l_tax < 0.03 GROUP BY 1), n AS (SELECT *, abs(date_diff('day', other_day, day)) AS gap FROM a JOIN b ON abs(date_diff('day', other_day, day)) <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY gap, other_day) AS k FROM n) SELECT day, other_day, gap, round(x, 2) AS x, round(y, 2) AS y FROM r WHERE k = 1",
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    b = tables.table(spark, sf_dir, "lineitem").where("l_quantity > 48 and l_tax < 0.03").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("y"))
    return joins.nearest_date(a, b, 3).select("day", "other_day", F.col("gap").cast("long").alias("gap"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("j5_ground_truth", with_ctes("snap", "windows") + " SELECT day, coalesce(max(CASE WHEN label = 'contraction' THEN 1 END), 0) AS truth, count(label) AS n_windows FROM snap LEFT JOIN windows ON day BETWEEN w_start AND w_end GROUP BY day")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = joins.in_windows(tables.snapshots(spark, sf_dir).select("day"), tables.windows(spark), how="left")
    return hit.groupBy("day").agg(F.coalesce(F.max(F.when(F.col("label") == "contraction", 1)), F.lit(0)).alias("truth"), F.count("label").alias("n_windows"))


@query("j8_before_after", with_ctes("long") + ", p AS (SELECT day, regime, p AS after, lag(p) OVER (PARTITION BY regime ORDER BY day) AS before FROM long) SELECT day, regime, round(before, 6) AS before, round(after, 6) AS after FROM p WHERE before IS NOT NULL")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.along(["regime"], ["day"])
    rows = tables.snapshots_long(spark, sf_dir).withColumn("before", F.lag("p").over(w)).where("before is not null")
    return rows.select("day", "regime", F.round("before", 6).alias("before"), F.round("p", 6).alias("after"))


@query("j9_branch_pairs", with_ctes("long") + " SELECT a.day, a.regime AS first, b.regime AS second, round(abs(a.p - b.p), 6) AS spread FROM long a JOIN long b ON a.day = b.day AND a.regime < b.regime WHERE abs(a.p - b.p) < 0.05")
def branch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = tables.snapshots_long(spark, sf_dir)
    a, b = long.select("day", F.col("regime").alias("first"), F.col("p").alias("p1")), long.select("day", F.col("regime").alias("second"), F.col("p").alias("p2"))
    near = a.join(b, "day").where((F.col("first") < F.col("second")) & (F.abs(F.col("p1") - F.col("p2")) < 0.05))
    return near.select("day", "first", "second", F.round(F.abs(F.col("p1") - F.col("p2")), 6).alias("spread"))


@query("j11_uncovered", "SELECT CAST(a.o_orderdate AS DATE) AS day, count(*) AS n FROM orders a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE CAST(b.l_shipdate AS DATE) = CAST(a.o_orderdate AS DATE) AND b.l_quantity = 50) GROUP BY 1 HAVING count(*) >= 2")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that no observation covers: an anti join, then a minimum count."""
    a = tables.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    b = tables.table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.to_date("l_shipdate").alias("day"))
    return a.join(b, "day", "left_anti").groupBy("day").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def _series() -> WindowSpec:
    return windows.along(["series"], ["month"])


@query("w1_yoy", with_ctes("monthly") + " SELECT * FROM (SELECT month, series, round((x / lag(x, 12) OVER (PARTITION BY series ORDER BY month) - 1) * 100, 6) AS yoy FROM monthly) WHERE yoy IS NOT NULL")
def yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.monthly_sales(spark, sf_dir)
    return m.select("month", "series", F.round(windows.pct_change(F.col("x"), _series(), 12), 6).alias("yoy")).where("yoy is not null")


@query(
    "w2_w3_w5_returns",
    with_ctes("monthly") + ", p AS (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY month) AS b FROM monthly) SELECT month, series, round(ln(x / b) * 100, 6) AS log_return, round(x - b, 4) AS diff, round((x - b) / (abs(b) + 1e-10), 6) AS simple FROM p WHERE b IS NOT NULL",
)
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    m = tables.monthly_sales(spark, sf_dir).select("month", "series", F.round(windows.log_return(x, _series()), 6).alias("log_return"), F.round(windows.difference(x, _series()), 4).alias("diff"), F.round(windows.simple_return(x, _series()), 6).alias("simple"))
    return m.where("diff is not null")


@query("w7_resample", with_ctes("daily") + " SELECT stream_key, CAST(date_trunc('week', day) AS DATE) + 6 AS week_end, round(avg(x), 6) AS mean, round(arg_max(x, day), 6) AS last FROM daily GROUP BY 1, 2")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly means and last values, weeks ending on Sunday."""
    week = F.date_add(F.to_date(F.date_trunc("week", "day")), 6).alias("week_end")
    return tables.daily(spark, sf_dir).groupBy("stream_key", week).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max_by("x", "day"), 6).alias("last"))


@query("w8_rolling_mean", with_ctes("monthly") + ", r AS (SELECT month, series, x, avg(x) OVER w AS m, count(x) OVER w AS n FROM monthly WINDOW w AS (PARTITION BY series ORDER BY month ROWS 11 PRECEDING)) SELECT month, series, round(m, 4) AS mean, round(x - m, 4) AS residual FROM r WHERE n >= 6")
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.monthly_sales(spark, sf_dir).withColumn("m", windows.rolling_mean(F.col("x"), _series(), 12, 6)).where("m is not null")
    return m.select("month", "series", F.round("m", 4).alias("mean"), F.round(F.col("x") - F.col("m"), 4).alias("residual"))


@query("w9_autocorrelation", with_ctes("monthly") + ", p AS (SELECT series, x, lag(x) OVER (PARTITION BY series ORDER BY month) AS b FROM monthly) SELECT series, round(least(greatest(corr(x, b), 0.5), 0.99), 6) AS rho, count(*) AS n, round(power(abs(corr(x, b)), 1.0 / 22), 6) AS daily FROM p WHERE b IS NOT NULL GROUP BY 1")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = windows.autocorrelation(tables.monthly_sales(spark, sf_dir), ["series"], ["month"], "x")
    return m.select("series", F.round(F.least(F.greatest("rho", F.lit(0.5)), F.lit(0.99)), 6).alias("rho"), "n", F.round(F.pow(F.abs("rho"), F.lit(1.0 / 22)), 6).alias("daily"))


@query(
    "w10_lagged_cross_correlation",
    with_ctes("monthly") + ", d AS (SELECT month, series, (x / lag(x) OVER (PARTITION BY series ORDER BY month) - 1) AS r, row_number() OVER (PARTITION BY series ORDER BY month) AS i FROM monthly), c AS (SELECT a.series AS cause, b.series AS effect, k.k AS lag, corr(a.r, b.r) AS r FROM d a CROSS JOIN (SELECT unnest(range(1, 7)) AS k) k JOIN d b ON b.i = a.i + k.k AND b.series <> a.series GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY cause, effect ORDER BY abs(r) DESC, lag) AS rn FROM c) SELECT cause, effect, lag, round(0.1 * r, 6) AS coefficient FROM m WHERE rn = 1 AND abs(r) > 0.15",
)
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest lagged correlation of every ordered pair of series, lags 1 to 6."""
    m = tables.monthly_sales(spark, sf_dir)
    d = m.select("series", (F.col("x") / F.lag("x").over(_series()) - 1).alias("r"), F.row_number().over(_series()).alias("i"))
    a = d.select(F.col("series").alias("cause"), F.col("r").alias("ra"), "i", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("lag")).withColumn("i", F.col("i") + F.col("lag"))
    b = d.select(F.col("series").alias("effect"), F.col("r").alias("rb"), "i")
    c = a.join(b, "i").where("cause <> effect").groupBy("cause", "effect", F.col("lag").cast("long").alias("lag")).agg(scalars.correlation("ra", "rb").alias("r"))
    best = c.withColumn("rn", F.row_number().over(Window.partitionBy("cause", "effect").orderBy(F.abs("r").desc(), "lag")))
    return best.where((F.col("rn") == 1) & (F.abs("r") > 0.15)).select("cause", "effect", "lag", F.round(0.1 * F.col("r"), 6).alias("coefficient"))


@query(
    "w12_slopes",
    with_ctes("long") + ", s AS (SELECT day, regime, coalesce((p - lag(p, 5) OVER w) / 5, 0.0) AS s5, coalesce((p - lag(p, 13) OVER w) / 13, 0.0) AS s13, coalesce((p - lag(p, 26) OVER w) / 26, 0.0) AS s26 FROM long WINDOW w AS (PARTITION BY regime ORDER BY day)) SELECT day, regime, round(s5, 6) AS slope_5, round(s13, 6) AS slope_13, round(s26, 6) AS slope_26, round(s5 - s13, 6) AS acceleration FROM s",
)
def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = windows.along(["regime"], ["day"]), F.col("p")
    s = tables.snapshots_long(spark, sf_dir).select("day", "regime", *[windows.slope(p, w, k).alias(f"s{k}") for k in (5, 13, 26)])
    return s.select("day", "regime", *[F.round(f"s{k}", 6).alias(f"slope_{k}") for k in (5, 13, 26)], F.round(F.col("s5") - F.col("s13"), 6).alias("acceleration"))


@query(
    "w13_rolling_features",
    with_ctes("obs") + ", r AS (SELECT seq, entity, sum(CASE WHEN stream_key = 'US_CPI_YOY' THEN raw ELSE 0 END) OVER w AS inflation_sum, avg(abs(raw)) OVER w AS mean_size FROM obs WINDOW w AS (PARTITION BY entity ORDER BY ts, seq ROWS 9 PRECEDING)) SELECT entity, seq, round(inflation_sum, 6) AS inflation_sum, round(mean_size, 6) AS mean_size FROM r",
)
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.along(["entity"], ["ts", "seq"]).rowsBetween(-9, 0)
    obs = tables.observations(spark, sf_dir)
    return obs.select("entity", "seq", F.round(F.sum(F.when(F.col("stream_key") == "US_CPI_YOY", F.col("raw")).otherwise(0.0)).over(w), 6).alias("inflation_sum"), F.round(F.avg(F.abs("raw")).over(w), 6).alias("mean_size"))


@query(
    "w15_tier_crossings",
    with_ctes("long") + ", p AS (SELECT day, regime, p, lag(p) OVER (PARTITION BY regime ORDER BY day) AS b FROM long) SELECT day, regime, t.tier AS tier, CASE WHEN p >= t.tier THEN 'up' ELSE 'down' END AS direction FROM p CROSS JOIN (VALUES (0.25), (0.5), (0.75)) t(tier) WHERE (b < t.tier AND p >= t.tier) OR (b >= t.tier AND p < t.tier)",
)
def tier_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.along(["regime"], ["day"])
    rows = tables.snapshots_long(spark, sf_dir).withColumn("b", F.lag("p").over(w)).where("b is not null")
    rows = rows.withColumn("tier", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    up, down = (F.col("b") < F.col("tier")) & (F.col("p") >= F.col("tier")), (F.col("b") >= F.col("tier")) & (F.col("p") < F.col("tier"))
    return rows.where(up | down).select("day", "regime", F.col("tier").cast("decimal(3,2)").alias("tier"), F.when(up, "up").otherwise("down").alias("direction"))


_STREAK = "g AS (SELECT *, sum(CASE WHEN flag = b THEN 0 ELSE 1 END) OVER (PARTITION BY regime ORDER BY day) AS run FROM (SELECT *, lag(flag) OVER (PARTITION BY regime ORDER BY day) AS b FROM f))"


@query("w18_extinction", with_ctes("long") + f", f AS (SELECT day, regime, p < 0.2 AS flag FROM long), {_STREAK} SELECT regime, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM g WHERE flag GROUP BY regime, run HAVING count(*) >= 3")
def extinction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three snapshots of a probability under a fifth."""
    return triggers.extinction(tables.snapshots_long(spark, sf_dir), ["regime"], ["day"], bound=0.2, length=3).drop("flag")


@query(
    "w16_sustained_drift",
    with_ctes("long") + f", m AS (SELECT day, regime, p - lag(p) OVER (PARTITION BY regime ORDER BY day) AS d FROM long), f AS (SELECT day, regime, CASE WHEN d > 0.001 THEN 1 WHEN d < -0.001 THEN -1 ELSE 0 END AS flag FROM m WHERE d IS NOT NULL), {_STREAK} SELECT regime, flag AS direction, min(day) AS first_day, count(*) AS n FROM g WHERE flag <> 0 GROUP BY regime, run, flag HAVING count(*) >= 3",
)
def sustained_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three moves in one direction."""
    return triggers.sustained_drift(tables.snapshots_long(spark, sf_dir), ["regime"], ["day"], length=3).select("regime", F.col("flag").alias("direction"), "first_day", "n")


_ARGMAX = "CASE WHEN expansion >= stagflation AND expansion >= contraction THEN 'expansion' WHEN stagflation >= contraction THEN 'stagflation' ELSE 'contraction' END"


@query(
    "w22_w23_dominant_streaks",
    with_ctes("snap") + f", f AS (SELECT day, 'all' AS regime, {_ARGMAX} AS flag FROM snap), {_STREAK} SELECT flag AS dominant, min(day) AS first_day, count(*) AS n FROM g GROUP BY run, flag HAVING count(*) >= 2",
)
def dominant_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same most probable regime; the first in order wins a tie."""
    e, s, c = (F.col(x) for x in ("expansion", "stagflation", "contraction"))
    top = F.when((e >= s) & (e >= c), "expansion").when(s >= c, "stagflation").otherwise("contraction")
    runs = windows.islands(tables.snapshots(spark, sf_dir).withColumn("g", F.lit(0)), ["g"], ["day"], top)
    return runs.groupBy("run", F.col("flag").alias("dominant")).agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("run")
