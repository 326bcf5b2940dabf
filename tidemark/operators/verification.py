"""Forecast verification: scores of probability forecasts (columns p, outcome) by groups, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import distributions, scalars


def bin_of(p: Column, bins: int) -> Column:
    """Equal-width bin from 0, the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def murphy(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Brier score with its reliability, resolution and uncertainty, and skill against climatology."""
    parts = df.groupBy(*keys, bin_of(F.col("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("outcome").alias("so"), F.sum(F.pow(F.col("p") - F.col("outcome"), 2)).alias("se")
    )
    totals = parts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("so").alias("hits"), F.sum("se").alias("errors"))
    rows = parts.join(totals, keys).withColumn("base", F.col("hits") / F.col("total"))
    rate = F.col("so") / F.col("n")
    out = rows.groupBy(*keys).agg(
        (F.max("errors") / F.max("total")).alias("brier"),
        (F.sum(F.col("n") * F.pow(F.col("sp") / F.col("n") - rate, 2)) / F.max("total")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(rate - F.col("base"), 2)) / F.max("total")).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )
    return out.withColumn("skill", 1 - F.col("brier") / F.col("uncertainty"))


def bias_corrected(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Reliability and resolution less the bias of small bins, floored at 0."""
    parts = df.groupBy(*keys, bin_of(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("outcome").alias("mo"))
    totals = parts.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mo")) / F.sum("n")).alias("base"))
    rows = parts.join(totals, keys)
    noise = F.when(F.col("n") > 1, F.col("mo") * (1 - F.col("mo")) / (F.col("n") - 1)).otherwise(0.0)
    share = F.col("n") / F.col("total")
    out = rows.groupBy(*keys).agg(
        F.sum(share * (F.pow(F.col("mp") - F.col("mo"), 2) - noise)).alias("reliability"),
        F.sum(share * (F.pow(F.col("mo") - F.col("base"), 2) - noise)).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base")) / (F.col("total") - 1)).alias("shift"),
    )
    zero = F.lit(0.0)
    return out.select(*keys, F.greatest("reliability", zero).alias("reliability"), F.greatest(F.col("resolution") + F.col("shift"), zero).alias("resolution"))


def roc(df: DataFrame, keys: list[str], thresholds: int = 101) -> DataFrame:
    """Rates of true and false alarms at falling thresholds, a row for each.

    Forecasts are counted by the last threshold they reach, so the table is read once whatever the number of thresholds.
    """
    top = thresholds - 1
    counts = df.groupBy(*keys, F.floor(F.round(F.col("p") * top, 9)).alias("k")).agg(F.sum("outcome").alias("tp"), F.sum(1 - F.col("outcome")).alias("fp"))
    grid = counts.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top).cast("long"))))
    w = Window.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    rows = grid.join(counts, [*keys, "k"], "left").fillna(0, ["tp", "fp"])
    rows = rows.withColumns({"ctp": F.sum("tp").over(w), "cfp": F.sum("fp").over(w), "p1": F.sum("tp").over(everything), "p0": F.sum("fp").over(everything)})
    return rows.select(*keys, (F.col("k") / top).alias("threshold"), (F.col("ctp") / F.col("p1")).alias("tpr"), (F.col("cfp") / F.col("p0")).alias("fpr"))


def auc(df: DataFrame, keys: list[str], thresholds: int = 101) -> DataFrame:
    """Area by trapezoids, and the first threshold from above of the largest tpr - fpr."""
    w = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    r = roc(df, keys, thresholds)
    r = r.withColumn("area", (F.col("fpr") - F.coalesce(F.lag("fpr").over(w), F.lit(0.0))) * (F.col("tpr") + F.coalesce(F.lag("tpr").over(w), F.lit(0.0))) / 2)
    return r.groupBy(*keys).agg(F.sum("area").alias("auc"), F.max_by("threshold", F.struct(F.round(F.col("tpr") - F.col("fpr"), 9), "threshold")).alias("best"))


def calibration_curve(df: DataFrame, keys: list[str], buckets: int = 10) -> DataFrame:
    """Mean forecast and outcome of each bucket that has any."""
    g = df.groupBy(*keys, bin_of(F.col("p"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("forecast"), F.avg("outcome").alias("observed"))
    return g.withColumn("deviation", F.abs(F.col("forecast") - F.col("observed")))


def ljung_box(df: DataFrame, keys: list[str], order: list[str], x: str, lags: int) -> DataFrame:
    """Q over so many lags: products with lagged values summed in one pass over each series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    means = df.groupBy(*keys).agg(F.avg(x).alias("__m"), F.count(x).alias("n"))
    rows = df.where(F.col(x).isNotNull()).join(means, keys).withColumn("__d", F.col(x) - F.col("__m"))
    rows = rows.withColumns({f"__l{k}": F.col("__d") * F.lag("__d", k).over(w) for k in range(1, lags + 1)})
    sums = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("v"), *[F.sum(f"__l{k}").alias(f"s{k}") for k in range(1, lags + 1)])
    total = sum((F.pow(F.col(f"s{k}") / F.col("v"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.select(*keys, "n", (F.col("n") * (F.col("n") + 2) * total).alias("q"))


def diebold_mariano(df: DataFrame, keys: list[str], order: list[str], horizon: int) -> DataFrame:
    """The statistic of the loss difference d with autocovariances up to horizon - 1 and the small-sample factor."""
    w = Window.partitionBy(*keys).orderBy(*order)
    means = df.groupBy(*keys).agg(F.avg("d").alias("m"), F.count("d").alias("n"))
    rows = df.join(means, keys).withColumn("c", F.col("d") - F.col("m"))
    rows = rows.withColumns({f"g{k}": F.col("c") * F.lag("c", k).over(w) for k in range(1, horizon)})
    extra = [F.sum(f"g{k}").alias(f"g{k}") for k in range(1, horizon)]
    sums = rows.groupBy(*keys).agg(F.max("m").alias("m"), F.max("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("g0"), *extra)
    variance = (F.col("g0") + 2 * sum((F.col(f"g{k}") for k in range(1, horizon)), F.lit(0.0))) / F.col("n") / F.col("n")
    n, h = F.col("n"), horizon
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return sums.select(*keys, "n", (F.col("m") / F.sqrt(variance) * factor).alias("statistic"))


def diebold_mariano_test(df: DataFrame, keys: list[str], d: str, horizon: int, span: int = 1 << 12) -> DataFrame:
    """(keys, n, mean_difference, statistic, p_value, verdict) of loss differences d at positions __pos: negative, the first is better.

    The sample variance, with mean products at lags up to horizon - 1 and the small-sample factor; two-sided by the normal
    distribution.  A difference that hardly varies is none.  Lags are taken in ranges of positions, each with the last
    horizon - 1 rows of the range before.
    """
    last = horizon - 1
    rows = df.select(*keys, "__pos", F.col(d).alias("__d")).withColumn("__own", F.floor(F.col("__pos") / span))
    reach = F.when((F.col("__pos") % span >= span - last) & F.lit(last > 0), F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))
    means = rows.groupBy(*keys).agg(F.avg("__d").alias("__m"), F.count("__d").alias("n"), F.var_samp("__d").alias("__v"))
    w = Window.partitionBy(*keys, "__range").orderBy("__pos")
    lagged = rows.withColumn("__range", F.explode(reach)).select("*", *[F.lag("__d", k).over(w).alias(f"__l{k}") for k in range(1, horizon)]).where("__range = __own")
    products = [F.avg((F.col("__d") - F.col("__m")) * (F.col(f"__l{k}") - F.col("__m"))) for k in range(1, horizon)]
    spread = F.col("__v") + 2 * sum((F.col(f"__g{k}") for k in range(1, horizon)), F.lit(0.0))
    g = lagged.join(means, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("__m").alias("mean_difference"), F.max("__v").alias("__v"), *[p.alias(f"__g{k}") for k, p in enumerate(products, 1)])
    g = g.withColumn("__se", F.sqrt(F.greatest(spread, F.lit(0.0)) / F.col("n")))
    n, h = F.col("n"), horizon
    statistic = F.col("mean_difference") / F.nullif(F.col("__se"), F.lit(0.0)) * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    g = g.withColumn("statistic", F.when(F.col("__se") < 1e-12, 0.0).otherwise(statistic)).withColumn("p_value", 2 * (1 - distributions.normal_cdf(F.abs("statistic"))))
    verdict = F.when(F.col("p_value") >= 0.05, "no significant difference").when(F.col("statistic") < 0, "first better").otherwise("second better")
    return g.select(*keys, "n", "mean_difference", "statistic", "p_value", verdict.alias("verdict"))


def whiteness_detail(df: DataFrame, keys: list[str], order: list[str], x: str, lags: int = 10, least: int = 50, same: float = 1e-10) -> DataFrame:
    """Autocorrelations at lags 1, 2, 5 and 10, repeated values and their runs, and the first lag at which Ljung-Box passes, of series of at least so many values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    means = df.groupBy(*keys).agg(F.avg(x).alias("__m"), F.count(x).alias("n")).where(F.col("n") >= least)
    rows = df.where(F.col(x).isNotNull()).join(means, keys).withColumn("__c", F.col(x) - F.col("__m"))
    repeat = F.coalesce(F.abs(F.col(x) - F.lag(x).over(w)) < same, F.lit(False))
    rows = rows.select(*keys, *order, "n", "__c", repeat.cast("int").alias("__same"), *[F.lag("__c", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    rows = rows.withColumn("__run", F.sum(1 - F.col("__same")).over(w))
    runs = rows.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__size")).where("__size > 1").groupBy(*keys).agg(F.max("__size").alias("max_run"), F.avg("__size").alias("avg_run"), F.count(F.lit(1)).alias("n_runs"))
    g = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("__same").alias("__repeats"), F.sum(F.col("__c") * F.col("__c")).alias("__v"), *[F.sum(F.col("__c") * F.col(f"__l{k}")).alias(f"__s{k}") for k in range(1, lags + 1)])
    acf = {k: F.try_divide(F.col(f"__s{k}"), F.col("__v")) for k in range(1, lags + 1)}
    q, passes = F.lit(0.0), F.lit(None).cast("int")
    tests = []
    for k, r in acf.items():
        q = q + r * r / (F.col("n") - k)
        tests.append(distributions.chi_squared_p(F.col("n") * (F.col("n") + 2) * q, F.lit(k)).alias(f"__p{k}"))
    g = g.select("*", *tests)
    for k in reversed(acf):
        passes = F.when(F.col(f"__p{k}") > 0.05, k).otherwise(passes)
    found = g.join(runs, keys, "left")
    shown = [acf[k].alias(f"acf_{k}") for k in (1, 2, 5, 10) if k in acf]
    none = F.lit(0).cast("long")
    return found.select(*keys, "n", *shown, (F.col("__repeats") / (F.col("n") - 1)).alias("repeats"), F.coalesce("max_run", none).alias("max_run"), F.coalesce("avg_run", F.lit(0.0)).alias("avg_run"), F.coalesce("n_runs", none).alias("n_runs"), passes.alias("first_pass_lag"))


def berkowitz(df: DataFrame, keys: list[str], order: str, z: str, span: int = 1 << 16) -> DataFrame:
    """Likelihood ratio of an AR(1) on normal scores against independent standard ones, over all consecutive pairs of a series.

    Series are cut into ranges of `order` (whole numbers) of this span; the last row of every range is the one before the
    first of the next that has rows, so no task needs more of a series than a range and a row for each range.
    """
    rows = df.where(F.col(z).isNotNull()).select(*keys, F.col(order).alias("__at"), F.col(z).alias("z")).withColumn("__part", F.floor(F.col("__at") / span))
    within = rows.withColumn("b", F.lag("z").over(Window.partitionBy(*keys, "__part").orderBy("__at"))).where("b is not null")
    ends = rows.groupBy(*keys, "__part").agg(F.min_by("z", "__at").alias("z"), F.max_by("z", "__at").alias("last"))
    across = ends.withColumn("b", F.lag("last").over(Window.partitionBy(*keys).orderBy("__part")))
    pairs = within.select(*keys, "z", "b").unionByName(across.select(*keys, "z", "b"))
    now = F.when(F.col("b").isNotNull(), F.col("z"))
    g = pairs.groupBy(*keys).agg(F.count("b").alias("n"), F.avg("z").alias("mu"), F.sum(now).alias("sz"), F.sum("b").alias("sb"), F.sum(now * now).alias("zz"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("z") * F.col("b")).alias("zb")).where("n > 0")
    g = g.withColumn("var_b", F.expr("bb - 2 * mu * sb + n * mu * mu")).withColumn("cov", F.expr("zb - mu * (sz + sb) + n * mu * mu"))
    g = g.withColumn("rho", F.expr("case when var_b > 1e-12 then cov / var_b else 0D end"))
    g = g.withColumn("sigma", F.expr("greatest(sqrt(greatest((zz - 2 * mu * sz + n * mu * mu - 2 * rho * cov + rho * rho * var_b) / n, 0D)), 1e-6D)"))
    rss = F.expr("zz - 2 * mu * sz + n * mu * mu - 2 * rho * cov + rho * rho * var_b")
    lr = F.greatest(F.col("zz") - rss / (F.col("sigma") * F.col("sigma")) - 2 * F.col("n") * F.ln("sigma"), F.lit(0.0))
    return g.select(*keys, "n", "rho", "sigma", lr.alias("lr"))


def pit_histogram(df: DataFrame, keys: list[str], pit: Column, bins: int = 10) -> DataFrame:
    """(keys, n, bins, chi_squared): counts of probability integral transforms against uniform; `bins` is how many have any."""
    h = df.groupBy(*keys, bin_of(pit, bins).alias("__bin")).agg(F.count(F.lit(1)).alias("__k"))
    e = F.sum("__k") / bins
    return h.groupBy(*keys).agg(F.sum("__k").alias("n"), F.count(F.lit(1)).alias("bins"), (F.sum(F.col("__k") * F.col("__k")) / e - F.sum("__k")).alias("chi_squared"))


def segmented_whiteness(df: DataFrame, keys: list[str], segment: str, order: list[str], x: str, lags: int = 10, least: int = 20) -> DataFrame:
    """Ljung-Box of each segment of a series, segments of more than `least` values only."""
    return ljung_box(df, [*keys, segment], order, x, lags).where(F.col("n") > least)


def suite(df: DataFrame, bins: int = 10) -> DataFrame:
    """(regime, metric, value) of forecasts (regime, p, outcome): Brier parts, bias-corrected parts, AUC and best threshold."""
    parts = [(murphy(df, ["regime"], bins), ["brier", "reliability", "resolution", "uncertainty", "skill"], ""), (bias_corrected(df, ["regime"], bins), ["reliability", "resolution"], "corrected_"), (auc(df, ["regime"], 200), ["auc", "best"], "")]
    out = None
    for frame, names, prefix in parts:
        rows = frame.select("regime", *[F.col(n).cast("double").alias(prefix + n) for n in names]).unpivot(["regime"], [prefix + n for n in names], "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def by_factor(updates: DataFrame, gain: str, z: str, factors: list[str]) -> DataFrame:
    """A column for each factor: its share of an update's innovation, gain times standardised innovation."""
    return updates.select("*", *[(F.get(F.col(gain), F.lit(i)) * F.col(z)).alias(f"__f_{f}") for i, f in enumerate(factors)])


def factor_correlations(df: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(keys, n, first, second, r) of every pair of `by_factor`'s columns, from one aggregation; null where one never moves."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[scalars.correlation(f"__f_{a}", f"__f_{b}").alias(f"{a}|{b}") for a, b in pairs])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return g.select(*keys, "n", each.alias("p")).select(*keys, "n", "p.*")
