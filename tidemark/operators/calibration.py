"""Parameters of the engine estimated from a long panel: components, loadings, persistence, channels between factors, noise; and the test that asks for them.

Everything over observations is a window, join or sum in Spark. What is left is a matrix with a row for each stream.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import scalars
from tidemark.operators import filters, windows
from tidemark.operators.estimation import varimax

PARAMETER_SCHEMA = "kind string, name string, other string, value double"


def returns(panel: DataFrame, order: str = "day") -> DataFrame:
    """(order, stream_key, x): simple returns of (order, stream_key, x); a stream's first row has none."""
    w = windows.along(["stream_key"], [order])
    return panel.select(order, "stream_key", windows.simple_return(F.col("x"), w).alias("x")).where("x is not null")


def correlations(panel: DataFrame, order: str = "day") -> DataFrame:
    """(i, j, r, n): Pearson correlation of every pair of streams on their common rows, null for a stream that never moves."""
    a, b = (panel.select(order, F.col("stream_key").alias(k), F.col("x").alias(f"x{k}")) for k in "ij")
    return a.join(b, order).groupBy("i", "j").agg(scalars.correlation("xi", "xj").alias("r"), F.count(F.lit(1)).alias("n"))


def components(cells: DataFrame, count: int = len(c.FACTORS), scaled: bool = True, rotated: bool = False) -> DataFrame:
    """(stream_key, component, loading, share, residual) of correlations (i, j, r), the largest component first.

    Loadings are eigenvectors, times the root of the eigenvalue if `scaled`, turned by varimax if `rotated`; before that, the largest of a component is positive. `residual` is
    the part of a standardised stream that these components leave, `share` what a component explains of the whole.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.pivot(index="i", columns="j", values="r").astype(float).fillna(0.0)
        value, vec = np.linalg.eigh(r.to_numpy())
        value, vec = np.maximum(value[::-1], 0.0), vec[:, ::-1]
        vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(len(value))])
        m = min(count, len(value))
        load = vec[:, :m] * np.sqrt(value[:m])
        rest = np.diag(r.to_numpy()) - (load**2).sum(axis=1)
        shown = load if scaled else vec[:, :m]
        shown = varimax(shown) if rotated else shown
        rows = [(s, k + 1, float(shown[i, k]), float(value[k] / max(value.sum(), 1e-300)), float(max(rest[i], 0.0))) for i, s in enumerate(r.index) for k in range(m)]
        return pd.DataFrame(rows, columns=["stream_key", "component", "loading", "share", "residual"])

    return cells.groupBy(F.lit(0).alias("g")).applyInPandas(run, "stream_key string, component int, loading double, share double, residual double")


def scores(panel: DataFrame, loadings: DataFrame, order: str = "day") -> DataFrame:
    """(order, component, score): standardised rows of (order, stream_key, x) along unscaled loadings; the panel must be complete."""
    stats = panel.groupBy("stream_key").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = panel.join(F.broadcast(stats), "stream_key").withColumn("z", F.when(F.col("sd") > 1e-10, (F.col("x") - F.col("m")) / F.col("sd")).otherwise(0.0))  # a row for each stream
    return z.join(F.broadcast(loadings.select("stream_key", "component", "loading")), "stream_key").groupBy(order, "component").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))


def hand_loadings(spark: SparkSession, streams: dict[str, dict[str, float]] = c.STREAM_LOADINGS) -> DataFrame:
    """(stream_key, factor, hand): every stream with every factor, 0 where it has no loading."""
    return spark.createDataFrame([(s, f, float(v.get(f, 0.0))) for s, v in streams.items() for f in c.FACTORS], "stream_key string, factor string, hand double")


def loading_match(loadings: DataFrame, hand: DataFrame) -> DataFrame:
    """(factor, component, r, mean_size, verdict): the component whose loadings correlate most with a factor's by hand, either sign, the first on ties.

    Factors without any difference between streams are left out, constant components count 0.
    """
    cells = hand.join(loadings, "stream_key").groupBy("factor", "component").agg(scalars.correlation("hand", "loading").alias("r"), F.stddev_pop("hand").alias("sd"))
    r = F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))
    best = cells.where("sd >= 1e-10").withColumn("r", r).groupBy("factor").agg(F.max_by(F.struct("component", "r"), F.struct(F.abs("r"), -F.col("component"))).alias("b"))
    size = F.avg(F.abs("b.r")).over(Window.partitionBy())  # a row for each factor
    rows = best.select("factor", "b.component", "b.r", size.alias("mean_size"))
    return rows.withColumn("verdict", F.when(F.col("mean_size") > 0.5, "GOOD").when(F.col("mean_size") > 0.3, "MODERATE").otherwise("WEAK"))


def _loadings(moves: DataFrame, order: str, least: float) -> DataFrame:
    """(stream_key, factor, loading) of returns: component k stands for the k-th factor."""
    found = components(correlations(moves, order)).select("stream_key", F.element_at(F.array(*[F.lit(f) for f in c.FACTORS]), F.col("component")).alias("factor"), "loading")
    return found.where(F.abs("loading") > least).withColumn("loading", F.round("loading", 4))


def _persistence(panel: DataFrame, loadings: DataFrame, order: str) -> DataFrame:
    best = loadings.groupBy("factor").agg(F.max_by("loading", F.abs("loading")).alias("top"), F.max(F.abs("loading")).alias("size"))
    first = loadings.join(best, "factor").where(F.abs("loading") == F.col("size")).groupBy("factor").agg(F.min("stream_key").alias("stream_key"))
    rho = windows.autocorrelation(panel, ["stream_key"], [order], "x")
    known = F.when((F.col("n") > 1) & F.col("rho").isNotNull() & ~F.isnan("rho"), F.round(F.least(F.greatest(F.col("rho"), F.lit(0.5)), F.lit(0.99)), 4))
    all_factors = panel.sparkSession.createDataFrame([(f,) for f in c.FACTORS], "factor string")
    return all_factors.join(first, "factor", "left").join(rho, "stream_key", "left").select("factor", F.coalesce(known, F.lit(0.9)).alias("value"))


def _channels(moves: DataFrame, loadings: DataFrame, order: str, lags: int, least: float) -> DataFrame:
    """(source, target, value): a tenth of the largest lagged correlation of two factors' series, where it passes `least`."""
    series = moves.join(loadings, "stream_key").groupBy(order, "factor").agg(F.sum(F.col("x") * F.col("loading")).alias("v"))
    series = series.withColumn("at", F.row_number().over(windows.along(["factor"], [order])))
    late = series.select(F.col("factor").alias("source"), F.col("v").alias("x"), "at", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).withColumn("at", F.col("at") + F.col("lag"))
    pairs = late.join(series.select(F.col("factor").alias("target"), F.col("v").alias("y"), "at"), "at").where("source <> target")
    cells = pairs.groupBy("source", "target", "lag").agg(scalars.correlation("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 10 and r is not null and not isnan(r)")
    peak = cells.groupBy("source", "target").agg(F.max_by("r", F.struct(F.abs("r"), -F.col("lag"))).alias("r"))
    return peak.where(F.abs("r") > least).select("source", "target", F.round(F.col("r") * 0.1, 4).alias("value"))


def estimated(panel: DataFrame, order: str = "day", least_loading: float = 0.05, least_channel: float = 0.15, lags: int = 6) -> DataFrame:
    """(kind, name, other, value): a version of the engine's parameters from a complete panel (order, stream_key, x).

    `loading` of stream and factor, `noise` of a stream, `persistence` of a factor (0.9 where nothing tells), `channel` from a factor to another.
    A stream without a loading has its whole variance as noise; an empty panel gives persistences only.
    """
    moves = returns(panel, order)
    found = _loadings(moves, order, least_loading)
    explained = found.groupBy("stream_key").agg(F.sum(F.col("loading") * F.col("loading")).alias("e"))
    spread = moves.groupBy("stream_key").agg(F.var_pop("x").alias("v")).join(explained, "stream_key", "left")
    noise = F.round(F.greatest(F.lit(0.01), F.col("v") * F.greatest(F.lit(0.0), 1 - F.coalesce("e", F.lit(0.0)))), 4)

    def rows(df: DataFrame, kind: str, name: str, other: Column, value: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), other.cast("string").alias("other"), value.alias("value"))

    none = F.lit(None)
    parts = [
        rows(found, "loading", "stream_key", F.col("factor"), F.col("loading")), rows(spread, "noise", "stream_key", none, noise),
        rows(_persistence(panel, found, order), "persistence", "factor", none, F.col("value")), rows(_channels(moves, found, order, lags, least_channel), "channel", "source", F.col("target"), F.col("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def applied(config: filters.Config, parameters: Iterable[Row]) -> filters.Config:
    """A configuration with these parameters: loadings and noise of the streams named, the transition's diagonal, and only the channels given.

    Process noise stays what the constants make of it. The rows are as many as streams and factors, so the driver holds them.
    """
    f, streams, noises = np.diag([c.PERSISTENCE[k] for k in c.FACTORS]), {}, {}
    at = {k: i for i, k in enumerate(c.FACTORS)}
    for p in parameters:
        if p["kind"] == "loading":
            streams.setdefault(p["name"], {})[p["other"]] = p["value"]
        elif p["kind"] == "noise":
            noises[p["name"]] = p["value"]
            streams.setdefault(p["name"], {})
        elif p["name"] in at and p["kind"] == "persistence":
            f[at[p["name"]], at[p["name"]]] = p["value"]
        elif p["name"] in at and p["other"] in at:
            f[at[p["other"]], at[p["name"]]] = p["value"]
    return replace(config, streams={**config.streams, **streams}, noises={**config.noises, **noises}, transition=tuple(map(tuple, f.tolist())))


def diagnosis(updates: DataFrame, keys: list[str], order: str = "n", z: str = "z", last: int = 500) -> DataFrame:
    """Whether the last innovations of each key are centred, of unit spread, white and seldom large: (keys, n, ..., status).

    Under ten of them the status is insufficient_data; innovations that never move have no autocorrelation and aren't white.
    """
    recent = updates.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__k") <= last)
    before = F.lag(z).over(windows.along(keys, [order]))
    g = recent.withColumn("__b", before).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(z).alias("mean_z"), F.stddev_pop(z).alias("std_z"),
        scalars.correlation(F.when(F.col("__b").isNotNull(), F.col(z)), "__b").alias("autocorrelation"), F.avg((F.abs(z) > 2).cast("double")).alias("anomaly_rate"),
    )
    g = g.withColumns({
        "zero_mean": F.abs("mean_z") < 0.5, "unit_variance": (F.col("std_z") > 0.5) & (F.col("std_z") < 2),
        "white": F.coalesce(F.abs("autocorrelation") < 0.3, F.lit(False)), "few_anomalies": F.col("anomaly_rate") < 0.15,
    })
    healthy = F.col("zero_mean") & F.col("unit_variance") & F.col("white") & F.col("few_anomalies")
    return g.withColumn("status", F.when(F.col("n") < 10, "insufficient_data").when(healthy, "healthy").otherwise("needs_recalibration"))


def auto_calibrated(config: filters.Config, updates: DataFrame, panel: DataFrame, force: bool = False, order: str = "day", updates_order: str = "n", last: int = 500) -> filters.Config | None:
    """A configuration estimated anew from the panel, or None while the last innovations of this configuration are healthy."""
    if not force:
        recent = updates.orderBy(F.desc(updates_order)).limit(last)  # the test is of the last innovations
        one = diagnosis(recent.withColumn("__g", F.lit(0)), ["__g"], updates_order, last=last).select("status").first()
        if one is not None and one["status"] == "healthy":
            return None
    return applied(config, estimated(panel, order).collect())
