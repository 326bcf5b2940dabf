"""Block bootstrap of what is read off a path of snapshots: scores of regimes, and when events were detected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.estimation import bootstrap_indices

REPLICATES_OF_TASK = 50
#: The path itself, in the place of a replicate.
ORIGINAL = -1


@dataclass(frozen=True)
class Event:
    """A stretch of days, both ends in it, in which a regime is the true one."""

    start: str
    end: str
    regime: str


def detection_lags(day: np.ndarray, p: np.ndarray, names: Sequence[str], events: Sequence[Event], at_least: float = 0.5) -> np.ndarray:
    """Weeks from each event's start to the first snapshot of the path within it whose regime has at least this probability; NaN without one.

    The path may be resampled: `first` is in its order, not in that of time.
    """
    out = np.full(len(events), np.nan)
    for i, e in enumerate(events):
        start, end = np.datetime64(e.start), np.datetime64(e.end)
        hit = np.flatnonzero((day >= start) & (day <= end) & (p[:, names.index(e.regime)] >= at_least))
        if len(hit):
            out[i] = round((day[hit[0]] - start).astype("timedelta64[D]").astype(int) / 7.0, 1)
    return out


def area(f: np.ndarray, y: np.ndarray, thresholds: int = 200) -> float:
    """Area under the curve of the rates at evenly spaced thresholds, by trapezoids, in absolute value and four digits."""
    steps = np.linspace(1.0, 0.0, thresholds)
    ones, zeros = np.sort(f[y == 1]), np.sort(f[y == 0])
    tpr, fpr = (1 - np.searchsorted(v, steps) / len(v) for v in (ones, zeros))
    return round(abs(float(((tpr[1:] + tpr[:-1]) / 2 * np.diff(fpr)).sum())), 4)


def event_metrics(day: np.ndarray, p: np.ndarray, names: Sequence[str], events: Sequence[Event], of: Sequence[str], bins: int = 10) -> dict[str, float]:
    """AUC, Brier score, reliability and resolution of each regime in `of`, how many events were detected, and their mean lag in weeks.

    What can't be computed is left out: scores of a regime that the path never has, the area where it has nothing else,
    the lag where nothing was detected.
    """
    out: dict[str, float] = {}
    for name in of:
        f, y = p[:, names.index(name)], np.zeros(len(day))
        for e in events:
            if e.regime == name:
                y[(day >= np.datetime64(e.start)) & (day <= np.datetime64(e.end))] = 1
        if not y.any():
            continue
        cell = np.minimum((f * bins).astype(int), bins - 1)
        n = np.bincount(cell, minlength=bins)
        used = n > 0
        mean_f, mean_y = (np.bincount(cell, weights=v, minlength=bins)[used] / n[used] for v in (f, y))
        auc = 0.5 if y.all() else area(f, y)
        if auc > 0:
            out[f"{name}_auc"] = auc
        out[f"{name}_brier"] = round(float(((f - y) ** 2).mean()), 6)
        out[f"{name}_reliability"] = round(float((n[used] * (mean_f - mean_y) ** 2).sum() / len(f)), 6)
        out[f"{name}_resolution"] = round(float((n[used] * (mean_y - y.mean()) ** 2).sum() / len(f)), 6)
    lags = detection_lags(day, p, names, events)
    out["detection_count"] = float((~np.isnan(lags)).sum())
    if out["detection_count"]:
        out["mean_detection_lag"] = float(np.nanmean(lags))
    return out


def event_suite(snapshots: DataFrame, names: Sequence[str], events: Sequence[Event], of: Sequence[str], order: str = "day", replicates: int = 500, block: float | None = None, seed: int = 42) -> DataFrame:
    """(metric, replicate, value) of the path of snapshots (replicate ORIGINAL) and of its stationary block replicates.

    A share of replicates is a task with a generator for each; the path, a row for each snapshot, goes to every share.
    """
    names, events, of = list(names), list(events), list(of)
    shares = snapshots.select(order, *names).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATES_OF_TASK))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, share = pdf.sort_values(order), int(pdf["share"].iloc[0])
        day, p, n = pdf[order].to_numpy().astype("datetime64[D]"), pdf[names].to_numpy(float), len(pdf)
        mean_length = block or max(n ** (1 / 3), 2.0)
        rows = [(k, ORIGINAL, v) for k, v in event_metrics(day, p, names, events, of).items()] if share == 0 else []
        for r in range(share * REPLICATES_OF_TASK, min((share + 1) * REPLICATES_OF_TASK, replicates)):
            at = bootstrap_indices(n, mean_length, np.random.default_rng([seed, r]))
            rows += [(k, r, v) for k, v in event_metrics(day[at], p[at], names, events, of).items()]
        return pd.DataFrame(rows, columns=["metric", "replicate", "value"])

    return shares.groupBy("share").applyInPandas(run, "metric string, replicate int, value double")


def event_intervals(suite: DataFrame, least: int = 10, level: float = 0.95) -> DataFrame:
    """(metric, n, point, low, high, se): percentile intervals; with fewer than `least` replicates both ends are the point and the error is 0."""
    tail = (1 - level) / 2
    drawn = F.when(F.col("replicate") != ORIGINAL, F.col("value"))
    q = F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail)))
    g = suite.groupBy("metric").agg(F.max(F.when(F.col("replicate") == ORIGINAL, F.col("value"))).alias("point"), F.count(drawn).alias("n"), q.alias("q"), F.stddev_samp(drawn).alias("se"))
    enough = F.col("n") >= least
    return g.where("point is not null").select(
        "metric", "n", "point", F.when(enough, F.element_at("q", 1)).otherwise(F.col("point")).alias("low"), F.when(enough, F.element_at("q", 2)).otherwise(F.col("point")).alias("high"), F.when(enough, F.col("se")).otherwise(0.0).alias("se")
    )
