"""Estimation on top of snapshots: smoothing, transition matrices, isotonic calibration, bootstrap intervals, small regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import scalars


def kim_smoother(filtered: np.ndarray, tpm: np.ndarray) -> np.ndarray:
    """Smoothed regime probabilities, from the last snapshot backwards."""
    out = filtered.copy()
    for t in range(len(filtered) - 2, -1, -1):
        ahead = np.maximum(filtered[t] @ tpm, 1e-15)
        out[t] = filtered[t] * (tpm @ (out[t + 1] / ahead))
        out[t] /= max(out[t].sum(), 1e-15)
    return out


def em_transitions(filtered: np.ndarray, tpm: np.ndarray, rounds: int = 20, floor: float = 0.005, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """Expectation-maximisation of the transition matrix on filtered probabilities: (matrix, rounds used)."""
    for k in range(rounds):
        smooth = kim_smoother(filtered, tpm)
        ahead = np.maximum(filtered[:-1] @ tpm, 1e-15)
        joint = (filtered[:-1, :, None] * tpm[None] * (smooth[1:] / ahead)[:, None, :]).sum(axis=0)
        new = np.maximum(joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-15), floor)
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - tpm).max() < tolerance:
            return new, k + 1
        tpm = new
    return tpm, rounds


def transitions_by_group(snapshots: DataFrame, keys: list[str], order: str, regimes: list[str]) -> DataFrame:
    """The transition matrix that EM finds on each group's ordered snapshots, a row for each pair of regimes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)[regimes].to_numpy(float)
        p = np.clip(p, 1e-6, None)
        tpm, rounds = em_transitions(p / p.sum(axis=1, keepdims=True), np.array(c.TRANSITIONS))
        head = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([(*head, a, b, tpm[i, j], rounds) for i, a in enumerate(regimes) for j, b in enumerate(regimes)], columns=[*keys, "source", "target", "p", "rounds"])

    schema = ", ".join([f"{k} {snapshots.schema[k].dataType.simpleString()}" for k in keys] + ["source string", "target string", "p double", "rounds int"])
    return snapshots.groupBy(*keys).applyInPandas(run, schema)


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit by pooling neighbours that fall."""
    level: list[list[float]] = []
    for value, weight in zip(y, w):
        level.append([value, weight, 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            b, a = level.pop(), level.pop()
            level.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in level]) if level else np.zeros(0)


def isotonic(df: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Isotonic calibration points of each group: forecasts are averaged in bins in Spark, the few bins are pooled in a group."""
    binned = df.groupBy(*keys, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("outcome").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf.assign(calibrated=pava(pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)))[[*keys, "bin", "n", "p", "calibrated"]]

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["bin long", "n long", "p double", "calibrated double"])
    return binned.groupBy(*keys).applyInPandas(run, schema)


def bootstrap_indices(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Stationary bootstrap: blocks of geometric length, wrapping around."""
    fresh = rng.random(n) < 1 / block
    fresh[0] = True
    starts = rng.integers(n, size=n)
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[at] + np.arange(n) - at) % n


def bootstrap_means(df: DataFrame, keys: list[str], order: str, value: str, replicates: int, seed: int = 7) -> DataFrame:
    """Mean of every replicate of every group; replicate r of a group draws from its own generator.

    The group's series is sent to as many tasks as there are replicate shares, 50 replicates each.
    """
    shares = df.select(*keys, order, value).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 50))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        share, n = int(pdf["share"].iloc[0]), len(x)
        block = max(n ** (1 / 3), 2.0)
        head = [pdf[k].iloc[0] for k in keys]
        rows = [(*head, r, float(x[bootstrap_indices(n, block, np.random.default_rng([seed, r]))].mean())) for r in range(share * 50, min(share * 50 + 50, replicates))]
        return pd.DataFrame(rows, columns=[*keys, "replicate", "mean"])

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["replicate int", "mean double"])
    return shares.groupBy(*keys, "share").applyInPandas(run, schema)


def interval(replicates: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Percentile interval and standard error of replicate statistics."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*keys).agg(F.count(value).alias("n"), F.element_at(q, 1).alias("low"), F.element_at(q, 2).alias("high"), F.stddev_samp(value).alias("se"))


def varimax(loadings: np.ndarray, rounds: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Rotation that makes squared loadings of each component as uneven as it can."""
    n, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).sum(axis=0) / n))
        turn = u @ v
        if s.sum() < before * (1 + tolerance):
            break
        before = s.sum()
    return loadings @ turn


def switching_model(y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """EM of a two-state Gaussian Markov-switching mean: (means rising, deviations, mean chance to stay, smoothed chance of the low state)."""
    mean, sd = np.quantile(y, [0.25, 0.75]), np.full(2, max(y.std(), 1e-6))
    tpm = np.array([[0.9, 0.1], [0.1, 0.9]])
    for _ in range(rounds):
        like = np.exp(-0.5 * ((y[:, None] - mean) / sd) ** 2) / sd + 1e-300
        filtered, p = np.empty_like(like), np.full(2, 0.5)
        for t in range(len(y)):
            p = (p @ tpm if t else p) * like[t]
            p /= p.sum()
            filtered[t] = p
        smooth = kim_smoother(filtered, tpm)
        ahead = np.maximum(filtered[:-1] @ tpm, 1e-15)
        joint = (filtered[:-1, :, None] * tpm[None] * (smooth[1:] / ahead)[:, None, :]).sum(axis=0) + 0.1
        tpm = joint / joint.sum(axis=1, keepdims=True)
        weight = smooth.sum(axis=0) + 1e-9
        mean = (smooth * y[:, None]).sum(axis=0) / weight
        sd = np.sqrt((smooth * (y[:, None] - mean) ** 2).sum(axis=0) / weight) + 1e-6
    order = np.argsort(mean)
    return mean[order], sd[order], float(np.diag(tpm).mean()), smooth[:, order[0]]


def rank_bins(df: DataFrame, keys: list[str], order: list[str], bins: int = 20) -> DataFrame:
    """Adds bin: consecutive ranks of a group in so many parts of equal count. A group is as long as its calendar."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("bin", F.floor(rank * bins / F.count(F.lit(1)).over(w)))


def calibrators(df: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys, bin, n, p, calibrated): isotonic points over bins of equal count of (p, outcome), ties by `day`."""
    binned = rank_bins(df, keys, ["p", "day"], bins).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("outcome").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf.assign(calibrated=pava(pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)))[[*keys, "bin", "n", "p", "calibrated"]]

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["bin long", "n long", "p double", "calibrated double"])
    return binned.groupBy(*keys).applyInPandas(run, schema)


def recalibrated(df: DataFrame, points: DataFrame, key: str = "regime") -> DataFrame:
    """df (day, key, p, ...) with p mapped through its key's points, linear between them, and scaled to one over the keys of a day."""
    knots = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", F.col("p").alias("x"), F.col("calibrated").alias("y")))).alias("__k"))
    x = F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0))
    below, above = F.filter("__k", lambda k: k["x"] <= x), F.filter("__k", lambda k: k["x"] > x)
    a, b = F.element_at(below, -1), F.element_at(above, 1)
    y = F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"]))
    rows = df.join(F.broadcast(knots), key, "left").withColumn("__y", F.when(F.size("__k") > 0, y).otherwise(F.col("p"))).drop("__k")  # a row for each key
    total = F.sum("__y").over(Window.partitionBy("day"))
    return rows.withColumn("calibrated", F.when(total > 1e-12, F.col("__y") / total).otherwise(F.col("p"))).drop("__y")


def metrics(p: np.ndarray, truth: np.ndarray, regimes: list[str], bins: int = 10) -> dict[str, float]:
    """Brier score, reliability and AUC of each regime, and sharpness: ten numbers for three regimes; NaN where undefined."""
    out = {}
    for k, name in enumerate(regimes):
        f, y = p[:, k], (truth == name).astype(float)
        cell = np.minimum((f * bins).astype(int), bins - 1)
        n = np.bincount(cell, minlength=bins)
        used = n > 0
        mean_f, mean_y = (np.bincount(cell, weights=v, minlength=bins)[used] / n[used] for v in (f, y))
        order = np.argsort(f, kind="stable")
        rank = np.empty(len(f))
        rank[order] = np.arange(1, len(f) + 1)
        _, inverse = np.unique(f, return_inverse=True)
        rank = (np.bincount(inverse, weights=rank) / np.bincount(inverse))[inverse]
        ones = y.sum()
        out[f"{name}_brier"] = float(((f - y) ** 2).mean())
        out[f"{name}_reliability"] = float((n[used] * (mean_f - mean_y) ** 2).sum() / len(f))
        out[f"{name}_auc"] = float((rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))) if 0 < ones < len(y) else float("nan")
    out["sharpness"] = float(p.max(axis=1).mean())
    return out


def bootstrap_suite(snapshots: DataFrame, regimes: list[str], order: str = "day", truth: str = "truth", replicates: int = 500, seed: int = 7) -> DataFrame:
    """(metric, replicate, value) of stationary block replicates of one panel; every share of 50 replicates is a task with generators of its own."""
    shares = snapshots.select(order, truth, *regimes).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 50))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, share = pdf.sort_values(order), int(pdf["share"].iloc[0])
        p, y, n = pdf[regimes].to_numpy(float), pdf[truth].to_numpy(), len(pdf)
        rows = []
        for r in range(share * 50, min(share * 50 + 50, replicates)):
            at = np.sort(bootstrap_indices(n, max(n ** (1 / 3), 2.0), np.random.default_rng([seed, r])))
            rows += [(k, r, v) for k, v in metrics(p[at], y[at], regimes).items() if np.isfinite(v)]
        return pd.DataFrame(rows, columns=["metric", "replicate", "value"])

    return shares.groupBy("share").applyInPandas(run, "metric string, replicate int, value double")


def valid_interval(replicates: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """`interval` of the column value; with fewer than `least` replicates both ends and the error are null."""
    rows = interval(replicates, keys, "value")
    return rows.select(*keys, "n", *[F.when(F.col("n") >= least, F.col(x)).alias(x) for x in ("low", "high", "se")])


def var_one(panel: DataFrame, order: str, streams: list[str]) -> DataFrame:
    """VAR(1) with intercept by least squares: (target, source, coefficient, residual_cov): the sums of products are taken in Spark, the small system is solved once.

    The panel has a row for each date; rows with a missing value in it or before it are left out.
    """
    w = Window.orderBy(order)
    lagged = panel.select(*streams, *[F.lag(s).over(w).alias(f"lag_{s}") for s in streams]).dropna()
    terms = [F.lit(1.0), *[F.col(f"lag_{s}") for s in streams], *[F.col(s) for s in streams]]
    cells = [F.sum(a * b).alias(f"c{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    sums, k = lagged.agg(*cells), len(streams)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row, m = pdf.iloc[0], 2 * k + 1
        g = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
        beta = np.linalg.lstsq(g[: k + 1, : k + 1], g[: k + 1, k + 1 :], rcond=None)[0]
        rest = (g[k + 1 :, k + 1 :] - beta.T @ g[: k + 1, k + 1 :]) / g[0, 0]
        return pd.DataFrame([(t, s, float(beta[i + 1, j]), float(rest[j, i])) for j, t in enumerate(streams) for i, s in enumerate(streams)], columns=["target", "source", "coefficient", "residual_cov"])

    return sums.groupBy(F.lit(0).alias("g")).applyInPandas(solve, "target string, source string, coefficient double, residual_cov double")


def granger(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, gain, f) of rows (y, y_before, x_before): the gain in R2 of x_before beside y_before, and its F statistic on 1 and n - 3 degrees; null where the two before move as one or not at all."""
    g = pairs.where("y is not null and y_before is not null and x_before is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), scalars.correlation("y", "y_before").alias("a"), scalars.correlation("y", "x_before").alias("b"), scalars.correlation("y_before", "x_before").alias("c")
    )
    full = F.try_divide(F.col("a") * F.col("a") + F.col("b") * F.col("b") - 2 * F.col("a") * F.col("b") * F.col("c"), 1 - F.col("c") * F.col("c"))
    g = g.withColumn("full", full).withColumn("gain", full - F.col("a") * F.col("a"))
    return g.select(*keys, "n", "gain", F.try_divide(F.col("gain") * (F.col("n") - 3), 1 - F.col("full")).alias("f"))
