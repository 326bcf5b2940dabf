"""The rival model: Markov-switching regressions refitted on growing windows, each refit a task, with regime names that stay put between refits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.operators.estimation import kim_smoother

#: Regime names in the order in which events claim states, and from low to high mean of what is explained.
BY_EVENT = ("contraction", "stagflation", "expansion")
BY_MEAN = ("contraction", "expansion", "stagflation")


@dataclass
class Fit:
    """Coefficients and deviations by state, transitions, filtered and smoothed probabilities, log likelihood."""

    beta: np.ndarray
    sd: np.ndarray
    tpm: np.ndarray
    filtered: np.ndarray
    smoothed: np.ndarray
    ll: float


def _filter(like: np.ndarray, tpm: np.ndarray) -> tuple[np.ndarray, float]:
    out, p, ll = np.empty_like(like), np.full(like.shape[1], 1 / like.shape[1]), 0.0
    for t, row in enumerate(like):
        p = (p @ tpm if t else p) * row
        total = p.sum()
        ll += np.log(total)
        p = p / total
        out[t] = p
    return out, float(ll)


def random_start(n: int, states: int, rng: np.random.Generator) -> np.ndarray:
    """(n, states) weights: stretches of geometric length, each mostly of one state."""
    fresh = rng.random(n) < max(4 * states / max(n, 1), 0.05)
    stretch = np.cumsum(fresh)
    return rng.dirichlet(np.full(states, 0.3), int(stretch[-1]) + 1 if n else 0)[stretch] * 0.9 + 0.1 / states


def switching_regression(y: np.ndarray, x: np.ndarray, states: int = 3, rounds: int = 60, tolerance: float = 1e-6, start: np.ndarray | None = None) -> Fit:
    """EM of y = [1, x] beta(state) + sd(state) e; states start from these weights, or from equal parts of y by rank. A state's deviation is at least a hundredth of y's."""
    n, design = len(y), np.column_stack([np.ones(len(y)), x])
    least = max(0.01 * y.std(), 1e-6)
    part = np.argsort(np.argsort(y, kind="stable"), kind="stable") * states // max(n, 1)
    weight = np.full((n, states), 0.2 / states) + 0.8 * (part[:, None] == np.arange(states)) if start is None else start
    tpm = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(tpm, 0.9 if states > 1 else 1.0)
    ridge, before, fit = 1e-6 * np.eye(design.shape[1]), -np.inf, None
    for _ in range(rounds):
        gram = np.einsum("tk,ti,tj->kij", weight, design, design) + ridge
        beta = np.linalg.solve(gram, np.einsum("tk,ti,t->ki", weight, design, y)[..., None])[..., 0]
        gap = y[:, None] - design @ beta.T
        sd = np.maximum(np.sqrt((weight * gap**2).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-9)), least)
        like = np.exp(-0.5 * (gap / sd) ** 2) / (sd * np.sqrt(2 * np.pi)) + 1e-300
        filtered, ll = _filter(like, tpm)
        smoothed = kim_smoother(filtered, tpm)
        fit = Fit(beta, sd, tpm, filtered, smoothed, ll)
        if ll - before < tolerance * max(abs(ll), 1.0):
            break
        ahead = np.maximum(filtered[:-1] @ tpm, 1e-15)
        joint = (filtered[:-1, :, None] * tpm[None] * (smoothed[1:] / ahead)[:, None, :]).sum(axis=0) + 0.1
        tpm, weight, before = joint / joint.sum(axis=1, keepdims=True), smoothed, ll
    return fit


def state_names(smoothed: np.ndarray, days: np.ndarray, y: np.ndarray, events: list[tuple], least_events: int = 2, least_score: float = 0.1) -> list[str]:
    """A name for each of three states: events (first day, last day, name) claim the state that is likeliest in them, the rest go by the mean of y where a state leads.

    With fewer than `least_events` events in the window, all go by the mean.
    """
    states, names = smoothed.shape[1], {}
    masks = [((days >= a) & (days <= b), label) for a, b, label in events]
    masks = [(m, label) for m, label in masks if m.any()]
    if len(masks) >= least_events:
        for label in BY_EVENT:
            score = sum((smoothed[m].mean(axis=0) for m, k in masks if k == label), np.zeros(states))
            score[list(names)] = -1
            if score.max() > least_score:
                names[int(score.argmax())] = label
    lead = smoothed > 0.5
    mean = [float(y[lead[:, k]].mean()) if lead[:, k].sum() > 5 else float(y.mean()) for k in range(states)]
    free = [label for label in BY_MEAN if label not in names.values()]
    rest = sorted((k for k in range(states) if k not in names), key=lambda k: mean[k])
    names.update(zip(rest, free))
    return [names[k] for k in range(states)]


REFIT_COLUMNS = "day date, refit int, n int, contraction double, expansion double, stagflation double, ll double"


def expanding(df: DataFrame, keys: list[str], y: str, x: list[str], events: list[tuple] | None = None, order: str = "day", first: int = 60, every: int = 6) -> DataFrame:
    """(keys, day, refit, n, probabilities by name, ll): at row `first` of each key's series (from 0) and every so many rows after it, a fit on all rows up to there and its last filtered probabilities.

    A row goes to every refit that sees it, so what is shuffled grows with the square of a series' length over `every`; refits are tasks of their own.
    Rows with a null in y or x are left out; a series of `first` rows or fewer gives nothing.
    """
    events = [(np.datetime64(a), np.datetime64(b), label) for a, b, label in events or []]
    rows = df.select(*keys, F.col(order).cast("date").alias("day"), *[F.col(k).cast("double").alias(k) for k in (y, *x)]).dropna(subset=[y, *x])
    w = windows.along(keys, ["day"])
    rows = rows.withColumns({"__t": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    begin, end = F.greatest(F.ceil((F.col("__t") - first) / every), F.lit(0)), F.floor((F.col("__n") - 1 - first) / every)
    rows = rows.where(begin <= end).withColumn("refit", F.explode(F.sequence(begin.cast("int"), end.cast("int")))).drop("__t", "__n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day", kind="stable")
        target = pdf[y].to_numpy(float)
        fit = switching_regression(target, pdf[x].to_numpy(float).reshape(len(pdf), len(x)))
        names = state_names(fit.smoothed, pd.to_datetime(pdf["day"]).to_numpy(), target, events)
        p = dict(zip(names, fit.filtered[-1]))
        head = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([(*head, pdf["day"].iloc[-1], int(pdf["refit"].iloc[0]), len(pdf), p["contraction"], p["expansion"], p["stagflation"], fit.ll)], columns=[*keys, *[k.split()[0] for k in REFIT_COLUMNS.split(", ")]])

    schema = ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], REFIT_COLUMNS])
    return rows.groupBy(*keys, "refit").applyInPandas(run, schema)


def best_of_starts(df: DataFrame, keys: list[str], order: str, y: str, x: list[str], starts: int = 10, states: int = 3, seed: int = 11) -> DataFrame:
    """(keys, start, n, ll, first_ll, means, deviations, stay) of the likeliest of several fits of each series.

    Start 0 is by ranks, the others are random; every start of a series is a task of its own.  Of equally likely fits the
    first start counts; first_ll is the likelihood from ranks.  States go by their mean of y, rising.  Series of under
    three values are left out.
    """
    rows = df.select(*keys, order, y, *x).dropna(subset=[order, y, *x]).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = pdf.sort_values(order), int(pdf["start"].iloc[0])
        columns = [*keys, "start", "n", "ll", "means", "deviations", "stay"]
        if len(pdf) < 3:
            return pd.DataFrame([], columns=columns)
        values = pdf[y].to_numpy(float)
        weights = random_start(len(pdf), states, np.random.default_rng([seed, s])) if s else None
        fit = switching_regression(values, pdf[x].to_numpy(float).reshape(len(pdf), len(x)), states, start=weights)
        mean = (fit.smoothed * values[:, None]).sum(axis=0) / np.maximum(fit.smoothed.sum(axis=0), 1e-9)
        by = np.argsort(mean)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), s, len(pdf), fit.ll, mean[by].tolist(), fit.sd[by].tolist(), float(np.diag(fit.tpm).mean()))], columns=columns)

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    fits = rows.groupBy(*keys, "start").applyInPandas(run, f"{head}, start int, n long, ll double, means array<double>, deviations array<double>, stay double")
    top = F.max_by(F.struct("start", "n", "ll", "means", "deviations", "stay"), F.struct(F.round("ll", 9), -F.col("start")))
    g = fits.groupBy(*keys).agg(top.alias("r"), F.max(F.when(F.col("start") == 0, F.col("ll"))).alias("first_ll"))
    return g.select(*keys, "r.start", "r.n", "r.ll", "first_ll", "r.means", "r.deviations", "r.stay")
