"""Sub-regimes from states: discriminant distances, evidence scorecards, ensembles and smoothing over time, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import scalars
from tidemark.operators import ranged
from tidemark.operators.filters import vector

#: Names of the quantities that evidence is written in, by factor.
LEVELS = {"inflation": "inflation_trend", "growth": "growth_trend", "labor": "labor_pressure", "housing": "housing_momentum", "finance": "financial_conditions", "commodity": "commodity_pressure", "sentiment": "consumer_sentiment", "policy": "policy_stance"}
SLOPES = tuple(f"{x}_slope" for x in ("inflation", "growth", "finance", "housing"))
OTHERS = (*SLOPES, "inflation_change", "growth_slope_5", "sentiment_slope_5", "labor_slope_5", "inflation_surprise", "stress", "stocks_20", "stocks_60", "oil_20", "price_spread", "rate_change_10", "yield_curve", "unemployment_change", "claims_change")
DERIVED = {"hot": " + ".join(f"(case when {x} > 0.2 then 1 else 0 end)" for x in ("growth", "labor", "housing")), "finance_lead": "abs(finance) - abs(growth)"}
PARENT = {sub: regime for regime, subs in c.SUB_REGIMES.items() for sub in subs}


def evidence_sql(sub: str) -> str:
    """The score of a sub-regime as an SQL expression over the features."""
    return " + ".join(f"({w}) * greatest({x}, 0.0)" for w, x in c.EVIDENCE[sub])


def evidence(features: DataFrame) -> DataFrame:
    """Adds the score of every sub-regime; features holds the levels, slopes and proxies by name, 0 where unknown."""
    rows = features.withColumns({k: F.expr(v) for k, v in DERIVED.items()})
    return rows.withColumns({sub: F.expr(evidence_sql(sub)) for sub in c.EVIDENCE}).drop(*DERIVED)


def shares(scored: DataFrame, temperature: float = c.SOFTMAX_TEMPERATURE) -> DataFrame:
    """Scores turned into probabilities within each regime."""
    new = {}
    for subs in c.SUB_REGIMES.values():
        new |= dict(zip(subs, scalars.softmax([F.col(x) for x in subs], temperature)))
    return scored.withColumns(new)


def smoothed(df: DataFrame, keys: list[str], order: list[str], regime: str) -> DataFrame:
    """(keys, order, sub-regimes): each row's shares times what the sticky transitions carry over from the row before, scaled to one."""
    subs = tuple(c.SUB_REGIMES[regime])
    rows = ranged.scan(df, keys, order, ranged.Sticky(subs, tuple(map(tuple, c.STICKY_TRANSITIONS[regime]))))
    return rows.select(*keys, *order, *[F.col(f"smoothed_{s}").alias(s) for s in subs])


def targets(regime: str, amplified: float = c.DELTA_AMPLIFICATION) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(target state of each sub-regime, weight of each factor): factors weigh by how far the sub-regimes differ in them, 8 in all."""
    base, deltas = vector(c.REGIME_ADJUSTMENTS[regime]), {k: amplified * vector(v) for k, v in c.SUB_REGIMES[regime].items()}
    apart = np.std(list(deltas.values()), axis=0)
    weight = apart / apart.sum() * len(apart) if apart.sum() > 1e-10 else np.ones(len(apart))
    return {k: base + v for k, v in deltas.items()}, weight


def discriminant(x: Column, regime: str, temperature: float = c.SOFTMAX_TEMPERATURE) -> dict[str, Column]:
    """Probability of each sub-regime from the factor array x: softmax of negative weighted distances to the targets."""
    goals, weight = targets(regime)
    away = [-F.sqrt(sum((float(w) * F.pow(F.get(x, F.lit(i)) - float(t[i]), 2) for i, w in enumerate(weight) if w), F.lit(0.0))) for t in goals.values()]
    return dict(zip(goals, scalars.softmax(away, temperature)))


def ensemble(bank: Column, scored: Column, share: float = c.ENSEMBLE_SHARE) -> Column:
    """The bank's and the scored probability of a sub-regime, before scaling to one."""
    return share * bank + (1 - share) * scored
