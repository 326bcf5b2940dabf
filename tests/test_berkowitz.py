"""Berkowitz's test over all consecutive forecasts, against a plain loop over each ordered series."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from tidemark.operators import verification
from tidemark.plans import catalog
from tidemark.sources import tables


def brute_force(z):
    mu, now, before = z.mean(), z[1:], z[:-1]
    rho = ((now - mu) * (before - mu)).sum() / ((before - mu) ** 2).sum()
    rest = now - mu - rho * (before - mu)
    sigma = max(math.sqrt((rest**2).mean()), 1e-6)
    return len(now), rho, sigma, max((now**2).sum() - ((rest / sigma) ** 2).sum() - 2 * len(now) * math.log(sigma), 0.0)


def test_query_pairs_consecutive_forecasts(spark, sf_dir):
    series = {}
    for r in tables.forecasts(spark, sf_dir).orderBy("seq").collect():
        series.setdefault((r.scenario, r.model_id), []).append(NormalDist().inv_cdf(min(max(r.p - 0.01, 1e-6), 1 - 1e-6)))
    got = {(r.scenario, r.model_id): r for r in catalog.QUERIES["a11_berkowitz"](spark, sf_dir).collect()}
    assert got.keys() == {k for k, v in series.items() if len(v) > 1}
    for k, r in got.items():
        assert (r.n, r.rho, r.sigma, r.lr) == pytest.approx(brute_force(np.array(series[k])), rel=1e-6, abs=1e-8)


@pytest.mark.parametrize("span", [7, 1 << 16])
def test_serial_correlation_is_seen_across_ranges(spark, span):
    rng = np.random.default_rng(2)
    z = [0.0]
    for e in rng.standard_normal(400):
        z.append(0.8 * z[-1] + float(e))
    rows = [("a", i * (1 if i < 200 else 3), x) for i, x in enumerate(z)] + [("single", 1, 0.5)]
    df = spark.createDataFrame(rows, "k string, at long, z double").repartition(3)
    got = verification.berkowitz(df, ["k"], "at", "z", span).collect()
    assert [r.k for r in got] == ["a"] and got[0].rho > 0.7
    assert (got[0].n, got[0].rho, got[0].sigma, got[0].lr) == pytest.approx(brute_force(np.array(z)), rel=1e-9)
