"""The filters against their closed forms and invariants."""

import numpy as np
import pytest

from tidemark.functions import constants as c
from tidemark.operators import estimation, filters


def test_scalar_update_matches_the_textbook_form():
    f = filters.Filter.fresh(filters.Config())
    h, r = filters.vector(c.STREAM_LOADINGS["US_CPI_YOY"]), 0.1
    p, x = f.p.copy(), f.x.copy()
    gap, s, k = f.update(h, r, 2.0)
    assert s == pytest.approx(h @ p @ h + r)
    assert np.allclose(f.x, x + p @ h / s * gap)
    assert np.allclose(f.p, p - np.outer(k, h @ p))
    assert np.allclose(f.p, f.p.T)


def test_repeated_updates_shrink_uncertainty():
    f = filters.Filter.fresh(filters.Config())
    h = filters.vector(c.STREAM_LOADINGS["US_CPI_YOY"])
    before = f.p[0, 0]
    assert f.p[0, 0] == pytest.approx(0.1)
    for _ in range(60):
        f.update(h, 0.1, 3.0)
    assert f.p[0, 0] < before
    assert h @ f.x == pytest.approx(3.0, abs=0.1)


def test_unknown_streams_and_missing_values_are_dropped():
    engine = filters.Replay(filters.Config())
    engine.day([("NO_SUCH", 1.0), ("SP500", float("nan"))])
    assert (engine.step, engine.n) == (0, 0)
    engine.day([("SP500", 1.0), ("NO_SUCH", 1.0)])
    assert (engine.step, engine.n) == (1, 1)


def test_high_inflation_favours_stagflation():
    engine = filters.Replay(filters.Config())
    for i in range(30):
        engine.day([("US_CPI_YOY", 3.0 + 0.01 * i)])
    assert engine.bank.mu.sum() == pytest.approx(1)
    assert c.REGIMES[int(engine.bank.mu.argmax())] == "stagflation"
    assert engine.bank.mu.min() >= c.PROBABILITY_FLOOR / 2


def test_probabilities_stay_within_bounds():
    engine = filters.Replay(filters.Config(gas=True, gap=True))
    rng = np.random.default_rng(1)
    for _ in range(60):
        engine.day([(k, float(v)) for k, v in zip(c.STREAM_LOADINGS, 2 * rng.standard_normal(18))])
    assert np.all(engine.bank.mu > 0) and np.isfinite(engine.ll)
    assert all(c.GAS_LOW <= v <= c.GAS_HIGH for v in engine.log_r.values())


def test_smoother_keeps_the_last_row_and_sums_to_one():
    p = np.random.default_rng(2).dirichlet([1, 1, 1], 40)
    s = estimation.kim_smoother(p, np.array(c.TRANSITIONS))
    assert np.allclose(s[-1], p[-1]) and np.allclose(s.sum(axis=1), 1)


def test_em_rows_sum_to_one_and_respect_the_floor():
    p = np.random.default_rng(3).dirichlet([1, 1, 1], 200)
    tpm, _ = estimation.em_transitions(p, np.array(c.TRANSITIONS))
    assert np.allclose(tpm.sum(axis=1), 1) and tpm.min() > 0.004


def test_isotonic_fit_rises_and_keeps_the_mean():
    y, w = np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 2, 2, 1, 1])
    fit = estimation.pava(y, w)
    assert np.all(np.diff(fit) >= 0) and (fit * w).sum() == pytest.approx((y * w).sum())


def test_bootstrap_indices_are_blocks_that_wrap():
    at = estimation.bootstrap_indices(500, 8, np.random.default_rng(4))
    follow = np.mean((at[1:] - at[:-1]) % 500 == 1)
    assert at.min() >= 0 and at.max() < 500 and 0.8 < follow < 0.95


def test_state_transitions_follow_the_factors():
    calm, crisis = filters.state_transitions(np.zeros(filters.N)), filters.state_transitions(filters.vector({"financial_conditions": -3, "growth_trend": -3}))
    assert np.allclose(calm.sum(axis=1), 1) and crisis[0, 2] > calm[0, 2]


def test_shared_shocks_keep_the_noise_positive():
    q = filters.process_noise(shared=True)
    assert np.allclose(q, q.T) and np.linalg.eigvalsh(q).min() > 0


def test_cumulated_prediction_is_the_mean_since_the_last_observation():
    engine = filters.Replay(filters.Config(cumulate=True))
    engine.day([("SP500", 2.0), ("US_CPI_YOY", 1.0)])
    assert engine.sums["US_CPI_YOY"] == [0.0, 0]
    h, seen = filters.vector(c.STREAM_LOADINGS["US_CPI_YOY"]), []
    for _ in range(3):
        x = engine.base.f @ engine.base.x
        seen.append(float(h @ x))
        engine.day([("SP500", 0.5)])
    total, n = engine.sums["US_CPI_YOY"]
    assert n == 3 and total == pytest.approx(sum(seen))


def test_nested_probabilities_sum_to_one(spark):
    import datetime as dt

    rows = [(1, dt.date(2024, 1, d), k, s, 0.1 * d) for d in range(1, 20) for k, s in enumerate(("US_CPI_YOY", "SP500"))]
    got = filters.nested(spark.createDataFrame(rows, "entity long, day date, ord int, stream_key string, z double")).collect()
    for regime in c.REGIMES:
        assert sum(r.p for r in got if r.regime == regime) == pytest.approx(1)
    assert sum(r.joint for r in got) == pytest.approx(1, abs=1e-3)
