"""The engine's options, saved states and the estimation on top, against plain numpy."""

import datetime as dt

import numpy as np
import pytest

from tidemark.functions import constants as c
from tidemark.functions import distributions
from tidemark.operators import estimation, filters, folds, regimes, verification

SCHEMA = "entity long, day date, ord int, stream_key string, z double"


@pytest.fixture(scope="module")
def observations():
    rng = np.random.default_rng(8)
    return [(e, dt.date(2024, 1, 1) + dt.timedelta(days=i), k, s, float(rng.standard_normal())) for e in (1, 2) for i in range(40) for k, s in enumerate(("SP500", "US_CPI_YOY", "INITIAL_CLAIMS")) if (i + k) % 3 or k == 0]


def test_stopped_and_resumed_equals_one_run(spark, observations):
    df = spark.createDataFrame(observations, SCHEMA)
    variants = filters.configs([{"config_id": "base"}, {"config_id": "full", "gas": True, "gap": True, "cumulate": True, "state_tpm": True, "regime_noise": True}, {"config_id": "duration", "duration_tpm": True}])
    whole = {(r.entity, r.config_id): r.engine for r in filters.checkpoints(df, variants).collect()}
    half = filters.checkpoints(df.where("day < date'2024-01-19'"), variants)
    resumed = {(r.entity, r.config_id): r.engine for r in filters.checkpoints(df.where("day >= date'2024-01-19'"), variants, half).collect()}
    assert resumed == whole and len(whole) == 6


def test_updates_hold_what_the_filter_did(spark, observations):
    u = filters.updates(spark.createDataFrame(observations, SCHEMA), {"base": filters.Config()}).where("entity = 1").orderBy("n").collect()
    assert len(u) == sum(x[0] == 1 for x in observations)
    for r in u:
        h = filters.vector(c.STREAM_LOADINGS[r.stream_key])
        assert r.innovation == pytest.approx(r.observed - r.predicted) and r.predicted == pytest.approx(h @ np.array(r.before))
        assert np.allclose(np.array(r.after) - np.array(r.before), np.array(r.gain) * r.innovation)
        assert sum(r.probabilities) == pytest.approx(1)


def test_branches_from_records():
    spec = [{"branch_id": "a", "state_adjustments": {"inflation_trend": 0.5}, "transition_overrides": [{"factor": "growth_trend", "persistence": 0.5, "drift": 0.1}]}, {"branch_id": "b"}, {"branch_id": "c"}, {"branch_id": "d"}]
    bank = filters.Bank(filters.Config(), filters.branches_of(spec))
    assert np.allclose(bank.mu, 0.25) and np.allclose(np.diag(bank.tpm), 0.98) and np.allclose(bank.tpm.sum(axis=1), 1)
    assert bank.filters[0].f[1, 1] == 0.5 and bank.filters[0].x[0] == 0.5
    bank.config = filters.Config(mixing=False)
    bank.predict()
    assert bank.filters[0].x[1] == pytest.approx(0.1)


def test_durations_raise_exits():
    tpm = np.array(c.TRANSITIONS)
    assert np.allclose(filters.lengthened(tpm, {}), tpm)
    old = filters.lengthened(tpm, {2: 400})
    assert old[2, 0] == pytest.approx(0.15, abs=1e-3) and old[2, 2] == pytest.approx(0.83, abs=1e-3) and np.allclose(old.sum(axis=1), 1)
    late = filters.lengthened(tpm, {0: 180})
    assert late[0, 1] + late[0, 2] == pytest.approx(0.045) and late[0, 1] / late[0, 2] == pytest.approx(2)


def test_pseudo_observations_move_one_factor(spark):
    rows = [(1, dt.date(2024, 1, 1), "breaking", "growth_trend", 1, "major", 1.0, 72.0), (1, dt.date(2024, 1, 1), "breaking", "growth_trend", 1, "major", 1.0, 24.0 * 16)]
    s = filters.pseudo_observations(spark.createDataFrame(rows, "entity long, day date, kind string, factor string, direction int, magnitude string, confidence double, age_hours double"))
    got = s.collect()
    assert len(got) == 1 and got[0].z == pytest.approx(0.8) and got[0].r == pytest.approx(0.6)
    last = filters.replay(s, {"base": filters.Config()}).collect()[-1]
    assert last.factors[1] > 0.1 and last.n_updates == 1


def test_sweep_has_the_scenarios():
    assert len(filters.SWEEP) == 12 and len(filters.configs(filters.SWEEP)) == 12
    stay = filters.Bank(filters.Config(stay_change=-0.02)).tpm
    assert np.allclose(np.diag(stay), np.diag(np.array(c.TRANSITIONS)) - 0.02) and np.allclose(stay.sum(axis=1), 1)


def test_folds_over_several_chunks(spark):
    n = 3 * folds.CHUNK + 7
    got = {r.t: r.z for r in folds.normalised(spark.range(n).selectExpr("1 as k", "id as t", "double(id % 13) as x"), ["k"], ["t"], "x", 0.1, 0.0, 1.0).collect()}
    m, v = 0.0, 1.0
    for t in range(n):
        d = t % 13 - m
        assert got[t] == pytest.approx(d / max(v**0.5, 0.01))
        m, v = m + 0.1 * d, 0.9 * (v + 0.1 * d * d)


def test_empty_bins_count(spark):
    df = spark.createDataFrame([("a", 0.05)] * 30 + [("a", 0.95)] * 10, "k string, p double")
    r = verification.pit_histogram(df, ["k"], df["p"]).first()
    assert (r.n, r.bins) == (40, 2) and r.chi_squared == pytest.approx((26**2 + 6**2 + 8 * 16) / 4)


def test_var_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 2)).cumsum(axis=0) * 0.1
    panel = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "day int, a double, b double")
    got = {(r.target, r.source): r for r in estimation.var_one(panel, "day", ["a", "b"]).collect()}
    z = np.column_stack([np.ones(79), x[:-1]])
    beta, _, _, _ = np.linalg.lstsq(z, x[1:], rcond=None)
    rest = x[1:] - z @ beta
    for j, t in enumerate("ab"):
        for i, s in enumerate("ab"):
            assert got[t, s].coefficient == pytest.approx(beta[i + 1, j], abs=1e-8)
            assert got[t, s].residual_cov == pytest.approx((rest.T @ rest / 79)[j, i], abs=1e-9)


def test_granger_matches_two_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(60)
    y = np.zeros(60)
    for t in range(1, 60):
        y[t] = 0.3 * y[t - 1] + 0.5 * x[t - 1] + rng.standard_normal()
    df = spark.createDataFrame([("p", float(y[t]), float(y[t - 1]), float(x[t - 1])) for t in range(1, 60)], "k string, y double, y_before double, x_before double")
    r = estimation.granger(df, ["k"]).first()

    def r2(*cols):
        z = np.column_stack([np.ones(59), *cols])
        e = y[1:] - z @ np.linalg.lstsq(z, y[1:], rcond=None)[0]
        return 1 - (e @ e) / ((y[1:] - y[1:].mean()) ** 2).sum()

    full, own = r2(y[:-1], x[:-1]), r2(y[:-1])
    assert r.gain == pytest.approx(full - own) and r.f == pytest.approx((full - own) * 56 / (1 - full))
    assert 0 <= float(distributions.f_tail(r.f, 1, 56)) < 0.05


def test_recalibration_interpolates_and_sums_to_one(spark):
    points = spark.createDataFrame([("a", 0, 1, 0.2, 0.1), ("a", 1, 1, 0.6, 0.5)], "regime string, bin long, n long, p double, calibrated double")
    df = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.7), (2, "a", 0.9), (2, "b", 0.5)], "day int, regime string, p double")
    got = {(r.day, r.regime): r.calibrated for r in estimation.recalibrated(df, points).collect()}
    assert got == {(1, "a"): pytest.approx(0.3), (1, "b"): pytest.approx(0.7), (2, "a"): pytest.approx(0.5), (2, "b"): pytest.approx(0.5)}


def test_ten_metrics_and_degenerate_intervals(spark):
    p = np.random.default_rng(5).dirichlet([1, 1, 1], 50)
    truth = np.array(["x", "y"])[np.arange(50) % 2]
    m = estimation.metrics(p, truth, ["x", "y", "z"])
    y = truth == "x"
    assert len(m) == 10 and np.isnan(m["z_auc"])
    assert m["x_auc"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in p[y, 0] for b in p[~y, 0]]))
    few = spark.createDataFrame([("m", i, float(i)) for i in range(9)], "metric string, replicate int, value double")
    assert estimation.valid_interval(few, ["metric"]).first().low is None


def test_evidence_tells_calm_from_overheated(spark):
    base = {k: 0.0 for k in (*regimes.LEVELS, *regimes.OTHERS)}
    rows = [base, base | {"growth": 1.5, "labor": 1.5, "housing": 1.5, "inflation": 1.0, "growth_slope": 1.0}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} double" for k in base))
    calm, hot = regimes.shares(regimes.evidence(df)).collect()
    assert calm.goldilocks > calm.boom and hot.boom > hot.goldilocks
    assert calm.goldilocks + calm.boom + calm.disinflation == pytest.approx(1)


def test_smoothing_carries_the_share_before(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 0.1), (0, 2, 0.5, 0.5)], "g int, day int, cost_push double, demand_pull double")
    got = {r.day: r.cost_push for r in regimes.smoothed(df, ["g"], ["day"], "stagflation").collect()}
    assert got[1] == pytest.approx(0.9) and got[2] == pytest.approx(0.88 * 0.9 + 0.12 * 0.1)
