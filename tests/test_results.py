"""Results of queries that SQL can't express, on the smallest tables, against numpy on the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import distributions
from tidemark.operators import filters, lockstep
from tidemark.plans import catalog, engine, events, state
from tidemark.sources import tables

Q = catalog.QUERIES


@pytest.fixture(scope="module")
def updates(spark, sf_dir):
    return engine._updates(spark, sf_dir).toPandas()


@pytest.fixture(scope="module")
def daily(spark, sf_dir):
    return tables.daily(spark, sf_dir).toPandas().pivot(index="day", columns="stream_key", values="x").astype(float)


def test_a24_innovation_bias(spark, sf_dir, updates):
    rows = {r.stream_key: r for r in Q["a24_innovation_bias"](spark, sf_dir).collect()}
    assert rows.keys() == set(updates["stream_key"])
    for key, u in updates.groupby("stream_key"):
        z, s, r = u["z"].to_numpy(), u["s"].to_numpy(), rows[key]
        d = (z - z.mean()) / z.std()
        skew, kurt = (d**3).mean(), (d**4).mean() - 3
        jb = len(z) / 6 * (skew**2 + kurt**2 / 4)
        assert (r.n, r.mean, r.sd, r.skew, r.kurtosis) == (len(z), *(pytest.approx(v, rel=1e-6, abs=1e-9) for v in (z.mean(), z.std(), skew, kurt)))
        assert r.mean_ll == pytest.approx((-0.5 * (np.log(2 * np.pi * s) + z * z)).mean()) and r.jarque_bera == pytest.approx(jb, rel=1e-6) and r.p_value == pytest.approx(math.exp(-jb / 2), abs=1e-9)
        assert r.unbiased == (abs(z.mean()) < 0.2)


def box(z, lags):
    d, n = z - z.mean(), len(z)
    return n * (n + 2) * sum(((d[k:] * d[:-k]).sum() / (d * d).sum()) ** 2 / (n - k) for k in range(1, lags + 1))


def test_a28_segmented_whiteness(spark, sf_dir, updates):
    u = updates.assign(regime=[c.REGIMES[int(np.argmax(p))] for p in updates["probabilities"]]).sort_values(["entity", "n"])
    want = {k: box(g["z"].to_numpy(), 10) for k, g in u.groupby(["entity", "regime"]) if len(g) > 20}
    rows = {(r.entity, r.regime): r for r in Q["a28_segmented_whiteness"](spark, sf_dir).collect()}
    assert rows.keys() == want.keys()
    for k, q in want.items():
        assert rows[k].q == pytest.approx(q, rel=1e-6) and rows[k].p_value == pytest.approx(float(distributions.chi_squared_tail(q, 10)), abs=1e-9)


def test_a25_p_values(spark, sf_dir):
    z = events._innovations(spark, sf_dir).toPandas().sort_values(["ts", "seq"])
    want = {k: box(g["z"].to_numpy(), 5) for k, g in z.groupby("entity") if len(g) > 20}
    rows = {r.entity: r for r in Q["a25_whiteness_p_values"](spark, sf_dir).collect()}
    assert rows.keys() == want.keys()
    for k, q in want.items():
        p = float(distributions.chi_squared_tail(q, 5))
        assert rows[k].q == pytest.approx(q, rel=1e-6) and rows[k].p_value == pytest.approx(p, abs=1e-9) and rows[k].white == (p > 0.05)


def test_a35_of_daily_correlations(spark, sf_dir, daily):
    value = np.maximum(np.linalg.eigvalsh(daily.corr().fillna(0.0).to_numpy()), 1e-12)
    share = value / value.sum()
    r = Q["a35_covariance_health"](spark, sf_dir).first()
    assert (r.condition, r.effective_rank) == pytest.approx((value.max() / value.min(), np.exp(-(share * np.log(share)).sum())), rel=1e-6)


def test_a14_suite(spark, sf_dir):
    rows = {(r.regime, r.metric): r.value for r in Q["a14_diagnostic_suite"](spark, sf_dir).collect()}
    s = tables.snapshots(spark, sf_dir).toPandas()
    truth = np.full(len(s), "expansion", object)
    day = s["day"].to_numpy().astype("datetime64[D]")
    for a, b, label in tables.WINDOWS:
        truth[(day >= np.datetime64(a)) & (day <= np.datetime64(b))] = label
    for name in ("expansion", "stagflation", "contraction"):
        f, y = s[name].to_numpy(float), (truth == name).astype(float)
        cell = np.minimum((f * 10).astype(int), 9)
        parts = [(len(f[cell == k]), f[cell == k].mean(), y[cell == k].mean()) for k in set(cell)]
        assert rows[name, "brier"] == pytest.approx(((f - y) ** 2).mean())
        assert rows[name, "reliability"] == pytest.approx(sum(n * (a - b) ** 2 for n, a, b in parts) / len(f))
        assert rows[name, "resolution"] == pytest.approx(sum(n * (b - y.mean()) ** 2 for n, a, b in parts) / len(f))
        assert rows[name, "uncertainty"] == pytest.approx(y.mean() * (1 - y.mean()))
        pairs = [(a > b) + 0.5 * (a == b) for a in f[y == 1] for b in f[y == 0]]
        assert rows[name, "auc"] == pytest.approx(np.mean(pairs), abs=0.01)
    top = s[["expansion", "stagflation", "contraction"]].max(axis=1)
    assert rows["all", "sharpness"] == pytest.approx(top.mean()) and rows["all", "sharpness_sd"] == pytest.approx(top.std(ddof=0))


def test_m5_monthly_components(spark, sf_dir):
    monthly = tables.monthly_sales(spark, sf_dir).toPandas().pivot(index="month", columns="series", values="x").astype(float)
    value, vector = np.linalg.eigh(monthly.corr().to_numpy())
    order = np.argsort(-value)
    rows = Q["m5_monthly_components"](spark, sf_dir).collect()
    assert rows and all(abs(r.loading) > 0.2 for r in rows)
    first = [r for r in rows if r.component == min(x.component for x in rows)]
    assert first[0].share == pytest.approx(value[order[0]] / value.sum(), abs=2e-2)
    for r in first:
        assert abs(r.loading) == pytest.approx(abs(vector[list(monthly.columns).index(r.stream_key), order[0]]), abs=5e-2)


def test_r17_r18_shares_of_sub_regimes(spark, sf_dir):
    nested = Q["r17_r19_nested_regimes"](spark, sf_dir).toPandas()
    obs = state._daily_z(spark, sf_dir).toPandas()
    entity = int(nested["entity"].iloc[0])
    config = filters.Config()
    one, banks = filters.Replay(config), {}
    for r, subs in c.SUB_REGIMES.items():
        both = {k: {f: c.REGIME_ADJUSTMENTS[r].get(f, 0.0) + d.get(f, 0.0) for f in c.FACTORS} for k, d in subs.items()}
        banks[r] = filters.Bank(config, [filters.Branch(k, v) for k, v in both.items()], c.SUB_TRANSITIONS[r], c.SUB_FLOOR)
    for _, observed in filters.in_days(obs[obs["entity"] == entity]):
        one.day(observed)
        for bank in banks.values():
            bank.predict()
            for key, z in observed:
                if key in config.streams and z == z:
                    bank.update(one.loadings(key), one.base_noise(key), z)
    own = nested[nested["entity"] == entity]
    for k, r in enumerate(c.REGIMES):
        rows = own[own["regime"] == r].set_index("sub_regime")
        assert np.allclose([rows.loc[s, "p"] for s in c.SUB_REGIMES[r]], banks[r].mu)
        assert np.allclose(rows["joint"], (rows["p"] * one.bank.mu[k]).round(4), atol=1e-4)
        assert (rows["active"] == (one.bank.mu[k] >= c.ACTIVE_AT)).all()
    blended = Q["r18_ensemble"](spark, sf_dir).groupBy("entity", "regime").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(blended) == 3 * nested["entity"].nunique() and all(r.p == pytest.approx(1, abs=1e-3) and r.n == len(c.SUB_REGIMES[r.regime]) for r in blended)


def test_r43_ranks_what_the_plain_engine_says(spark, sf_dir):
    rows = Q["r43_sweep"](spark, sf_dir).where("entity % 7 = 0").toPandas()
    obs = state._daily_z(spark, sf_dir).where("entity % 7 = 0")
    variants = {k: v for k, v in filters.configs([{"config_id": "base"}, {"config_id": "full", "regime_noise": True, "state_tpm": True, "cumulate": True, "gas": True, "shared_shocks": True}, *filters.SWEEP]).items()}
    plain = filters.replay(obs, variants, every=1_000_000).toPandas().sort_values("step").drop_duplicates(["entity", "config_id"], keep="last").set_index(["entity", "config_id"]).sort_index()
    assert rows["config_id"].nunique() == 28
    for r in rows[rows["config_id"].isin(variants)].itertuples():
        assert r.ll == pytest.approx(plain.loc[(r.entity, r.config_id), "log_likelihood"], abs=1e-4)
    for _, g in rows.groupby("entity"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 29)) and (np.diff(g["ll"]) <= 1e-4).all()


def test_m9_correlations_with_references(spark, sf_dir, daily):
    rows = Q["m9_reference_correlation"](spark, sf_dir).collect()
    assert len(rows) == daily.shape[1] * (daily.shape[1] - 1)
    both = daily.corr(min_periods=2)
    for r in rows:
        assert r.n == daily[[r.factor, r.reference]].dropna().shape[0] and r.r == pytest.approx(both.loc[r.factor, r.reference], abs=1e-9)
        if r.r is not None and r.n > 2:
            t = r.r * math.sqrt((r.n - 2) / max(1 - r.r**2, 1e-300))
            assert -1 <= r.r <= 1 and r.p_value == pytest.approx(float(distributions.f_tail(t * t, 1, r.n - 2)), abs=1e-6)


def test_lockstep_is_what_r32_runs(spark, sf_dir):
    obs = state._daily_z(spark, sf_dir)
    got = {(r.entity, r.day): r for r in Q["r32_replay"](spark, sf_dir).collect()}
    want = {(r.entity, r.day): r for r in filters.replay(obs, {"base": filters.Config()}).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert np.allclose(r.factors, want[k].factors, atol=1e-9) and np.allclose(r.probabilities, want[k].probabilities, atol=1e-9) and r.log_likelihood == pytest.approx(want[k].log_likelihood)


def test_states_of_streams_are_those_of_the_batch(spark, sf_dir):
    got = {(r.entity, r.day): r for r in Q["s4_online_replay"](spark, sf_dir).collect()}
    want = {(r.entity, r.day): r for r in lockstep.replay(state._daily_z(spark, sf_dir), {"base": filters.Config()}, every=1).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(r.factors, want[k].factors) and r.n_updates == want[k].n_updates for k, r in got.items())


def test_a40_success_of_every_entity(spark, sf_dir, updates):
    rows = {r.entity: r for r in Q["a40_engine_success"](spark, sf_dir).collect()}
    want = {e: u.sort_values("n") for e, u in updates[updates["n"] > 10].groupby("entity")}
    assert rows.keys() == want.keys()
    for e, u in want.items():
        r, rate = rows[e], (u["z"].abs() > c.ANOMALY_THRESHOLD).mean()
        change = np.array(u["probabilities"].iloc[-1]) - np.array(u["probabilities"].iloc[0])
        assert (r.n, r.anomaly_rate, r.success) == (len(u), pytest.approx(rate), rate < 0.2) and np.allclose([r[f"change_{k}"] for k in c.REGIMES], change)
