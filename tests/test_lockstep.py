"""Many entities in lockstep give the numbers of one engine for each of them."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import constants as c
from tidemark.operators import filters, lockstep

SCHEMA = "entity long, day date, ord int, stream_key string, z double, r double"
STREAMS = ("SP500", "US_CPI_YOY", "INITIAL_CLAIMS", "RETAIL_SALES", "UNEMPLOYMENT_RATE", "nothing_known", "@growth_trend")
VARIANTS = filters.configs(
    [
        {"config_id": "base"}, {"config_id": "gas", "gas": True}, {"config_id": "gap", "gap": True}, {"config_id": "blended", "blended": True}, {"config_id": "cumulate", "cumulate": True},
        {"config_id": "regime_noise", "regime_noise": True, "shared_shocks": True}, {"config_id": "state", "state_tpm": True, "regime_noise": True, "cumulate": True, "gas": True, "gap": True},
        {"config_id": "duration", "duration_tpm": True}, {"config_id": "no_mixing", "mixing": False}, {"config_id": "carry_prior", "carry_prior": True}, {"config_id": "every_day", "every_day": True},
        {"config_id": "loadings", "regime_loadings": True, "regime_noise": True, "branch_noise": True, "likelihood_after": True},
        {"config_id": "two", "branches": (filters.Branch("a", {"growth_trend": 0.5}, 0.7, (("growth_trend", 0.5, 0.1),)), filters.Branch("b"))},
    ]
)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for entity in range(1, 8):
        for i in range(int(rng.integers(1, 70))):
            for k, s in enumerate(STREAMS):
                if rng.random() < 0.35:
                    z = None if rng.random() < 0.1 else float(rng.standard_normal() * 3)
                    out.append((entity, dt.date(2024, 1, 1) + dt.timedelta(days=int(i + entity)), k, s, z, 0.5 if s[0] == "@" else None))
    return out


def compared(got, want, keys, columns):
    got, want = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(got) > 40
    for k, r in got.items():
        for x in columns:
            a, b = np.array(r[x], float), np.array(want[k][x], float)
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9), (k, x, a, b)


def test_snapshots_agree(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    compared(lockstep.replay(df, VARIANTS), filters.replay(df, VARIANTS), ("entity", "config_id", "day"), ("step", "n_updates", "log_likelihood", "anomalies", "factors", "probabilities"))


def test_records_agree(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ("step", "observed", "predicted", "innovation", "s", "z", "gain", "before", "after", "probabilities")
    compared(lockstep.updates(df, VARIANTS), filters.updates(df, VARIANTS), ("entity", "config_id", "n"), columns)


def test_nested_banks_agree(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("stream_key not like '@%'").drop("r")
    compared(lockstep.nested(df), filters.nested(df), ("entity", "regime", "sub_regime"), ("p", "joint", "active", "shadow_inflation"))


def test_slabs_hold_whole_entities(monkeypatch):
    monkeypatch.setattr(lockstep, "SLAB_ROWS", 10)
    entity = np.repeat(np.arange(9), [3, 30, 1, 1, 4, 2, 12, 1, 5])
    batches = [pd.DataFrame({"entity": entity[a : a + 7]}) for a in range(0, len(entity), 7)]
    slabs = list(lockstep._slabs(iter(batches)))
    assert np.array_equal(np.concatenate([s["entity"] for s in slabs]), entity)
    held = [set(s["entity"]) for s in slabs]
    assert len(slabs) > 2 and sum(map(len, held)) == 9


def test_empty_table_and_null_entities(spark):
    df = spark.createDataFrame([(None, dt.date(2024, 1, 1), 0, "SP500", 1.0, None)], SCHEMA)
    assert lockstep.replay(df, {"base": filters.Config()}).count() == 0
    assert lockstep.updates(df.where("false"), {"base": filters.Config()}).count() == 0


def test_one_step_by_hand():
    """Mixing, prediction, update and Bayes of one day on one stream, written out with scalars: only the observed factor's diagonal is followed."""
    config = filters.Config(pull=0.0)
    engine = filters.Replay(config)
    engine.day([("INITIAL_CLAIMS", 1.0)])
    base = filters.Replay(config)
    h, r = base.loadings("INITIAL_CLAIMS"), base.base_noise("INITIAL_CLAIMS")
    tpm, shifts = np.array(c.TRANSITIONS), np.array(base.bank.shifts)
    p0, x0 = c.INITIAL_VARIANCE * np.eye(filters.N), shifts
    f, q = base.base.f, base.base.q
    flow = [sum(tpm[i, j] / 3 for i in range(3)) for j in range(3)]
    share = [[tpm[i, j] / 3 / flow[j] for i in range(3)] for j in range(3)]
    likely, after = [], []
    for j in range(3):
        x = sum(share[j][i] * x0[i] for i in range(3))
        p = sum(share[j][i] * (p0 + np.outer(x0[i] - x, x0[i] - x)) for i in range(3))
        x, p = f @ x, f @ p @ f.T + q
        x = x * (1.0 if shifts[j].any() else c.NEUTRAL_SHRINK)
        s = h @ p @ h + r
        gap = 1.0 - h @ x
        likely.append(np.exp(-gap * gap / (2 * s)) / np.sqrt(2 * np.pi * s))
        after.append(x + p @ h / s * gap)
    power = c.TEMPER_FLOOR + (config.ceiling - c.TEMPER_FLOOR) / c.TEMPER_HORIZON
    mu = np.array(likely) ** power / 3
    assert np.allclose(engine.bank.mu, mu / mu.sum(), atol=1e-12)
    assert np.allclose([k.x for k in engine.bank.filters], after, atol=1e-12)
