"""Triggers at their default thresholds on the fixture sequences."""

import datetime as dt

import numpy as np
import pytest

from tidemark.functions import constants as c
from tidemark.operators import triggers

START = dt.datetime(2024, 1, 1)


def gain(*values):
    return np.array([*values, *[0.0] * (8 - len(values))])


def fired(updates, hours=1.0):
    watch, out = triggers.Watch(triggers.Rules()), []
    for i, (z, g) in enumerate(updates):
        out += [(i, kind, key) for kind, key, _ in watch.update(START + dt.timedelta(hours=hours * i), "SP500", z, g)]
    return out


def approaching(series):
    watch, out = triggers.Watch(triggers.Rules()), []
    for i, p in enumerate(series):
        out += [(i, kind, key) for kind, key, _ in watch.probabilities(START + dt.timedelta(hours=i), np.asarray(p, float))]
    return out


def test_small_innovations_stay_silent():
    assert fired([(1.5, gain(0.5))] * 10) == []


def test_streak_fires_on_the_informed_factor_and_starts_anew():
    assert fired([(2.5, gain(0.5))] * 6) == [(4, "innovation_streak", c.FACTORS[0])]
    # within six hours of the first firing nothing fires, then the streak, which went on, does
    assert [i for i, _, _ in fired([(2.5, gain(0.5))] * 14)] == [4, 10]


def test_a_small_innovation_breaks_the_streak():
    assert fired([(2.5, gain(0.5))] * 4 + [(0.5, gain(0.5))] + [(2.5, gain(0.5))] * 4) == []


def test_surprise_on_several_factors():
    got = fired([(3.0, gain(0.6, 0.6, 0.6, 0.6))] * 5)
    assert (0, "multi_factor_surprise", "global") in got
    assert [x for x in got if x[1] == "multi_factor_surprise"] == [(0, "multi_factor_surprise", "global")]
    assert fired([(3.0, gain(0.6, 0.6))] * 5, hours=0.1)[:1] == [(4, "innovation_streak", c.FACTORS[0])]


def test_anomalies_keep_their_cooldown():
    assert [i for i, kind, _ in fired([(4.0, gain(0.1))] * 4, hours=0.25) if kind == "anomalous_data"] == [0, 2]


@pytest.mark.parametrize(("falls", "want"), [((0.60, 0.57, 0.55, 0.53, 0.52), [4]), ((0.75,) * 6, []), ((0.80, 0.65), []), ((0.60, 0.57, 0.45, 0.44, 0.43), [])])
def test_boundary(falls, want):
    got = approaching([(p, (1 - p) / 2, (1 - p) / 2) for p in falls])
    assert [i for i, _, _ in got] == (want or []) or (want == [4] and [i for i, _, _ in got] == [3])


def test_change_of_the_leading_regime_resets():
    assert approaching([(0.57, 0.43, 0), (0.55, 0.45, 0), (0.45, 0.55, 0), (0.46, 0.54, 0), (0.47, 0.53, 0)]) == []


def test_defaults_of_runs(spark):
    rows = [(d, "a", 0.01) for d in range(5)] + [(d, "b", 0.5 + 0.01 * d) for d in range(6)] + [(d, "c", 0.01) for d in range(4)]
    df = spark.createDataFrame(rows, "day int, regime string, p double")
    assert [(r.regime, r.n) for r in triggers.extinction(df, ["regime"], ["day"]).collect()] == [("a", 5)]
    assert [(r.regime, r.flag, r.n) for r in triggers.sustained_drift(df, ["regime"], ["day"]).collect()] == [("b", 1, 5)]
    crossed = triggers.tier_crossings(spark.createDataFrame([(1, "a", 0.2), (2, "a", 0.8), (3, "a", 0.3)], "day int, regime string, p double"), ["regime"], ["day"]).collect()
    assert sorted((r.day, r.tier, r.direction) for r in crossed) == [(2, 0.25, "up"), (2, 0.5, "up"), (2, 0.75, "up"), (3, 0.5, "down"), (3, 0.75, "down")]


def test_cooldown_by_kind_and_bounded_history(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, "tier_crossing", "a", at(h)) for h in (0, 0.5, 1)] + [(1, "convergence", "a", at(h)) for h in (0, 11, 12)]
    df = spark.createDataFrame(rows, "entity long, kind string, trigger_key string, at timestamp")
    got = sorted((r.kind, r.at) for r in triggers.cooled_by_kind(df, ["at"]).collect())
    assert got == [("convergence", at(0)), ("convergence", at(12)), ("tier_crossing", at(0)), ("tier_crossing", at(1))]
    done = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "entity long, id int")
    kept = triggers.pending(df, done, kept=2).collect()
    assert sorted(r.id for r in kept if r.resolved) == [2, 3] and sum(not r.resolved for r in kept) == 3


def test_pending_triggers_by_urgency(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    kinds = ["tier_crossing", "structural_break", "unheard_of", "anomalous_data", "structural_break"]
    df = spark.createDataFrame([(1, k, f"{i}", at(i)) for i, k in enumerate(kinds)] + [(2, "tier_crossing", "x", at(0))], "entity long, kind string, trigger_key string, at timestamp")
    rows = triggers.pending(df).where("entity = 1").orderBy("place").collect()
    assert [(r.place, r.kind, r.id) for r in rows] == [(1, "structural_break", 2), (2, "structural_break", 5), (3, "anomalous_data", 4), (4, "tier_crossing", 1), (5, "unheard_of", 3)]
    done = spark.createDataFrame([(1, 2)], "entity long, id int")
    rows = {r.id: r.place for r in triggers.pending(df, done).where("entity = 1").collect()}
    assert rows == {2: None, 5: 1, 4: 2, 1: 3, 3: 4}
