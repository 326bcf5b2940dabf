"""Estimated parameters, the recalibration gate, the rival's refits and names against plain numpy."""

import datetime as dt
import json

import numpy as np
import pytest

from tidemark.functions import constants as c
from tidemark.operators import calibration, filters, rival
from tidemark.sources import files

NAMES = ["SP500", "US_CPI_YOY", "RETAIL_SALES", "INITIAL_CLAIMS"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    common = rng.standard_normal(60).cumsum()
    return 100 + np.array([w * common + rng.standard_normal(60).cumsum() for w in (2.0, 1.0, -1.5, 0.2)])


@pytest.fixture(scope="module")
def panel(spark, data):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=t), s, float(data[i, t])) for i, s in enumerate(NAMES) for t in range(60)]
    return spark.createDataFrame(rows, "day date, stream_key string, x double")


def moves_of(data):
    return np.diff(data, axis=1) / (np.abs(data[:, :-1]) + 1e-10)


def test_estimated_parameters_match_numpy(panel, data):
    got = calibration.estimated(panel).collect()
    moves = moves_of(data)
    value, vec = np.linalg.eigh(np.corrcoef(moves))
    load = (vec * np.sqrt(value))[:, ::-1]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), range(4)])
    want = {(NAMES[i], c.FACTORS[k]): load[i, k] for i in range(4) for k in range(4) if abs(load[i, k]) > 0.05}
    found = {(r.name, r.other): r.value for r in got if r.kind == "loading"}
    assert found == {k: pytest.approx(v, abs=6e-5) for k, v in want.items()}
    by_stream = {s: sum(v**2 for (x, _), v in found.items() if x == s) for s in NAMES}
    assert {r.name: r.value for r in got if r.kind == "noise"} == {s: pytest.approx(max(0.01, moves[i].var() * max(0, 1 - by_stream[s])), abs=6e-5) for i, s in enumerate(NAMES)}
    stay = {}
    for k, f in enumerate(c.FACTORS):
        tops = [abs(found.get((s, f), 0)) for s in NAMES]
        stay[f] = float(np.clip(np.corrcoef(data[int(np.argmax(tops))][:-1], data[int(np.argmax(tops))][1:])[0, 1], 0.5, 0.99)) if max(tops) else 0.9
    assert {r.name: r.value for r in got if r.kind == "persistence"} == {k: pytest.approx(v, abs=6e-5) for k, v in stay.items()}
    series = np.zeros((len(c.FACTORS), 59))
    for (s, f), v in found.items():
        series[c.FACTORS.index(f)] += v * moves[NAMES.index(s)]
    channels = {}
    for i in range(4):
        for j in range(4):
            peak = max((np.corrcoef(series[i][:-k], series[j][k:])[0, 1] for k in range(1, 7)), key=abs) if i != j else 0
            if abs(peak) > 0.15:
                channels[c.FACTORS[i], c.FACTORS[j]] = pytest.approx(0.1 * peak, abs=6e-5)
    assert {(r.name, r.other): r.value for r in got if r.kind == "channel"} == channels and channels


def test_applied_parameters_replace_the_constants(panel):
    config = calibration.applied(filters.Config(), calibration.estimated(panel).collect())
    f = np.array(config.transition)
    assert np.allclose(filters.Filter.fresh(config).f, f) and np.allclose(filters.Filter.fresh(config).q, filters.process_noise())
    assert config.streams["SP500"] != c.STREAM_LOADINGS["SP500"] and "UNEMPLOYMENT_RATE" in config.streams
    assert filters.Replay(config).base_noise("SP500") == config.noises["SP500"]
    only = calibration.applied(filters.Config(), [{"kind": "channel", "name": c.FACTORS[0], "other": c.FACTORS[1], "value": 0.02}])
    g = np.array(only.transition)
    assert g[1, 0] == 0.02 and np.count_nonzero(g - np.diag(np.diag(g))) == 1


def test_gate_recalibrates_only_when_needed(spark, panel):
    rng = np.random.default_rng(2)
    schema = "n long, z double"
    fine = spark.createDataFrame([(i, float(z)) for i, z in enumerate(rng.standard_normal(400))], schema)
    biased = fine.selectExpr("n", "z + 2 as z")
    assert calibration.auto_calibrated(filters.Config(), fine, panel) is None
    assert calibration.auto_calibrated(filters.Config(), fine, panel, force=True) is not None
    assert calibration.auto_calibrated(filters.Config(), biased, panel).transition is not None
    few = calibration.diagnosis(fine.limit(9).selectExpr("0 as g", "*"), ["g"]).first()
    assert few.status == "insufficient_data"
    flat = calibration.diagnosis(fine.selectExpr("0 as g", "n", "0.5D as z"), ["g"]).first()
    assert flat.status == "needs_recalibration" and flat.white is False


def test_components_leave_residuals_and_scores(panel, data):
    z = (data - data.mean(axis=1, keepdims=True)) / data.std(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    rest = z - u[:, :2] @ u[:, :2].T @ z
    cells = calibration.correlations(panel)
    got = calibration.components(cells, 2, scaled=False)
    assert {r.stream_key: r.residual for r in got.collect()} == {n: pytest.approx(rest[i].var()) for i, n in enumerate(NAMES)}
    assert sorted({r.share for r in got.collect()}, reverse=True) == pytest.approx((s**2 / (s**2).sum())[:2])
    first = [r.score for r in calibration.scores(panel, got).where("component = 1").orderBy("day").collect()]
    assert np.abs(np.corrcoef(first, u[:, 0] @ z)[0, 1]) == pytest.approx(1)
    assert calibration.components(cells.limit(0)).count() == 0 and calibration.estimated(panel.limit(0)).where("kind <> 'persistence'").count() == 0


def test_loading_match_finds_the_alike_component(spark):
    hand = calibration.hand_loadings(spark, {s: {c.FACTORS[0]: float(i), c.FACTORS[1]: float(i == 2)} for i, s in enumerate(NAMES)})
    found = spark.createDataFrame([(s, k, v) for i, s in enumerate(NAMES) for k, v in ((1, 1.0), (2, -2.0 * i), (3, float(i == 2)))], "stream_key string, component int, loading double")
    got = {r.factor: r for r in calibration.loading_match(found, hand).collect()}
    assert {k: (r.component, round(r.r, 6)) for k, r in got.items()} == {c.FACTORS[0]: (2, -1.0), c.FACTORS[1]: (3, 1.0)}
    assert {r.verdict for r in got.values()} == {"GOOD"}


def test_switching_regression_finds_the_states():
    rng = np.random.default_rng(6)
    state = np.repeat([0, 1, 2, 0, 2, 1], 40)
    x = rng.standard_normal((240, 1))
    y = np.array([-4.0, 0.0, 5.0])[state] + np.array([0.5, -0.5, 1.0])[state] * x[:, 0] + 0.3 * rng.standard_normal(240)
    fit = rival.switching_regression(y, x)
    order = np.argsort(fit.beta[:, 0])
    assert np.allclose(fit.beta[order], [[-4, 0.5], [0, -0.5], [5, 1.0]], atol=0.2)
    assert (np.argsort(order)[fit.smoothed.argmax(axis=1)] == state).mean() > 0.98
    assert rival.switching_regression(np.ones(30), np.zeros((30, 1))).filtered.sum() == pytest.approx(30)


def test_names_by_events_then_by_mean():
    days = np.arange(np.datetime64("2001-01-01"), np.datetime64("2001-03-02"))
    smoothed = np.zeros((60, 3))
    smoothed[:20, 2] = smoothed[20:40, 0] = smoothed[40:, 1] = 1
    y = smoothed @ np.array([3.0, 1.0, 2.0])
    events = [(days[0], days[15], "expansion"), (days[22], days[30], "contraction")]
    assert rival.state_names(smoothed, days, y, events) == ["contraction", "stagflation", "expansion"]
    assert rival.state_names(smoothed, days, y, events[:1]) == ["stagflation", "contraction", "expansion"]
    assert rival.state_names(smoothed[:4], days[:4], y[:4], []) == ["contraction", "expansion", "stagflation"]


def test_refits_see_only_the_past(spark):
    rng = np.random.default_rng(9)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=7 * t), float(rng.standard_normal()), float(rng.standard_normal())) for t in range(40)]
    rows += [("b", dt.date(2020, 1, 1) + dt.timedelta(days=t), 1.0, None) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, day date, y double, x double")
    got = {r.refit: r for r in rival.expanding(df, ["k"], "y", ["x"], first=20, every=6).collect()}
    assert {m: r.n for m, r in got.items()} == {0: 21, 1: 27, 2: 33, 3: 39}
    for m, r in got.items():
        assert r.k == "a" and r.day == rows[r.n - 1][1] and r.contraction + r.expansion + r.stagflation == pytest.approx(1)
    y, x = np.array([r[2] for r in rows[:27]]), np.array([[r[3]] for r in rows[:27]])
    assert got[1].ll == pytest.approx(rival.switching_regression(y, x).ll)
    assert rival.expanding(df.limit(0), ["k"], "y", ["x"]).count() == 0


def test_trajectories_from_results(spark, tmp_path):
    log = [{"date": "2024-01-05", "factors": {"growth_trend": 0.5}, "p": 1}, {"date": "2024-01-12", "factors": {"growth_trend": 0.6, "inflation_trend": 1.0}}]
    (tmp_path / "r.json").write_text(json.dumps({"daily_log": log, "other": []}, indent=1))
    rows = files.read_trajectories(spark, str(tmp_path), ["growth_trend", "inflation_trend"]).orderBy("day").collect()
    assert [tuple(r)[1:] for r in rows] == [(0.5, None), (0.6, 1.0)]
