"""The operators behind the full definitions, against plain numpy and Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.functions import distributions
from tidemark.operators import asof, filters, joins, lockstep, ranged, resampling, rival, triggers, verification, windows

DAY = dt.date(2024, 1, 1)


def test_as_of_takes_the_last_row_before_across_buckets(spark):
    rng = np.random.default_rng(1)
    right = [(k, int(t), int(s), float(i)) for i, (k, t, s) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 400, 80), rng.permutation(80)))]
    left = [(k, int(t), f"row{i}") for i, (k, t) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(-20, 450, 60)))]
    l_rows = spark.createDataFrame([(int(k), t, n) for k, t, n in left], "k long, at long, name string")
    r_rows = spark.createDataFrame([(int(k), t, s, v) for k, t, s, v in right], "k long, at long, seq long, v double")
    for width in (7, 50, 10_000):
        got = {r.name: (r.at, r.v) for r in asof.as_of(l_rows, r_rows, ["k"], "at", ["seq"], "v", F.floor(F.col("at") / width)).collect()}
        assert len(got) == len(left)
        for k, t, n in left:
            before = [(t2, s, v) for k2, t2, s, v in right if k2 == k and t2 <= t]
            assert got[n] == (t, max(before)[2] if before else None), width


def test_as_of_of_empty_sides(spark):
    l_rows = spark.createDataFrame([(1, 5)], "k long, at long")
    r_rows = spark.createDataFrame([], "k long, at long, seq long, v double")
    bucket = F.floor(F.col("at") / 10)
    assert asof.as_of(l_rows, r_rows, ["k"], "at", ["seq"], "v", bucket).first().v is None
    assert asof.as_of(l_rows.where("false"), r_rows, ["k"], "at", ["seq"], "v", bucket).count() == 0


EVENTS = [resampling.Event("2024-01-10", "2024-02-10", "b"), resampling.Event("2024-03-01", "2024-03-20", "a"), resampling.Event("2030-01-01", "2030-02-01", "a")]


def plain_metrics(days, p, names, of):
    """The ten numbers snapshot by snapshot, with loops."""
    out = {}
    for name in of:
        f = [row[names.index(name)] for row in p]
        y = [int(any(e.regime == name and e.start <= d.isoformat() <= e.end for e in EVENTS)) for d in days]
        if not sum(y):
            continue
        n, base = len(f), sum(y) / len(y)
        points = []
        for t in np.linspace(1.0, 0.0, 200):
            points.append((sum(a >= t and b == 0 for a, b in zip(f, y)) / max(n - sum(y), 1), sum(a >= t and b == 1 for a, b in zip(f, y)) / sum(y)))
        out[f"{name}_auc"] = round(abs(sum((x1 - x0) * (y1 + y0) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:]))), 4)
        out[f"{name}_brier"] = round(sum((a - b) ** 2 for a, b in zip(f, y)) / n, 6)
        rel = res = 0.0
        for k in range(10):
            cell = [(a, b) for a, b in zip(f, y) if min(int(a * 10), 9) == k]
            if cell:
                mf, my = sum(a for a, _ in cell) / len(cell), sum(b for _, b in cell) / len(cell)
                rel, res = rel + len(cell) * (mf - my) ** 2 / n, res + len(cell) * (my - base) ** 2 / n
        out[f"{name}_reliability"], out[f"{name}_resolution"] = round(rel, 6), round(res, 6)
    lags = []
    for e in EVENTS:
        for d, row in zip(days, p):
            if e.start <= d.isoformat() <= e.end and row[names.index(e.regime)] >= 0.5:
                lags.append(round((d - dt.date.fromisoformat(e.start)).days / 7, 1))
                break
    return out | {"detection_count": len(lags)} | ({"mean_detection_lag": sum(lags) / len(lags)} if lags else {})


def test_event_metrics_on_fixed_index_paths():
    rng = np.random.default_rng(2)
    names, n = ["a", "b", "c"], 120
    days, p = [DAY + dt.timedelta(days=i) for i in range(n)], rng.dirichlet([1, 1, 1], n)
    for at in (np.arange(n), rng.integers(0, n, n), np.r_[60:120, 0:60], np.full(n, 100)):
        own = [days[i] for i in at]
        got = resampling.event_metrics(np.array(own, "datetime64[D]"), p[at], names, EVENTS, ["a", "b"])
        want = plain_metrics(own, p[at].tolist(), names, ["a", "b"])
        assert got == {k: pytest.approx(v, abs=2e-4 if k.endswith("auc") else 1.01e-6) for k, v in want.items()}


def test_event_intervals_and_degenerate_ones(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 1, 1], 120)
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(p)], "day date, a double, b double, c double")
    suite = resampling.event_suite(df, ["a", "b", "c"], EVENTS, ["a", "b"], replicates=60)
    rows = {r.metric: r for r in resampling.event_intervals(suite).collect()}
    assert len(rows) == 10
    values = {}
    for r in suite.collect():
        values.setdefault(r.metric, {})[r.replicate] = r.value
    for k, r in rows.items():
        drawn = [v for i, v in values[k].items() if i >= 0]
        assert (r.n, r.point) == (len(drawn), values[k][-1])
        assert (r.low, r.high, r.se) == pytest.approx((*np.percentile(drawn, [2.5, 97.5]), np.std(drawn, ddof=1)))
    few = spark.createDataFrame([("m", -1, 5.0)] + [("m", i, float(i)) for i in range(9)], "metric string, replicate int, value double")
    assert tuple(resampling.event_intervals(few).first()) == ("m", 9, 5.0, 5.0, 5.0, 0.0)


def test_structural_breaks(spark):
    none, near = [0.0] * 8, [0.85] + [0.0] * 7
    branch = lambda *xs: [("b", 0.5, list(x)) for x in xs]
    rows = [
        (1, [0.0] * 8, branch(none, near)), (2, [1.74, -0.91, 0.9] + [0.0] * 5, branch(none, near)), (3, [2.0, 0.5] + [0.0] * 6, branch(none)), (4, [3.0, -2.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0], branch(none)),
    ]
    df = spark.createDataFrame(rows, "entity long, factors array<double>, branches array<struct<name: string, p: double, factors: array<double>>>")
    got = {r.entity: r for r in triggers.structural_breaks(df).collect()}
    assert [[x.name for x in got[i].outside] for i in (1, 2, 3, 4)] == [[], list(c.FACTORS[1:3]), [c.FACTORS[0]], list(c.FACTORS[:5])]
    assert [got[i].broken for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert got[1].detail is None and got[2].detail == f"State outside all branch models on 2 factors: {c.FACTORS[1]}=-0.910, {c.FACTORS[2]}=+0.900"
    assert got[4].detail.count("=") == 4 and "on 5 factors" in got[4].detail


@pytest.fixture(scope="module")
def observed(spark):
    rng = np.random.default_rng(8)
    rows = [(e, DAY + dt.timedelta(days=i), k, s, float(rng.standard_normal())) for e in (1, 2, 3) for i in range(30) for k, s in enumerate(("SP500", "US_CPI_YOY", "INITIAL_CLAIMS")) if (i + k) % 3]
    return spark.createDataFrame(rows, "entity long, day date, ord int, stream_key string, z double")


def engine_of(rows, config):
    engine = filters.Replay(config)
    for _, observed in filters.in_days(rows):
        engine.day(observed)
    return engine


def test_branch_states_and_covariance_health(spark, observed):
    config = filters.Config()
    states = lockstep.branch_states(observed, {"base": config}, every=1_000).groupBy("entity").agg(F.max_by(F.struct("factors", "branches"), "step").alias("s")).collect()
    health = {r.entity: r for r in lockstep.covariance_health(observed, {"base": config}).collect()}
    assert len(states) == len(health) == 3
    for r in states:
        engine = engine_of(observed.where(F.col("entity") == r.entity).toPandas(), config)
        assert np.allclose(r.s.factors, engine.base.x)
        for b, flt, p, branch in zip(r.s.branches, engine.bank.filters, engine.bank.mu, config.branches):
            assert b.name == branch.name and np.allclose(b.factors, flt.x) and b.p == pytest.approx(p)
        value = np.linalg.eigvalsh(engine.base.p)
        assert health[r.entity].condition == pytest.approx(value[-1] / value[0], rel=1e-6)
        assert health[r.entity].effective_rank == (value > 0.001 * value[-1]).sum()
        assert np.allclose(health[r.entity].deviations, np.sqrt(np.diag(engine.base.p)))
    condition, rank = lockstep.health(np.array([np.diag([4.0, 2, 1, 1, 1, 1, 0.003, 0.001]), np.diag([1.0] * 7 + [0])]))
    assert condition.tolist() == pytest.approx([4000, 1e10]) and rank.tolist() == [6, 7]


def test_factor_correlations(spark):
    rng = np.random.default_rng(6)
    gain, z = rng.standard_normal((50, 3)), rng.standard_normal(50)
    gain[:, 2] = 0
    df = spark.createDataFrame([(1, g.tolist(), float(x)) for g, x in zip(gain, z)], "entity long, gain array<double>, z double")
    rows = {(r.first, r.second): r for r in verification.factor_correlations(verification.by_factor(df, "gain", "z", ["a", "b", "c"]), ["entity"], ["a", "b", "c"]).collect()}
    share = gain * z[:, None]
    assert rows["a", "b"].r == pytest.approx(np.corrcoef(share[:, 0], share[:, 1])[0, 1]) and rows["a", "b"].n == 50
    assert rows["a", "c"].r is None and len(rows) == 3


def test_diebold_mariano_over_ranges(spark):
    rng = np.random.default_rng(9)
    a, b = rng.gamma(2, 1, 300), rng.gamma(2, 1.3, 320)
    left = spark.createDataFrame([("k", int(i) * 3, float(x)) for i, x in enumerate(a)], "k string, seq long, a double")
    right = spark.createDataFrame([("k", int(i) * 7 + 1, float(x)) for i, x in enumerate(b)], "k string, seq long, b double")
    both = joins.zipped(left, right, ["k"], "seq", span=50).withColumn("d", F.col("a") - F.col("b"))
    d, n, h = a - b[:300], 300, 4
    assert {r["__pos"]: r.d for r in both.collect()} == {i: pytest.approx(x) for i, x in enumerate(d)}
    v = np.var(d, ddof=1) + 2 * sum(np.mean((d[k:] - d.mean()) * (d[:-k] - d.mean())) for k in range(1, h))
    want = d.mean() / np.sqrt(v / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    r = verification.diebold_mariano_test(both, ["k"], "d", h, span=17).first()
    assert (r.n, r.mean_difference, r.statistic) == (300, pytest.approx(d.mean()), pytest.approx(want))
    assert r.p_value == pytest.approx(math.erfc(abs(want) / math.sqrt(2)), abs=1e-7) and r.verdict == ("first better" if r.p_value < 0.05 else "no significant difference")
    flat = verification.diebold_mariano_test(both.withColumn("d", F.lit(0.5)), ["k"], "d", 1).first()
    assert (flat.statistic, flat.p_value, flat.verdict) == (0.0, pytest.approx(1.0), "no significant difference")


def test_warmed_rows_and_their_fallback(spark):
    rows = [(1, "often", t, 1.0) for t in range(100)] + [(1, "late", t, 2.0) for t in range(8, 90)] + [(1, "rare", t, 3.0) for t in (2, 50)]
    df = spark.createDataFrame(rows, "e long, s string, t long, x double")
    got = {}
    for r in windows.warmed(df, ["e"], ["s"], "t", 10, 5, 50).collect():
        got.setdefault(r.s, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {"often": list(range(10)), "late": list(range(8, 58)), "rare": [2, 50]}


def test_whiteness_detail(spark):
    rng = np.random.default_rng(10)
    x = np.repeat(np.round(rng.standard_normal(60), 1), rng.integers(1, 4, 60))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, float(i)) for i in range(49)], "k long, t long, x double")
    r, = verification.whiteness_detail(df, ["k"], ["t"], "x").collect()
    n, d = len(x), x - x.mean()
    acf = {k: (d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 11)}
    assert (r.n, r.acf_1, r.acf_2, r.acf_5, r.acf_10) == (n, *(pytest.approx(acf[k]) for k in (1, 2, 5, 10)))
    same = np.abs(np.diff(x)) < 1e-10
    runs, k = [], 1
    for s in [*same, False]:
        if s:
            k += 1
        else:
            runs += [k] if k > 1 else []
            k = 1
    assert (r.repeats, r.max_run, r.avg_run, r.n_runs) == (pytest.approx(same.mean()), max(runs), pytest.approx(np.mean(runs)), len(runs))
    q = {k: n * (n + 2) * sum(acf[j] ** 2 / (n - j) for j in range(1, k + 1)) for k in acf}
    assert r.first_pass_lag == next((k for k in q if distributions.chi_squared_tail(q[k], k) > 0.05), None)


def test_several_followers_in_one_pass(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i % 2, i, *map(float, r)) for i, r in enumerate(rng.dirichlet([1, 1], 200))], "g int, t int, a double, b double")
    mild, strong = ranged.Sticky(("a", "b"), ((0.85, 0.15), (0.15, 0.85)), "mild"), ranged.Sticky(("a", "b"), ((0.92, 0.08), (0.08, 0.92)), "strong")
    together = {r.t: r for r in ranged.scan(df, ["g"], ["t"], ranged.Together((mild, strong, ranged.Streak("a", 0.6, 2))), range_rows=20).collect()}
    for fold in (mild, strong, ranged.Streak("a", 0.6, 2)):
        for r in ranged.scan(df, ["g"], ["t"], fold).collect():
            assert [together[r.t][o] for o in fold.outputs] == [pytest.approx(r[o], abs=1e-9) for o in fold.outputs]


def test_regime_loadings_are_used():
    base, own = filters.Replay(filters.Config()), filters.Replay(filters.Config(regime_loadings=True))
    assert np.allclose(own.branch_loadings("US_CPI_YOY")[1][0], 1.3 * base.loadings("US_CPI_YOY")[0])
    assert np.allclose(own.branch_loadings("US_CPI_YOY")[0], base.loadings("US_CPI_YOY"))
    for engine in (base, own):
        engine.day([("US_CPI_YOY", 2.0)])
    assert not np.allclose(base.bank.mu, own.bank.mu)


def test_no_start_beats_the_one_that_is_kept(spark):
    rng = np.random.default_rng(20)
    rows = []
    for k in ("a", "b"):
        state, y = 0, 0.0
        for t in range(150):
            state = state if rng.random() < 0.95 else int(rng.integers(3))
            y = (-2.0, 0.0, 3.0)[state] + 0.2 * y + rng.standard_normal() * (0.3, 1.0, 0.5)[state]
            rows.append((k, t, float(y), float(rng.standard_normal())))
    df = spark.createDataFrame(rows + [("short", 0, 1.0, 1.0)], "k string, t long, y double, x double")
    got = {r.k: r for r in rival.best_of_starts(df, ["k"], "t", "y", ["x"], starts=6).collect()}
    assert got.keys() == {"a", "b"}
    for k, r in got.items():
        y, x = (np.array([row[i] for row in rows if row[0] == k]) for i in (2, 3))
        lls = [rival.switching_regression(y, x[:, None], start=None if s == 0 else rival.random_start(150, 3, np.random.default_rng([11, s]))).ll for s in range(6)]
        assert r.ll == pytest.approx(max(lls)) and r.first_ll == pytest.approx(lls[0]) and r.ll >= r.first_ll and r.n == 150
        assert r.means == sorted(r.means) and 0 < r.stay < 1
