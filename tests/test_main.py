"""The commands: what they print and write, against the engine itself."""

import datetime as dt

import numpy as np
import pytest

from tidemark import __main__ as cli
from tidemark.functions import constants as c
from tidemark.operators import filters

SCHEMA = "entity long, day date, ord int, stream_key string, z double"


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    """Observations in two parts, and engines reset, then updated with each."""
    folder = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(1)
    rows = [(e, dt.date(2024, 1, 1) + dt.timedelta(days=i), k, s, float(rng.standard_normal())) for e in (1, 2) for i in range(20) for k, s in enumerate(("SP500", "US_CPI_YOY"))]
    for name, part in (("first", rows[:20] + rows[40:60]), ("second", rows[20:40] + rows[60:])):
        spark.createDataFrame(part, SCHEMA).write.parquet(str(folder / name))
    assert cli.main(["reset", str(folder / "s0"), str(folder / "first")]) == 0
    assert cli.main(["update", str(folder / "s0"), str(folder / "first"), str(folder / "s1")]) == 0
    assert cli.main(["update", str(folder / "s1"), str(folder / "second"), str(folder / "s2")]) == 0
    engines = {}
    for e in (1, 2):
        engines[e] = filters.Replay(filters.Config())
        for i in range(20):
            engines[e].day([(r[3], r[4]) for r in rows if r[0] == e and r[1] == dt.date(2024, 1, 1) + dt.timedelta(days=i)])
    return folder, engines


def test_updates_in_parts_end_where_one_run_does(spark, paths):
    folder, engines = paths
    for r in cli.state(cli.opened(spark, str(folder / "s2"))).collect():
        engine = engines[r.entity]
        assert (r.step, r.n, r.config_id) == (20, 40, "base")
        assert np.allclose([r[k] for k in c.FACTORS], engine.base.x, atol=1e-4)
        assert np.allclose([r[f"sd_{k}"] for k in c.FACTORS], np.sqrt(np.diag(engine.base.p)), atol=1e-4)
    fresh = cli.state(cli.opened(spark, str(folder / "s0"))).first()
    assert fresh.n == 0 and all(fresh[k] == 0 for k in c.FACTORS)


def test_prediction_and_regimes(spark, paths):
    folder, engines = paths
    rows = cli.opened(spark, str(folder / "s2"))
    for r in cli.predicted(rows).collect():
        assert np.allclose([r[k] for k in c.FACTORS], filters.transition() @ engines[r.entity].base.x, atol=1e-6)
    for r in cli.regime(rows).collect():
        assert np.allclose([r[k] for k in c.REGIMES], engines[r.entity].bank.mu, atol=1e-4)


def test_factor_detail(spark, paths):
    folder, engines = paths
    for name in ("inflation_trend", "financial_conditions"):
        i = c.FACTORS.index(name)
        for r in cli.factor(cli.opened(spark, str(folder / "s2")), name).collect():
            base = engines[r.entity].base
            sd = np.sqrt(np.diag(base.p))
            assert (r.value, r.sd, r.monthly) == pytest.approx((base.x[i], sd[i], c.PERSISTENCE[name] ** 22), abs=1e-4)
            rho = {k: base.p[i, j] / (sd[i] * sd[j]) for j, k in enumerate(c.FACTORS) if j != i}
            assert {o.factor: o.rho for o in r.moves_with} == {k: pytest.approx(v, abs=1e-4) for k, v in rho.items() if round(abs(v), 4) > 0.1}
            assert set(r.streams) == {k for k, v in c.STREAM_LOADINGS.items() if name in v}


def test_history_keeps_the_last(spark, paths):
    rows = spark.createDataFrame([(e, "base", s) for e in (1, 2) for s in range(9)], "entity long, config_id string, step int")
    assert sorted((r.entity, r.step) for r in cli.history(rows, 3).collect()) == [(e, s) for e in (1, 2) for s in (6, 7, 8)]


def test_commands_print(spark, paths, capsys, sf_dir):
    folder, _ = paths
    shown = {}
    for args in (["queries"], ["sql", "a6_murphy"], ["sql", "r32_replay"], ["streams"], ["run", "a12_sharpness", sf_dir, "3"], ["state", str(folder / "s2")], ["predict", str(folder / "s2")], ["regime", str(folder / "s2")], ["factor", "growth_trend", str(folder / "s2")]):
        assert cli.main(args) == 0
        shown[args[0] + args[1] if args[0] == "sql" else args[0]] = capsys.readouterr().out
    assert "r32_replay" in shown["queries"].split() and "SELECT" in shown["sqla6_murphy"] and shown["sqlr32_replay"] == "no SQL\n"
    assert shown["streams"].count("\n") == len(c.STREAM_LOADINGS) and "mean_max" in shown["run"] and "soft_landing" in shown["regime"] and "moves_with" in shown["factor"]
    assert cli.main(["no such command"]) == 2 and "python -m tidemark" in capsys.readouterr().out
