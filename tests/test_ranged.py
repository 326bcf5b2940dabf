"""Folds over ranges: a series cut into many gives what one pass over it does, and what plain Python does."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, ranged

N = 700


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for key, n in ((1, N), (2, 40), (None, 60), (3, 1)):
        x = np.abs(rng.standard_normal(n).cumsum()) * np.where(rng.random(n) < 0.1, -1, 1)
        x[rng.random(n) < 0.2] = 2.0
        out += [(key, int(t), None if rng.random() < 0.05 else float(v)) for t, v in enumerate(x)]
    return out


FOLDS = [
    ranged.Normaliser("x", 0.1, 1.0, 2.0), ranged.Normaliser("x", 0.05, -1.0, 0.5, 1e-8, True), ranged.ClippedNoise("x", -0.2, 0.95, 0.1, 5.0, -0.3, 0.4), ranged.Novelty("x", 0.25), ranged.Novelty("x", 0.9),
    ranged.Streak("x", 1.0, 4), ranged.Streak("x", 0.01, 3), ranged.Approach("x", 0.3, 4.0, 2),
]


@pytest.mark.parametrize("fold", FOLDS, ids=str)
def test_ranges_give_what_one_pass_does(spark, rows, fold):
    df = spark.createDataFrame(rows, "k long, t long, x double").repartition(3)
    one = {(r.k, r.t): r for r in ranged.scan(df, ["k"], ["t"], fold).collect()}
    cut = {(r.k, r.t): r for r in ranged.scan(df, ["k"], ["t"], fold, range_rows=30).collect()}
    assert one.keys() == cut.keys() == {(k, t) for k, t, _ in rows}
    for k, r in cut.items():
        for o in fold.outputs:
            assert r[o] == (None if one[k][o] is None else pytest.approx(one[k][o], rel=1e-9, abs=1e-9)), (k, o)
    for key in (1, 2, None, 3):
        own = sorted((t, math.nan if x is None else x) for k, t, x in rows if k == key)
        out, state = fold.replay(fold.start(), [np.array([x for _, x in own])])
        for (t, _), *values in zip(own, *out):
            assert [one[key, t][o] for o in fold.outputs] == [None if v != v else pytest.approx(v) for v in values]
        summed = fold.moved(np.array(fold.summary([np.array([x for _, x in own])])), fold.start())
        assert summed == pytest.approx(state, nan_ok=True, rel=1e-9)
    ends = {r.k: r for r in ranged.last(df, ["k"], ["t"], fold, range_rows=30).collect()}
    assert ends[1].n == N and len(ends) == 4


@pytest.mark.parametrize("wait", [0, 1, 7, 60, 5000])
def test_cooldown_over_ranges(spark, wait):
    rng = np.random.default_rng(wait)
    at = np.sort(rng.integers(0, 2000, 500))
    df = spark.createDataFrame([(1, int(a), i) for i, a in enumerate(at)], "k long, at long, i long").withColumn("at", F.timestamp_seconds("at"))
    want, last = [], None
    for i, a in enumerate(at.tolist()):
        if last is None or a - last >= wait:
            want.append(i)
            last = a
    got = sorted(r.i for r in folds.cooled(df, ["k"], ["at", "i"], wait, range_rows=23).collect())
    assert got == want


def test_sticky_shares_over_ranges(spark):
    rng = np.random.default_rng(3)
    shares = rng.dirichlet([1, 1, 1], 300)
    shares[50] = 0.0
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(shares)], "g int, t int, a double, b double, c double")
    fold = ranged.Sticky(("a", "b", "c"), ((0.8, 0.1, 0.1), (0.05, 0.9, 0.05), (0.1, 0.2, 0.7)))
    got = {r.t: r for r in ranged.scan(df, ["g"], ["t"], fold, range_rows=17).collect()}
    s = None
    for t, row in enumerate(shares):
        weight = row if s is None else (s @ np.array(fold.tpm)) * row
        s = weight / weight.sum() if weight.sum() > 1e-15 else row
        assert [got[t].smoothed_a, got[t].smoothed_b, got[t].smoothed_c] == pytest.approx(s.tolist(), abs=1e-9)


def test_scanned_agrees_and_a_long_series_is_many_tasks(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("one").alias("k"), F.date_add(F.lit("1970-01-01"), F.col("id").cast("int")).alias("day"), (F.hash("id") % 100 / 10.0).alias("x"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("v"))

    def step(s, o):
        d = o["x"] - s["m"]
        return F.struct((s["m"] + 0.1 * d).alias("m"), (0.9 * (s["v"] + 0.1 * d * d)).alias("v"))

    plain = folds.series(df, ["k"], ["day"], "x").select(F.explode(F.arrays_zip("obs", folds.scanned(F.col("obs"), start, step).alias("s"))).alias("r")).select("r.obs.day", F.col("r.s.m").alias("pm"), F.col("r.s.v").alias("pv"))
    got = folds.normalised(df, ["k"], ["day"], "x", 0.1, 0.0, 1.0, range_rows=1000)
    worst = got.join(plain, "day").agg(F.count("m").alias("n"), F.max(F.abs(F.col("m") - F.col("pm"))).alias("m"), F.max(F.abs(F.col("v") - F.col("pv"))).alias("v")).first()
    assert worst.n == n and worst.m < 1e-9 and worst.v < 1e-9
    rows, parts = ranged._cut(df, ["k"], ["day"], ("x",), 1000)
    assert parts == 20 and len({r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}) > 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, t long, x double")
    assert ranged.scan(df, ["k"], ["t"], FOLDS[0]).count() == 0 and ranged.last(df, ["k"], ["t"], FOLDS[2]).count() == 0
