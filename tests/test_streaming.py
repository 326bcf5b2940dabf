"""A stream of days, taken in one file at a time, leaves the state that the batch replay computes."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import filters
from tidemark.streaming import online


@pytest.fixture(scope="module")
def observations():
    rng = np.random.default_rng(5)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    return [(e, day(i), k, s, float(rng.standard_normal())) for e in (1, 2) for i in range(12) for k, s in enumerate(("SP500", "US_CPI_YOY"))]


def test_stream_equals_batch_and_late_rows_go_aside(spark, tmp_path, observations):
    df = spark.createDataFrame(observations, online.INPUT_SCHEMA)
    batch = {(r.entity, r.day): r for r in filters.replay(df, {"base": filters.Config()}, every=1).collect()}
    (tmp_path / "in").mkdir()
    stream = online.online_replay(online.files(spark, str(tmp_path / "in"), online.INPUT_SCHEMA, 1), filters.Config())
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(3):
        part = [x for x in observations if k * 4 <= (x[1] - dt.date(2024, 1, 1)).days < k * 4 + 4]
        part += [(1, dt.date(2024, 1, 1), 0, "SP500", 99.0)] if k == 2 else []
        spark.createDataFrame(part, online.INPUT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    written = spark.read.parquet(out)
    assert [tuple(r) for r in online.late_rows(written).collect()] == [(1, dt.date(2024, 1, 1), 1)]
    got = {(r.entity, r.day): r for r in online.states(written).collect()}
    assert got.keys() == batch.keys()
    for k, r in got.items():
        assert r.n_updates == batch[k].n_updates and np.allclose(r.factors, batch[k].factors) and np.allclose(r.probabilities, batch[k].probabilities)


def streamed(spark, folder, parts, **options):
    """Output of a stream that takes each part as one micro-batch."""
    (folder / "in").mkdir()
    stream = online.online_replay(online.files(spark, str(folder / "in"), online.INPUT_SCHEMA, 1), filters.Config(), **options)
    for part in parts:
        spark.createDataFrame(part, online.INPUT_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        q = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(online.ONLINE_SCHEMA).parquet(str(folder / "out"))


def same_states(out, batch):
    assert online.late_rows(out).count() == 0
    got = {(r.entity, r.day): r for r in online.states(out).collect()}
    assert got.keys() == batch.keys()
    for k, r in got.items():
        assert (r.step, r.n_updates) == (batch[k].step, batch[k].n_updates)
        assert np.allclose(r.factors, batch[k].factors) and np.allclose(r.probabilities, batch[k].probabilities) and np.isclose(r.log_likelihood, batch[k].log_likelihood)


@pytest.fixture(scope="module")
def batch(spark, observations):
    df = spark.createDataFrame(observations, online.INPUT_SCHEMA)
    return {(r.entity, r.day): r for r in filters.replay(df, {"base": filters.Config()}, every=1).collect()}


@pytest.mark.parametrize("cuts", [1, 2, 5, 11])
def test_any_cut_of_the_input_gives_the_batch_states(spark, tmp_path, observations, batch, cuts):
    """Rows by day and stream, cut anywhere: days and entities are split over micro-batches."""
    rows = sorted(observations, key=lambda x: (x[1], x[2], x[0]))
    edges = [len(rows) * k // cuts + (k % 2 if 0 < k < cuts else 0) for k in range(cuts + 1)]
    same_states(streamed(spark, tmp_path, [rows[a:b] for a, b in zip(edges, edges[1:])]), batch)


def test_rows_out_of_order_within_the_lateness(spark, tmp_path, observations, batch):
    rows = [observations[i] for i in np.random.default_rng(2).permutation(len(observations))]
    same_states(streamed(spark, tmp_path, [rows[k::3] for k in range(3)], lateness=20), batch)


def test_timers_close_days_and_tell_of_silent_streams(spark, tmp_path):
    """Entity 1 and one stream of entity 2 stop on the third day; only entity 2's other stream goes on."""
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    early = [(e, day(i), 0, s, 0.5) for e in (1, 2) for i in range(3) for s in ("SP500", "US_CPI_YOY")]
    parts = [early] + [[(2, day(i), 0, "SP500", 0.1)] for i in (5, 8, 9, 20)] + [[(1, day(2), 0, "SP500", 9.0), (2, day(40), 0, "SP500", 0.1)]]
    out = streamed(spark, tmp_path, parts, silent_after=6)
    told = sorted((r.entity, r.day, r.stream_key) for r in online.silent_streams(out).collect())
    assert told == [(1, day(2), "SP500"), (1, day(2), "US_CPI_YOY"), (2, day(2), "US_CPI_YOY")]
    assert [tuple(r) for r in online.late_rows(out).collect()] == [(1, day(2), 1)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), "SP500", float(h)) for h in range(12)]
    spark.createDataFrame(rows, "ts timestamp, stream_key string, raw double").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(dt.datetime(2024, 1, 2), "SP500", 0.0)], "ts timestamp, stream_key string, raw double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = online.windowed(online.files(spark, str(tmp_path / "in"), "ts timestamp, stream_key string, raw double", 1), "1 hour", "6 hours")
    got = sorted((r.w.start.hour, r.n, r["mean"]) for r in online.run_to_end(spark, stream, "windows").collect())
    assert got == [(0, 6, 2.5), (6, 6, 8.5)]
