import datetime as dt
import json

from tidemark.operators import filters
from tidemark.sources import files
from tidemark.streaming import online


def test_csv_panel_round_trip(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,FRED_CPI,YAHOO_OIL_X\n2024-01-01,1.5,\n2024-01-02,,2.5\n2024-01-03,NaN,3.5\n")
    long = files.read_panel(spark, str(tmp_path / "p.csv"), ["FRED_CPI", "YAHOO_OIL_X"])
    rows = sorted((r.day.day, r.stream_key, r.raw) for r in long.collect())
    assert rows == [(1, "CPI", 1.5), (2, "OIL_X", 2.5), (3, "OIL_X", 3.5)]
    files.write_panel(long.withColumn("stream_key", long.stream_key), str(tmp_path / "w"), ["CPI", "OIL_X"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 3


def test_innovation_logs_under_either_name(spark, tmp_path):
    record = {"stream_key": "A", "observed": 1.0, "predicted": 0.5, "innovation": 0.5, "innovation_zscore": 2.0}
    (tmp_path / "a.json").write_text(json.dumps({"innovation_history": [record]}))
    (tmp_path / "b.json").write_text(json.dumps({"updates": [record, record]}))
    assert files.read_innovations(spark, str(tmp_path / "*.json")).count() == 3


def test_latest_states(spark, tmp_path):
    rows = [(1, dt.date(2024, 1, d), 0, "SP500", float(d)) for d in range(1, 6)]
    states = filters.replay(spark.createDataFrame(rows, online.INPUT_SCHEMA), {"base": filters.Config()}, every=1)
    files.save_states(states, str(tmp_path / "s"))
    last = files.latest_states(spark, str(tmp_path / "s")).collect()
    assert [(r.entity, r.step, r.n_updates) for r in last] == [(1, 5, 5)]
