"""The same engine on streams: one state for each entity, moved on in event time by the steps that the batch replay takes.

A day is open until a later one has been seen, `lateness` days ahead, in an earlier micro-batch; observations of open
days are kept in the state, and their rows are provisional: they come again when more of an open day comes, and the row
of most updates counts (`states`).  Closed days move the engine for good.  Timers in event time close the days of
entities that have gone quiet, and tell of streams that have said nothing for `silent_after` days.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.filters import STATE_SCHEMA, Config, Replay
from tidemark.sources import shared

INPUT_SCHEMA = "entity long, day date, ord int, stream_key string, z double"
ONLINE_SCHEMA = STATE_SCHEMA + ", late long, silent string"
_COLUMNS = [x.split()[0] for x in ONLINE_SCHEMA.split(", ")]
_DAY_MS = 86_400_000
#: Event times are put this many days ahead and the watermark as many behind: Spark then drops no late row, they are ours to report.
_AHEAD = 36_500
_EPOCH = dt.date(1970, 1, 1)


def _number(day: dt.date) -> int:
    return (day - _EPOCH).days


def _date(number: int) -> dt.date:
    return _EPOCH + dt.timedelta(days=number)


class Entity:
    """What a stream keeps of an entity: the engine after all closed days, the observations of open ones, when each stream was last seen."""

    def __init__(self, config: Config, saved: str | None):
        own = json.loads(saved) if saved else {}
        self.config, self.engine_state, self.closed = config, own.get("engine"), own.get("closed")
        self.open: dict[int, list] = {int(k): v for k, v in own.get("open", {}).items()}
        self.seen: dict[str, int] = own.get("seen", {})
        self.silent: list[str] = own.get("silent", [])

    def state(self) -> str:
        return json.dumps({"engine": self.engine_state, "closed": self.closed, "open": self.open, "seen": self.seen, "silent": self.silent})

    def take(self, day: int, observed: list[tuple]) -> None:
        """Observations (ord, stream, value) of an open day."""
        self.open.setdefault(day, []).extend(observed)
        for _, key, _ in observed:
            self.seen[key] = max(self.seen.get(key, day), day)
        self.silent = [k for k in self.silent if k not in {o[1] for o in observed}]

    def close(self, before: int) -> None:
        """Steps the engine through the open days before this one."""
        days = sorted(d for d in self.open if d < before)
        if days:
            engine = Replay.resumed(self.config, self.engine_state)
            for _ in self._steps(engine, days):
                pass
            self.engine_state, self.closed = engine.state(), days[-1]
            for d in days:
                del self.open[d]

    def provisional(self, entity: int) -> list[tuple]:
        engine = Replay.resumed(self.config, self.engine_state)
        return [engine.row(entity, _date(d)) for d in self._steps(engine, sorted(self.open))]

    def _steps(self, engine: Replay, days: list[int]) -> Iterator[int]:
        for d in days:
            engine.day([(key, z) for _, key, z in sorted(self.open[d], key=lambda o: o[0])])
            yield d

    def fallen_silent(self, now: int, after: int) -> list[tuple[str, int]]:
        """(stream, day last seen) of streams that have been quiet so long since then and weren't told of yet."""
        found = [(k, d) for k, d in sorted(self.seen.items()) if now - d >= after and k not in self.silent]
        self.silent += [k for k, _ in found]
        return found

    def next_timer(self, now: int, lateness: int, silent_after: int) -> int | None:
        """The next day on which something closes or falls silent."""
        times = [d + 1 + lateness for d in self.open] + [d + silent_after for k, d in self.seen.items() if k not in self.silent]
        return max(min(times), now + 1) if times else None


def online_replay(stream: DataFrame, config: Config, lateness: int = 0, silent_after: int = 30) -> DataFrame:
    """A row for each entity and day as it is taken in, `late` 0; a row that only counts the observations of a closed day; a row for each stream that falls silent.

    `states`, `late_rows` and `silent_streams` tell them apart.  Late observations never move a state.  However the input
    is cut into micro-batches, if no day comes more than `lateness` days after a later one, the states are the batch replay's.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entity, own, rows = int(key[0]), Entity(config, state.get[0] if state.exists else None), []
        now = state.getCurrentWatermarkMs() // _DAY_MS - _AHEAD  # the latest day of earlier micro-batches
        none = (None,) * 6
        own.close(now - lateness)
        if not state.hasTimedOut:
            for day, part in pd.concat(list(parts)).groupby("day", sort=True):
                number = _number(day)
                if own.closed is not None and number <= own.closed or number < now - lateness:
                    rows.append((entity, config.config_id, day, *none, len(part), None))
                else:
                    own.take(number, list(zip(part["ord"].tolist(), part["stream_key"].tolist(), part["z"].tolist())))
            rows += [(*r, 0, None) for r in own.provisional(entity)]
        rows += [(entity, config.config_id, _date(d), *none, 0, k) for k, d in own.fallen_silent(now, silent_after)]
        state.update((own.state(),))
        timer = own.next_timer(now, lateness, silent_after)
        if timer is not None:
            state.setTimeoutTimestamp((timer + _AHEAD) * _DAY_MS - 1)
        yield pd.DataFrame(rows, columns=_COLUMNS)

    timed = stream.where("entity is not null and day is not null").withColumn("__time", F.date_add("day", 2 * _AHEAD).cast("timestamp")).withWatermark("__time", f"{_AHEAD} days")
    return timed.groupBy("entity").applyInPandasWithState(advance, ONLINE_SCHEMA, "own string", "append", GroupStateTimeout.EventTimeTimeout)


def states(out: DataFrame) -> DataFrame:
    """The last row of each entity and day."""
    rows = out.where("late = 0 and silent is null").drop("late", "silent")
    columns = [c for c in rows.columns if c not in ("entity", "day")]
    return rows.groupBy("entity", "day").agg(F.max_by(F.struct(*columns), F.struct("n_updates", "step")).alias("r")).select(*[c if c in ("entity", "day") else f"r.{c}" for c in rows.columns])


def late_rows(out: DataFrame) -> DataFrame:
    """(entity, day, late): observations that came after their day had closed."""
    return out.where("late > 0").select("entity", "day", "late")


def silent_streams(out: DataFrame) -> DataFrame:
    """(entity, day, stream_key): streams that fell silent, and the day they were last seen."""
    return out.where("silent is not null").select("entity", "day", F.col("silent").alias("stream_key"))


def windowed(stream: DataFrame, late: str, size: str) -> DataFrame:
    """Counts and means of each stream in tumbling windows, closed once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "stream_key").agg(F.count("raw").alias("n"), F.avg("raw").alias("mean"))


def run_to_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Takes in all that a source holds now and gives the written result; the checkpoint lets a broken run go on where it stopped."""
    out = shared.folder(spark, f"{name}-out")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared.folder(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def files(spark: SparkSession, path: str, schema: str, at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)
