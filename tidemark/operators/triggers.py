"""Triggers over state updates and probabilities, with the engine's default thresholds as parameters.

Streaks that start anew when they fire, and fire only outside their cooldown, are one fold over an entity's updates.
What depends on runs alone is plain windows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as c
from tidemark.operators import folds, windows


@dataclass(frozen=True)
class Rules:
    anomaly: float = c.ANOMALY_THRESHOLD
    streak_z: float = 2.0
    streak_length: int = 5
    least_gain: float = 0.001
    window: int = 10
    surprise: float = 1.5
    factors: int = 3
    boundary: float = 0.5
    near: float = 0.08
    approach: int = 3
    cooldown_hours: dict = field(default_factory=lambda: {k: v[0] for k, v in c.TRIGGERS.items()})


class Watch:
    """Early warnings of one entity, update after update."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.fired_at: dict[tuple[str, str], dt.datetime] = {}
        self.streaks = np.zeros(len(c.FACTORS), int)
        self.recent: list[np.ndarray] = []
        self.top: tuple[int, float] | None = None
        self.falls = 0

    def _free(self, kind: str, key: str, at: dt.datetime) -> bool:
        last = self.fired_at.get((kind, key))
        if last is not None and (at - last).total_seconds() < 3600 * self.rules.cooldown_hours[kind]:
            return False
        self.fired_at[kind, key] = at
        return True

    def update(self, at: dt.datetime, stream: str, z: float, gain: np.ndarray) -> Iterator[tuple[str, str, float]]:
        """(kind, key, value) of the triggers that an update fires: an anomaly, streaks of factors it informs, surprise on several factors."""
        rules, size = self.rules, abs(z)
        if size > rules.anomaly and self._free("anomalous_data", stream, at):
            yield "anomalous_data", stream, z
        pull = np.abs(gain)
        if len(pull) != len(c.FACTORS):
            return
        informed = pull > max(float(np.sort(pull)[len(pull) // 2]), rules.least_gain)
        self.streaks[informed] = self.streaks[informed] + 1 if size > rules.streak_z else 0
        for i in np.flatnonzero(informed & (self.streaks >= rules.streak_length)):
            if self._free("innovation_streak", c.FACTORS[i], at):
                yield "innovation_streak", c.FACTORS[i], float(self.streaks[i])
                self.streaks[i] = 0
        self.recent = [*self.recent, pull * size][-rules.window :]
        elevated = int((np.max(self.recent, axis=0) > rules.surprise).sum())
        if elevated >= rules.factors and self._free("multi_factor_surprise", "global", at):
            yield "multi_factor_surprise", "global", float(elevated)
            self.recent = []

    def probabilities(self, at: dt.datetime, p: np.ndarray, names: tuple[str, ...] = c.REGIMES) -> Iterator[tuple[str, str, float]]:
        """The likeliest regime, the same as before, falls and comes near the boundary from above, several times in a row."""
        top, now = int(np.argmax(p)), float(np.max(p))
        if self.top is not None:
            nearing = top == self.top[0] and now < self.top[1] and 0 < now - self.rules.boundary < self.rules.near
            self.falls = self.falls + 1 if nearing else 0
            if self.falls >= self.rules.approach and self._free("boundary_approach", names[top], at):
                yield "boundary_approach", names[top], now
                self.falls = 0
        self.top = (top, now)


WARNING_SCHEMA = "entity long, at timestamp, kind string, trigger_key string, value double, action string, urgency int"


def early_warnings(updates: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Triggers of each entity's (entity, at, n, stream_key, z, gain, probabilities) in the order of n, with action and urgency (1: most)."""
    rules = rules or Rules()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        watch, rows, entity = Watch(rules), [], int(pdf["entity"].iloc[0])
        for r in pdf.sort_values("n").itertuples():
            found = [*watch.update(r.at, r.stream_key, r.z, np.asarray(r.gain, float)), *watch.probabilities(r.at, np.asarray(r.probabilities, float))]
            rows += [(entity, r.at, kind, key, value, *c.TRIGGERS[kind][1:]) for kind, key, value in found]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in WARNING_SCHEMA.split(", ")])

    return updates.select("entity", "at", "n", "stream_key", "z", "gain", "probabilities").groupBy("entity").applyInPandas(run, WARNING_SCHEMA)


def structural_breaks(states: DataFrame, sigma: float = 3.0, spread: float = 0.3, least: int = 2) -> DataFrame:
    """Adds to rows of `lockstep.branch_states`: outside, the factors that no branch comes near (name and value), broken where there are `least`, and the text that tells so.

    A branch is near a factor when it differs by less than sigma * spread.  A row holds all that is compared, so nothing is joined.
    """
    names = F.array(*[F.lit(x) for x in c.FACTORS])
    named = F.zip_with(names, "factors", lambda name, value: F.struct(name.alias("name"), value.alias("value")))
    far = lambda i, value: F.forall("branches", lambda b: F.abs(value - F.get(b["factors"], i)) >= sigma * spread)
    outside = F.filter(named, lambda f, i: far(i, f["value"]))
    told = F.array_join(F.transform(F.slice("outside", 1, 4), lambda f: F.format_string("%s=%+.3f", f["name"], f["value"])), ", ")
    rows = states.withColumn("outside", outside).withColumn("broken", F.size("outside") >= least)
    detail = F.concat(F.lit("State outside all branch models on "), F.size("outside").cast("string"), F.lit(" factors: "), told)
    return rows.withColumn("detail", F.when(F.col("broken"), detail))


def _runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, length: int) -> DataFrame:
    runs = windows.islands(df, keys, order, flag).where(F.col("flag").cast("int") != 0)
    return runs.groupBy(*keys, "run", "flag").agg(F.min(order[0]).alias("first_day"), F.max(order[0]).alias("last_day"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= length).drop("run")


def tier_crossings(df: DataFrame, keys: list[str], order: list[str], p: str = "p", tiers: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys, order, tier, direction) of every tier that a probability crosses from one row to the next."""
    rows = df.withColumn("b", F.lag(p).over(windows.along(keys, order))).where("b is not null").withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    up = (F.col("b") < F.col("tier")) & (F.col(p) >= F.col("tier"))
    down = (F.col("b") >= F.col("tier")) & (F.col(p) < F.col("tier"))
    return rows.where(up | down).select(*keys, *order, "tier", F.when(up, "up").otherwise("down").alias("direction"))


def sustained_drift(df: DataFrame, keys: list[str], order: list[str], p: str = "p", least: float = 0.001, length: int = 5) -> DataFrame:
    """Runs of at least so many moves in one direction (flag 1 or -1), each larger than `least`."""
    moves = df.withColumn("d", windows.difference(F.col(p), windows.along(keys, order))).where("d is not null")
    return _runs(moves, keys, order, F.when(F.col("d") > least, 1).when(F.col("d") < -least, -1).otherwise(0), length)


def convergence(df: DataFrame, keys: list[str], order: list[str], spread: Column, near: float = 0.05, length: int = 10) -> DataFrame:
    """Runs of at least so many rows in which a pair of branches is closer than `near`."""
    return _runs(df, keys, order, (F.abs(spread) < near).cast("int"), length)


def extinction(df: DataFrame, keys: list[str], order: list[str], p: str = "p", bound: float = 0.02, length: int = 5) -> DataFrame:
    """Runs of at least so many rows of a probability under the bound."""
    return _runs(df, keys, order, (F.col(p) < bound).cast("int"), length)


def pending(triggers: DataFrame, resolved: DataFrame | None = None, kept: int = 200) -> DataFrame:
    """Triggers (entity, at, kind, trigger_key, ...) numbered by entity in order of time, with `resolved` and `place`.

    resolved holds (entity, id); of the resolved ones only the last `kept` of an entity stay.  place is where an
    unresolved trigger stands among its entity's by urgency of its kind, then by id, from 1; null for resolved ones.
    """
    numbered = triggers.withColumn("id", F.row_number().over(windows.along(["entity"], ["at", "kind", "trigger_key"])))
    marked = numbered.withColumn("resolved", F.lit(False))
    if resolved is not None:
        done = resolved.select("entity", "id").distinct().withColumn("__done", F.lit(True))
        marked = numbered.join(done, ["entity", "id"], "left").withColumn("resolved", F.coalesce("__done", F.lit(False))).drop("__done")
    back = F.row_number().over(Window.partitionBy("entity", "resolved").orderBy(F.desc("id")))
    marked = marked.withColumn("__back", back).where(~F.col("resolved") | (F.col("__back") <= kept)).drop("__back")
    urgency = F.create_map(*[x for k, v in c.TRIGGERS.items() for x in (F.lit(k), F.lit(v[2]))])
    order = Window.partitionBy("entity", "resolved").orderBy(F.coalesce(F.try_element_at(urgency, F.col("kind")), F.lit(len(c.TRIGGERS) + 1)), "id")
    return marked.withColumn("place", F.when(~F.col("resolved"), F.row_number().over(order)))


def cooled_by_kind(triggers: DataFrame, order: list[str]) -> DataFrame:
    """Triggers (entity, kind, trigger_key, order...) outside the cooldown of their kind."""
    hours = F.create_map(*[x for k, v in c.TRIGGERS.items() for x in (F.lit(k), F.lit(v[0]))])
    return folds.cooled(triggers, ["entity", "kind", "trigger_key"], order, hours[F.col("kind")] * 3600)
