"""The engine of `filters.Replay` for many entities at once: arrays of states that take their days in lockstep.

An entity's days follow one another, but entities don't wait for each other.  The k-th day of all entities of a slab is
one prediction of whole arrays, and their j-th observations of that day are one update.  Entities are sorted by their
number of days, so those still under way are always the first rows.  Numbers agree with `Replay` but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import constants as c
from tidemark.operators.filters import STATE_SCHEMA, SUB_SCHEMA, UPDATE_SCHEMA, N, Bank, Config, Filter, Replay, sub_banks, vector

#: Rows of whole entities that are stepped together; a longer series is a slab of its own.
SLAB_ROWS = 1 << 17

Rows = slice | np.ndarray


class Filters:
    """The same few linear filters for each entity: x is (entities, filters, N), p (entities, filters, N, N)."""

    def __init__(self, filters: list[Filter], entities: int):
        self.f, self.q = np.stack([k.f for k in filters]), np.stack([k.q for k in filters])
        self.x = np.repeat(np.stack([k.x for k in filters])[None], entities, 0)
        self.p = np.repeat(np.stack([k.p for k in filters])[None], entities, 0)

    def predict(self, rows: Rows, q_scale: np.ndarray | float = 1.0) -> None:
        """q_scale: for each row, or each filter of every row."""
        scale = np.reshape(q_scale, (*np.shape(q_scale), 1, 1)) if np.ndim(q_scale) == 1 else np.reshape(q_scale, (-1, 1, 1, 1)) if np.ndim(q_scale) else q_scale
        self.x[rows] = (self.f @ self.x[rows][..., None])[..., 0]
        self.p[rows] = self.f @ self.p[rows] @ self.f.transpose(0, 2, 1) + self.q * scale

    def update(self, rows: Rows, h: np.ndarray, r: np.ndarray, value: np.ndarray, predicted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(innovations, their variances, gains) of one observation a row: h is (rows, N), or (rows, filters, N); r likewise."""
        h = h[:, None, :] if h.ndim == 2 else h
        r = r[:, None] if r.ndim == 1 else r
        x, p = self.x[rows], self.p[rows]
        ph = (p @ h[..., None])[..., 0]
        hph = (ph * h).sum(-1)
        s = hph + r
        s = np.where(s > 0, s, r)
        k = ph / s[..., None]
        gap = value[:, None] - ((x * h).sum(-1) if predicted is None else predicted)
        left = p - k[..., :, None] * ph[..., None, :]
        self.x[rows] = x + k * gap[..., None]
        self.p[rows] = left - (ph - k * hph[..., None])[..., :, None] * k[..., None, :] + r[..., None, None] * k[..., :, None] * k[..., None, :]
        return gap, s, k


class Banks(Filters):
    """`filters.Bank` for each entity: mu is (entities, branches), tpm (entities, branches, branches)."""

    def __init__(self, one: Bank, entities: int):
        super().__init__(one.filters, entities)
        self.config, self.floor = one.config, one.floor
        self.shifts, self.drifts = np.stack(one.shifts), np.stack(one.drifts)
        self.q_scales = np.array(one.q_scales)
        self.mu = np.repeat(one.mu[None], entities, 0)
        self.tpm = np.repeat(one.tpm[None], entities, 0)
        self.n = np.zeros(entities, np.int64)

    def predict(self, rows: Rows) -> None:  # type: ignore[override]
        if self.config.mixing:
            mu, tpm = self.mu[rows], self.tpm[rows]
            flow = np.maximum((tpm * mu[:, :, None]).sum(1), 1e-15)
            share = (tpm * mu[:, :, None] / flow[:, None, :]).transpose(0, 2, 1)  # (entity, to, from)
            x, p = self.x[rows], self.p[rows]
            mixed = share @ x
            apart = x[:, None] - mixed[:, :, None]
            spread = (share[..., None] * apart).transpose(0, 1, 3, 2) @ apart
            self.p[rows] = (share @ p.reshape(*p.shape[:2], N * N)).reshape(p.shape) + spread
            self.x[rows] = mixed
            if self.config.carry_prior:
                self.mu[rows] = flow / flow.sum(1, keepdims=True)
        Filters.predict(self, rows, self.q_scales)
        x = self.x[rows] + self.drifts
        if self.config.mixing:
            pulled = self.shifts.any(1)[:, None]
            x = np.where(pulled, x + self.config.pull * self.shifts, x * c.NEUTRAL_SHRINK)
        self.x[rows] = x

    def observe(self, rows: Rows, h: np.ndarray, r: np.ndarray, value: np.ndarray) -> None:
        """An update of every branch, then tempered Bayes on their likelihoods; h and r for each row, or each branch of every row."""
        gap, s, _ = self.update(rows, h, r, value)
        if self.config.likelihood_after:
            h = h[:, None, :] if h.ndim == 2 else h
            gap = value[:, None] - (self.x[rows] * h).sum(-1)
            s = ((self.p[rows] @ h[..., None])[..., 0] * h).sum(-1) + (r[:, None] if r.ndim == 1 else r)
        self.n[rows] += 1
        power = c.TEMPER_FLOOR + (self.config.ceiling - c.TEMPER_FLOOR) * np.minimum(self.n[rows] / c.TEMPER_HORIZON, 1.0)
        likely = np.maximum(np.exp(-gap * gap / (2 * s)) / np.sqrt(2 * np.pi * s), c.LIKELIHOOD_FLOOR)
        weight = likely ** power[:, None] * self.mu[rows]
        total = weight.sum(1, keepdims=True)
        mu = np.where(total > 0, weight / np.where(total > 0, total, 1.0), self.mu[rows])
        mu = np.clip(mu, self.floor, c.PROBABILITY_CEILING)
        self.mu[rows] = mu / mu.sum(1, keepdims=True)


def state_transitions(x: np.ndarray) -> np.ndarray:
    """`filters.state_transitions` of rows of factors."""
    tpm = np.zeros((len(x), len(c.REGIMES), len(c.REGIMES)))
    for source, target, weights, low, high in c.EXIT_RULES:
        tpm[:, source, target] = low + (high - low) / (1 + np.exp(-(x @ vector(weights))))
    stay = np.arange(len(c.REGIMES))
    tpm[:, stay, stay] = np.maximum(1 - tpm.sum(2), c.LEAST_STAY)
    return tpm / tpm.sum(2, keepdims=True)


def lengthened(tpm: np.ndarray, regime_of: np.ndarray, weeks: np.ndarray) -> np.ndarray:
    """`filters.lengthened` of one matrix for rows whose regime has lasted so many weeks."""
    out = np.repeat(tpm[None], len(weeks), 0)
    for regime, targets, half, least, most, slope in c.DURATION_EXITS:
        age, targets = np.where(regime_of == regime, weeks, 0), list(targets)
        total = np.where(age > 0, least + (most - least) / (1 + np.exp(-slope * (age - half))), least)
        now = out[:, regime, targets].sum(1)
        grows = np.flatnonzero((total > now) & (now > 0))
        row = out[grows, regime]
        row[:, targets] *= (total / np.where(now > 0, now, 1.0))[grows][:, None]
        row[:, regime] = np.maximum(row[:, regime] - (total - now)[grows], c.LEAST_STAY)
        out[grows, regime] = row / row.sum(1, keepdims=True)
    return out


@dataclass
class Slab:
    """Whole entities, by falling number of days: the observations of entity i's k-th day are rows first[i] + k of the day table."""

    entity: np.ndarray
    n_days: np.ndarray
    last_day: np.ndarray  # of any row, known or not
    first: np.ndarray  # entity -> its first row of the day table
    day: np.ndarray  # day table: the day,
    start: np.ndarray  # where its observations begin,
    size: np.ndarray  # and how many they are
    key: np.ndarray  # observations: number of the stream,
    z: np.ndarray
    r: np.ndarray  # and its own noise, or nan


def slab_of(pdf: pd.DataFrame, config: Config, keys: dict[str, int]) -> Slab:
    """The known observations of whole entities, by entity, day and ord."""
    pdf = pdf.sort_values(["entity", "day", "ord"], kind="stable")
    entity, day = pdf["entity"].to_numpy(), pdf["day"].to_numpy().astype("datetime64[D]")
    key = pdf["stream_key"].map(keys).fillna(-1).to_numpy().astype(np.int64)
    z = pdf["z"].to_numpy(np.float64, na_value=np.nan)
    r = pdf["r"].to_numpy(np.float64, na_value=np.nan) if "r" in pdf else np.full(len(pdf), np.nan)
    known = (key >= 0) & ~np.isnan(z)
    heads = np.flatnonzero(np.append(True, entity[1:] != entity[:-1]))
    ids, last_day = entity[heads], day[np.append(heads[1:], len(entity)) - 1]
    counted = np.ones(len(key), bool) if config.every_day else known
    new_day = np.append(True, (entity[1:] != entity[:-1]) | (day[1:] != day[:-1]))
    number = np.cumsum(new_day) - 1
    used = np.unique(number[counted])
    at = np.searchsorted(number, used)
    own = number[known]
    start = np.searchsorted(own, used)
    size = np.searchsorted(own, used, side="right") - start
    n_days = np.searchsorted(entity[at], ids, side="right") - np.searchsorted(entity[at], ids)
    order = np.argsort(-n_days, kind="stable")
    first = np.searchsorted(entity[at], ids)
    return Slab(ids[order], n_days[order], last_day[order], first[order], day[at], start, size, key[known], z[known], r[known])


class Lockstep:
    """The states of one variant of the engine for the entities of a slab."""

    def __init__(self, config: Config, entities: int, keys: dict[str, int]):
        one = Replay(config)
        self.config = config
        self.base, self.bank = Filters([one.base], entities), Banks(one.bank, entities)
        self.h = np.array([one.loadings(k) for k in keys]).reshape(-1, N)
        self.h_branch = np.array([one.branch_loadings(k) for k in keys])
        self.base_r = np.array([one.base_noise(k) for k in keys])
        self.classes = np.array([one.noise_scales(k) for k in keys])
        self.base_tpm = one.bank.base_tpm
        self.slow = np.array([config.cumulate and k in c.SLOW_STREAMS and k in config.streams for k in keys], bool)
        self.log_r = np.repeat(np.log(self.base_r)[None], entities, 0)
        self.seen = np.full((entities, len(keys)), -1, np.int64)
        self.sum, self.sum_n = np.zeros((entities, len(keys))), np.zeros((entities, len(keys)), np.int64)
        self.step, self.n, self.anomalies = (np.zeros(entities, np.int64) for _ in range(3))
        self.ll = np.zeros(entities)
        self.top, self.weeks = np.full(entities, -1), np.zeros(entities, np.int64)

    def predict(self, active: int) -> None:
        """The next day of the first `active` entities; all of them are at the same step."""
        rows = slice(0, active)
        if self.step[0] % 7 == 0:
            top = self.bank.mu[rows].argmax(1)
            self.weeks[rows] = np.where(top == self.top[rows], self.weeks[rows] + 1, 1)
            self.top[rows] = top
            if self.config.state_tpm:
                self.bank.tpm[rows] = state_transitions(self.base.x[rows, 0])
            elif self.config.duration_tpm:
                self.bank.tpm[rows] = lengthened(self.base_tpm, top, self.weeks[rows])
        self.step[rows] += 1
        self.before = self.bank.mu[rows].copy()
        scale = (self.before @ np.array([c.REGIME_Q[r] for r in c.REGIMES]))[:, None] if self.config.regime_noise else 1.0
        self.base.predict(rows, scale)
        self.bank.predict(rows)
        if self.slow.any():
            self.sum[rows] += np.where(self.slow, self.base.x[rows, 0] @ self.h.T, 0.0)
            self.sum_n[rows] += self.slow

    def update(self, rows: np.ndarray, key: np.ndarray, value: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, ...]:
        """One observation for each of these entities: (predicted, innovation, variance, gain, state before)."""
        config, h_branch = self.config, self.h_branch[key]
        h = (self.before[rows][:, :, None] * h_branch).sum(1) if config.regime_loadings else self.h[key]
        r = np.exp(self.log_r[rows, key]) if config.gas else self.base_r[key]
        seen = self.seen[rows, key]
        gap = np.where(self.slow[key], self.sum_n[rows, key], np.where(seen >= 0, self.step[rows] - seen, 0) if config.gap else 1)
        r = np.where(gap > 1, r * (1 + c.GAP_SLOPE * np.log(np.maximum(gap, 1))), r)
        own_r = np.where(np.isnan(given)[:, None], r[:, None] * self.classes[key], given[:, None])
        if config.regime_noise:
            r = r * (self.before[rows] * self.classes[key]).sum(1)
        r = np.where(np.isnan(given), r, given)
        before = self.base.x[rows, 0].copy()
        n = self.sum_n[rows, key]
        predicted = np.where(n > 0, self.sum[rows, key] / np.maximum(n, 1), (before * h).sum(1))
        innovation, s, gain = (v[:, 0] for v in self.base.update(rows, h, r, value, predicted[:, None]))
        self.ll[rows] += -0.5 * (np.log(2 * np.pi * s) + innovation * innovation / s)
        self.anomalies[rows] += np.abs(innovation) / np.sqrt(s) > c.ANOMALY_THRESHOLD
        if config.gas:
            moved = (1 - c.GAS_BETA) * np.log(self.base_r[key]) + c.GAS_BETA * self.log_r[rows, key] + c.GAS_ALPHA * (np.minimum(innovation * innovation / s, c.GAS_MAX_RATIO) - 1)
            self.log_r[rows, key] = np.clip(moved, c.GAS_LOW, c.GAS_HIGH)
        self.bank.observe(rows, h_branch if config.regime_loadings else h, own_r if config.branch_noise else r, value)
        self.sum[rows, key], self.sum_n[rows, key] = 0.0, 0
        self.seen[rows, key] = self.step[rows]
        self.n[rows] += 1
        return predicted, innovation, s, gain, before


def known_keys(config: Config) -> dict[str, int]:
    return {k: i for i, k in enumerate([*config.streams, *("@" + f for f in c.FACTORS)])}


def stepped(slab: Slab, engine: Lockstep, on_update: Callable | None = None, on_predict: Callable | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Takes all days of a slab; (day number, rows of the day table of the entities under way) after each."""
    for k in range(int(slab.n_days.max(initial=0))):
        active = int(np.searchsorted(-slab.n_days, -k, side="left"))
        engine.predict(active)
        if on_predict:
            on_predict(active)
        at = slab.first[:active] + k
        start, size = slab.start[at], slab.size[at]
        for j in range(int(size.max(initial=0))):
            rows = np.flatnonzero(size > j)
            obs = start[rows] + j
            done = engine.update(rows, slab.key[obs], slab.z[obs], slab.r[obs])
            if on_update:
                on_update(rows, obs, done)
        yield k, at


def _slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole entities, about SLAB_ROWS rows at once, from batches sorted by entity."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= SLAB_ROWS:
            rows = pd.concat(held, ignore_index=True)
            open_from = int(np.searchsorted(rows["entity"].to_numpy(), rows["entity"].iloc[-1]))
            if open_from:
                yield rows.iloc[:open_from]
            held, n = [rows.iloc[open_from:]], len(rows) - open_from
    if n:
        yield pd.concat(held, ignore_index=True)


def by_slabs(obs: DataFrame, fn: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """fn over slabs of whole entities; entities are dealt to tasks by hash, rows without entity are left out."""
    columns = ["entity", "day", "ord", "stream_key", "z", *[x for x in ("r",) if x in obs.columns]]
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = obs.select(*columns).where("entity is not null").repartition(tasks, "entity").sortWithinPartitions("entity", "day", "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slabs(batches):
            yield from fn(pdf)

    return dealt.mapInPandas(run, schema)


def snapshots(pdf: pd.DataFrame, name: str, config: Config, every: int) -> pd.DataFrame:
    """The rows that `filters.replay` gives for one variant and the entities of a slab."""
    keys = known_keys(config)
    slab = slab_of(pdf, config, keys)
    engine = Lockstep(config, len(slab.entity), keys)
    parts = []

    def rows(which: np.ndarray, day: np.ndarray) -> pd.DataFrame:
        columns = {
            "entity": slab.entity[which], "config_id": name, "day": day, "step": engine.step[which].astype(np.int32), "n_updates": engine.n[which], "log_likelihood": engine.ll[which], "anomalies": engine.anomalies[which],
            "factors": list(engine.base.x[which, 0]), "probabilities": list(engine.bank.mu[which]),
        }
        return pd.DataFrame(columns)

    for k, at in stepped(slab, engine):
        if k % every == 0:
            parts.append(rows(np.arange(len(at)), slab.day[at]))
    left = np.flatnonzero((slab.n_days > 0) & ((slab.n_days - 1) % every != 0))
    parts.append(rows(left, slab.last_day[left]))
    return pd.concat(parts, ignore_index=True)


def records(pdf: pd.DataFrame, name: str, config: Config) -> Iterator[pd.DataFrame]:
    """The rows that `filters.updates` gives for one variant and the entities of a slab, some at a time."""
    keys = known_keys(config)
    names = np.array(list(keys), dtype=object)
    slab = slab_of(pdf, config, keys)
    engine = Lockstep(config, len(slab.entity), keys)
    parts: list[pd.DataFrame] = []

    def on_update(rows: np.ndarray, obs: np.ndarray, done: tuple[np.ndarray, ...]) -> None:
        predicted, innovation, s, gain, before = done
        day = slab.day[slab.first[rows] + engine.step[rows] - 1]
        columns = {
            "entity": slab.entity[rows], "config_id": name, "day": day, "step": engine.step[rows].astype(np.int32), "n": engine.n[rows], "stream_key": names[slab.key[obs]], "observed": slab.z[obs],
            "predicted": predicted, "innovation": innovation, "s": s, "z": innovation / np.sqrt(s), "gain": list(gain), "before": list(before), "after": list(engine.base.x[rows, 0]), "probabilities": list(engine.bank.mu[rows]),
        }
        parts.append(pd.DataFrame(columns))

    held = 0
    for _ in stepped(slab, engine, on_update):
        held += len(parts[-1]) if parts else 0
        if held > 1 << 15:
            yield pd.concat(parts, ignore_index=True)
            parts.clear()
            held = 0
    if parts:
        yield pd.concat(parts, ignore_index=True)


def replay(obs: DataFrame, variants: dict[str, Config], every: int = 7) -> DataFrame:
    """Runs every variant over every entity's (entity, day, ord, stream_key, z[, r]), a snapshot every so many steps and at the end."""

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for name, config in variants.items():
            yield snapshots(pdf, name, config, every)

    return by_slabs(obs, run, STATE_SCHEMA)


def updates(obs: DataFrame, variants: dict[str, Config]) -> DataFrame:
    """A record of every measurement update: what was observed and predicted, the innovation with its variance, gain, state before and after, probabilities."""

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for name, config in variants.items():
            yield from records(pdf, name, config)

    return by_slabs(obs, run, UPDATE_SCHEMA)


BRANCH_SCHEMA = "entity long, config_id string, day date, step int, factors array<double>, branches array<struct<name: string, p: double, factors: array<double>>>"


def branch_states(obs: DataFrame, variants: dict[str, Config], every: int = 7) -> DataFrame:
    """At the snapshots of `replay`: the shared filter's factors beside those of every branch, with the branch's probability."""

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for name, config in variants.items():
            keys, names = known_keys(config), [b.name for b in config.branches]
            slab = slab_of(pdf, config, keys)
            engine = Lockstep(config, len(slab.entity), keys)

            def rows(which: np.ndarray, day: np.ndarray, name: str = name, names: list[str] = names, slab: Slab = slab, engine: Lockstep = engine) -> pd.DataFrame:
                branches = [[{"name": b, "p": p, "factors": x.tolist()} for b, p, x in zip(names, ps, xs)] for ps, xs in zip(engine.bank.mu[which].tolist(), engine.bank.x[which])]
                return pd.DataFrame({"entity": slab.entity[which], "config_id": name, "day": day, "step": engine.step[which].astype(np.int32), "factors": list(engine.base.x[which, 0]), "branches": branches})

            for k, at in stepped(slab, engine):
                if k % every == 0:
                    yield rows(np.arange(len(at)), slab.day[at])
            left = np.flatnonzero((slab.n_days > 0) & ((slab.n_days - 1) % every != 0))
            yield rows(left, slab.last_day[left])

    return by_slabs(obs, run, BRANCH_SCHEMA)


HEALTH_SCHEMA = "entity long, config_id string, day date, condition double, effective_rank int, deviations array<double>"


def health(p: np.ndarray, share: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """(condition, effective rank) of covariances (n, N, N): the largest by the smallest eigenvalue, and how many are over this share of the largest."""
    value = np.linalg.eigvalsh((p + p.transpose(0, 2, 1)) / 2)
    return value[:, -1] / np.maximum(value[:, 0], 1e-10), (value > share * value[:, -1:]).sum(1)


def covariance_health(obs: DataFrame, variants: dict[str, Config]) -> DataFrame:
    """Condition, effective rank and standard deviations of the shared filter's covariance at every entity's last day."""

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for name, config in variants.items():
            keys = known_keys(config)
            slab = slab_of(pdf, config, keys)
            engine = Lockstep(config, len(slab.entity), keys)
            for _ in stepped(slab, engine):
                pass
            which = np.flatnonzero(slab.n_days > 0)
            p = engine.base.p[which, 0]
            condition, rank = health(p)
            deviations = np.sqrt(np.maximum(np.diagonal(p, axis1=1, axis2=2), 0))
            yield pd.DataFrame({"entity": slab.entity[which], "config_id": name, "day": slab.last_day[which], "condition": condition, "effective_rank": rank.astype(np.int32), "deviations": list(deviations)})

    return by_slabs(obs, run, HEALTH_SCHEMA)


def nested(obs: DataFrame) -> DataFrame:
    """At the last day of each entity: sub-regimes by a bank of their own in each regime, joint with the regime's probability, beside
    shadow filters that start from the regime's shift and never compete. The banks and shadows follow the engine's days."""

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        config = Config()
        keys = known_keys(config)
        slab = slab_of(pdf, config, keys)
        entities = len(slab.entity)
        engine = Lockstep(config, entities, keys)
        banks = {r: Banks(b, entities) for r, b in sub_banks(config).items()}
        shadows = Filters([Filter.fresh(config, vector(c.REGIME_ADJUSTMENTS[r])) for r in c.REGIMES], entities)

        def on_predict(active: int) -> None:
            rows = slice(0, active)
            shadows.predict(rows)
            for bank in banks.values():
                bank.predict(rows)

        def on_update(rows: np.ndarray, obs: np.ndarray, done: tuple[np.ndarray, ...]) -> None:
            key, value = slab.key[obs], slab.z[obs]
            h, r = engine.h[key], engine.base_r[key]
            shadows.update(rows, h, r, value)
            for bank in banks.values():
                bank.observe(rows, h, r, value)

        for _ in stepped(slab, engine, on_update, on_predict):
            pass
        which = np.flatnonzero(slab.n_days > 0)
        for k, regime in enumerate(c.REGIMES):
            up = engine.bank.mu[which, k]
            for j, name in enumerate(c.SUB_REGIMES[regime]):
                p = banks[regime].mu[which, j]
                yield pd.DataFrame({"entity": slab.entity[which], "day": slab.last_day[which], "regime": regime, "sub_regime": name, "p": p, "joint": np.round(up * p, 4), "active": up >= c.ACTIVE_AT, "shadow_inflation": shadows.x[which, k, 0]})

    return by_slabs(obs, run, SUB_SCHEMA)
