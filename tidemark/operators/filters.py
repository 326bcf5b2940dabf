"""Kalman filters and banks of them (interacting multiple models): one group of observations is one ordered fold."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as c

N = len(c.FACTORS)
_INDEX = {f: i for i, f in enumerate(c.FACTORS)}


def vector(values: dict[str, float]) -> np.ndarray:
    """Factor values in order; unknown names are ignored."""
    out = np.zeros(N)
    for name, value in values.items():
        if name in _INDEX:
            out[_INDEX[name]] = value
    return out


def transition(persistence: dict[str, float] = c.PERSISTENCE) -> np.ndarray:
    f = np.diag([persistence[k] for k in c.FACTORS])
    for source, target, x in c.CROSS_DYNAMICS:
        f[_INDEX[target], _INDEX[source]] = x
    return f


def process_noise(persistence: dict[str, float] = c.PERSISTENCE, shared: bool = False) -> np.ndarray:
    """Diagonal, or with the shocks that pairs of factors share."""
    q = np.diag([1 - persistence[k] ** 2 for k in c.FACTORS]) * c.Q_SCALE
    for a, b, rho in c.SHARED_SHOCKS if shared else ():
        i, j = _INDEX[a], _INDEX[b]
        q[i, j] = q[j, i] = rho * np.sqrt(q[i, i] * q[j, j])
    return q


def blended_persistence() -> dict[str, float]:
    """Theory and data weighted; commodities keep the theory's."""
    mixed = {k: min(round((1 - c.DATA_WEIGHT) * v + c.DATA_WEIGHT * c.DATA_PERSISTENCE[k], 4), c.MOST_PERSISTENT) for k, v in c.PERSISTENCE.items()}
    return mixed | {"commodity_pressure": c.PERSISTENCE["commodity_pressure"]}


def scaled_loadings(loadings: np.ndarray, regime: str) -> np.ndarray:
    """A stream's loadings as a regime sees them; unknown regimes change nothing."""
    return loadings * np.array([c.REGIME_LOADINGS.get(regime, {}).get(k, 1.0) for k in c.FACTORS])


def noise_class(stream: str) -> str:
    return next((k for k, v in c.STREAM_CLASSES.items() if stream in v), "other")


def state_transitions(x: np.ndarray) -> np.ndarray:
    """Exits follow logistic rules of the factors; a regime keeps at least half before rows are scaled to one."""
    tpm = np.zeros((len(c.REGIMES), len(c.REGIMES)))
    for source, target, weights, low, high in c.EXIT_RULES:
        tpm[source, target] = low + (high - low) / (1 + np.exp(-float(vector(weights) @ x)))
    np.fill_diagonal(tpm, np.maximum(1 - tpm.sum(axis=1), c.LEAST_STAY))
    return tpm / tpm.sum(axis=1, keepdims=True)


def lengthened(tpm: np.ndarray, weeks: dict[int, int]) -> np.ndarray:
    """Exits of a regime that has lasted so many weeks rise along a logistic ramp, in proportion, at the cost of its stay."""
    out = tpm.copy()
    for regime, targets, half, least, most, slope in c.DURATION_EXITS:
        age, targets = weeks.get(regime, 0), list(targets)
        total = least + (most - least) / (1 + np.exp(-slope * (age - half))) if age > 0 else least
        now = out[regime, targets].sum()
        if total > now > 0:
            out[regime, targets] *= total / now
            out[regime, regime] = max(out[regime, regime] - (total - now), c.LEAST_STAY)
            out[regime] /= out[regime].sum()
    return out


def sticky(states: int, stay: float = 0.98) -> np.ndarray:
    """Transitions that mostly stay, else go anywhere alike."""
    out = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(out, stay if states > 1 else 1.0)
    return out


def moved_stay(tpm: np.ndarray, change: float) -> np.ndarray:
    """The chance to stay changed by so much; exits keep their proportions."""
    stay = np.clip(np.diag(tpm) + change, 0.5, 0.999)
    out = tpm * ((1 - stay) / np.maximum(1 - np.diag(tpm), 1e-12))[:, None]
    np.fill_diagonal(out, stay)
    return out


@dataclass(frozen=True)
class Branch:
    """A regime hypothesis: prior (None: even), shift of the factors, and its own persistence (None: unchanged) and drift of some of them."""

    name: str
    shift: dict = field(default_factory=dict)
    prior: float | None = None
    overrides: tuple = ()  # (factor, persistence, drift)


def branches_of(spec: list[dict]) -> list[Branch]:
    """Branches from plain records: name, probability, state_adjustments, transition_overrides; names default to branch_id."""
    return [
        Branch(x.get("name") or x["branch_id"], dict(x.get("state_adjustments") or {}), x.get("probability"), tuple((o["factor"], o.get("persistence"), o.get("drift") or 0.0) for o in x.get("transition_overrides") or ()))
        for x in spec
    ]


REGIME_BRANCHES = tuple(Branch(r, c.REGIME_ADJUSTMENTS[r]) for r in c.REGIMES)


@dataclass(frozen=True)
class Config:
    """One variant of the engine; variants are rows of a small table, crossed with the entities."""

    config_id: str = "base"
    tpm: tuple = c.TRANSITIONS
    ceiling: float = c.TEMPER_CEILING
    pull: float = c.REGIME_PULL
    r_scale: float = 1.0
    q_scale: float = 1.0
    gas: bool = False
    gap: bool = False
    blended: bool = False
    shared_shocks: bool = False
    regime_noise: bool = False
    cumulate: bool = False
    state_tpm: bool = False
    duration_tpm: bool = False
    shift_scale: float = 1.0
    persistence_change: float = 0.0
    stay_change: float = 0.0
    regime_loadings: bool = False  # on: branches see a stream through loadings of their own, the shared filter through their mean
    branch_noise: bool = False  # on: a branch takes its regime's noise, not the mean over regimes
    likelihood_after: bool = False  # on: branches are weighed by what they say after their update
    mixing: bool = True  # off: branches move on their own, without a baseline
    carry_prior: bool = False  # on: Bayes starts from the propagated probabilities
    every_day: bool = False  # on: days without a known observation are predicted too
    branches: tuple = REGIME_BRANCHES
    streams: dict = field(default_factory=lambda: c.STREAM_LOADINGS)
    noises: dict = field(default_factory=dict)  # of streams, in place of the constants'
    transition: tuple | None = None  # rows of F, in place of the constants'


@dataclass
class Filter:
    """A linear filter with scalar updates in Joseph form."""

    f: np.ndarray
    q: np.ndarray
    x: np.ndarray
    p: np.ndarray

    @staticmethod
    def fresh(config: Config, shift: np.ndarray | None = None) -> Filter:
        persistence = blended_persistence() if config.blended else c.PERSISTENCE
        if config.persistence_change:
            persistence = {k: float(np.clip(v + config.persistence_change, 0.5, 0.999)) for k, v in persistence.items()}
        q = process_noise(persistence, config.shared_shocks) * config.q_scale
        f = transition(persistence) if config.transition is None else np.array(config.transition)
        return Filter(f, q, np.zeros(N) if shift is None else shift.copy(), c.INITIAL_VARIANCE * np.eye(N))

    def predict(self, q_scale: float = 1.0) -> None:
        self.x = self.f @ self.x
        self.p = self.f @ self.p @ self.f.T + self.q * q_scale

    def update(self, h: np.ndarray, r: float, value: float) -> tuple[float, float, np.ndarray]:
        """(innovation, its variance, gain)."""
        gap = value - float(h @ self.x)
        s = float(h @ self.p @ h + r)
        s = s if s > 0 else r
        k = self.p @ h / s
        keep = np.eye(N) - np.outer(k, h)
        self.x = self.x + k * gap
        self.p = keep @ self.p @ keep.T + np.outer(k, k) * r
        return gap, s, k


class Bank:
    """Branch filters whose weights are the branches' probabilities."""

    def __init__(self, config: Config, branches: Iterable[Branch] | None = None, tpm: tuple | None = None, floor: float = c.PROBABILITY_FLOOR, q_scales: tuple[float, ...] | None = None):
        self.config, self.floor, branches = config, floor, list(branches or config.branches)
        self.shifts = [config.shift_scale * vector(b.shift) for b in branches]
        self.filters = [Filter.fresh(config, s) for s in self.shifts]
        self.drifts = [vector({f: d for f, _, d in b.overrides}) for b in branches]
        for flt, b in zip(self.filters, branches):
            for factor, persistence, _ in b.overrides:
                if persistence is not None and factor in _INDEX:
                    flt.f[_INDEX[factor], _INDEX[factor]] = persistence
        prior = np.array([1 / len(branches) if b.prior is None else b.prior for b in branches], float)
        self.mu = prior / prior.sum()
        given = np.array(tpm or config.tpm)
        self.tpm = given if len(given) == len(branches) else sticky(len(branches))
        if config.stay_change:
            self.tpm = moved_stay(self.tpm, config.stay_change)
        self.base_tpm = self.tpm.copy()
        self.q_scales = q_scales or (1.0,) * len(branches)
        self.n = 0

    def predict(self) -> None:
        """Mixes the filters by their transition weights, then moves each one and pulls it towards its branch."""
        if self.config.mixing:
            flow = np.maximum(self.tpm.T @ self.mu, 1e-15)
            share = self.tpm * self.mu[:, None] / flow
            xs, ps = np.array([f.x for f in self.filters]), np.array([f.p for f in self.filters])
            for j, flt in enumerate(self.filters):
                flt.x = share[:, j] @ xs
                apart = xs - flt.x
                flt.p = np.einsum("i,ijk->jk", share[:, j], ps + apart[:, :, None] * apart[:, None, :])
            if self.config.carry_prior:
                self.mu = flow / flow.sum()
        for flt, shift, drift, scale in zip(self.filters, self.shifts, self.drifts, self.q_scales):
            flt.predict(scale)
            flt.x = flt.x + drift
            if self.config.mixing:
                flt.x = flt.x + self.config.pull * shift if shift.any() else flt.x * c.NEUTRAL_SHRINK

    def update(self, h: np.ndarray, r: float | np.ndarray, value: float) -> None:
        """Tempered Bayes on the filters' likelihoods, probabilities kept within bounds; h and r are one for all, or one for each branch."""
        self.n += 1
        power = c.TEMPER_FLOOR + (self.config.ceiling - c.TEMPER_FLOOR) * min(self.n / c.TEMPER_HORIZON, 1.0)
        likely = np.empty(len(self.filters))
        hs, rs = np.broadcast_to(h, (len(self.filters), N)), np.broadcast_to(r, len(self.filters))
        for k, flt in enumerate(self.filters):
            gap, s, _ = flt.update(hs[k], float(rs[k]), value)
            if self.config.likelihood_after:
                gap, s = value - float(hs[k] @ flt.x), float(hs[k] @ flt.p @ hs[k] + rs[k])
            likely[k] = max(np.exp(-gap * gap / (2 * s)) / np.sqrt(2 * np.pi * s), c.LIKELIHOOD_FLOOR)
        weight = likely**power * self.mu
        if weight.sum() > 0:
            self.mu = weight / weight.sum()
        self.mu = np.clip(self.mu, self.floor, c.PROBABILITY_CEILING)
        self.mu /= self.mu.sum()


STATE_SCHEMA = "entity long, config_id string, day date, step int, n_updates long, log_likelihood double, anomalies long, factors array<double>, probabilities array<double>"


class Replay:
    """The engine over one entity's observations: a batch takes a table of days, a stream one day after the other, with the same steps."""

    def __init__(self, config: Config):
        self.config = config
        scales = tuple(c.REGIME_Q[r] for r in c.REGIMES) if config.regime_noise else None
        self.streak = [-1, 0]  # the likeliest branch by week, and for how many weeks
        self.records: list[tuple] | None = None  # of every update, where a list is put here
        self.base, self.bank = Filter.fresh(config), Bank(config, q_scales=scales)
        self.log_r: dict[str, float] = {}
        self.seen: dict[str, int] = {}
        self.sums: dict[str, list[float]] = {}
        self.step, self.n, self.ll, self.anomalies = 0, 0, 0.0, 0

    def base_noise(self, key: str) -> float:
        r = self.config.noises[key] if key in self.config.noises else c.STREAM_NOISE.get(key, 0.10) * c.FREQUENCY_SCALE.get(key, 1.0)
        return r * self.config.r_scale

    def noise_scales(self, key: str) -> np.ndarray:
        """How much noisier each branch takes a stream to be: by its regime and the stream's class, 1 for other branches."""
        return np.array([c.REGIME_NOISE[b.name][noise_class(key)] if b.name in c.REGIME_NOISE else 1.0 for b in self.config.branches])

    def noise(self, key: str) -> float:
        """Score-driven, then for the gap since the stream was seen."""
        r = self.base_noise(key)
        if self.config.gas:
            r = float(np.exp(self.log_r.setdefault(key, np.log(r))))
        gap = self.sums[key][1] if key in self.sums else self.step - self.seen.get(key, self.step) if self.config.gap else 1
        return r * (1 + c.GAP_SLOPE * np.log(gap)) if gap > 1 else r

    def _weekly(self) -> None:
        top = int(self.bank.mu.argmax())
        self.streak = [top, self.streak[1] + 1 if top == self.streak[0] else 1]
        if self.config.state_tpm:
            self.bank.tpm = state_transitions(self.base.x)
        elif self.config.duration_tpm:
            self.bank.tpm = lengthened(self.bank.base_tpm, {self.streak[0]: self.streak[1]})

    def loadings(self, key: str) -> np.ndarray:
        """Of a stream, or of a qualitative signal on one factor: '@' and its name."""
        return vector({key[1:]: 1.0}) if key.startswith("@") else vector(self.config.streams[key])

    def branch_loadings(self, key: str) -> np.ndarray:
        """(branches, N): the loadings as each branch sees them."""
        return np.array([scaled_loadings(self.loadings(key), b.name) if self.config.regime_loadings and key[0] != "@" else self.loadings(key) for b in self.config.branches])

    def day(self, observed: list[tuple]) -> None:
        """One prediction for the day if anything known was observed, then the updates in order.

        Observations are (stream, value) or (stream, value, noise); a noise given replaces the stream's.
        """
        known = [x for x in observed if (x[0] in self.config.streams or x[0][1:] in _INDEX and x[0][0] == "@") and x[1] == x[1]]
        if not known and not self.config.every_day:
            return
        if self.step % 7 == 0:
            self._weekly()
        self.step += 1
        mu = self.bank.mu.copy()
        self.base.predict(float(mu @ [c.REGIME_Q[r] for r in c.REGIMES]) if self.config.regime_noise else 1.0)
        self.bank.predict()
        for key in c.SLOW_STREAMS if self.config.cumulate else ():
            if key in self.config.streams:  # the mean of what was predicted since the stream was last seen
                total = self.sums.setdefault(key, [0.0, 0])
                total[0] += float(vector(self.config.streams[key]) @ self.base.x)
                total[1] += 1
        for key, value, *given in known:
            own_h = self.branch_loadings(key) if self.config.regime_loadings else self.loadings(key)
            h = mu @ own_h if self.config.regime_loadings else own_h
            r = own_r = given[0] if given and given[0] is not None and given[0] == given[0] else None
            if r is None:
                r = own_r = self.noise(key)
                r = r * float(mu @ self.noise_scales(key)) if self.config.regime_noise else r
                own_r = own_r * self.noise_scales(key) if self.config.branch_noise else r
            before = self.base.x
            predicted = self.sums[key][0] / self.sums[key][1] if self.sums.get(key, (0, 0))[1] else float(h @ self.base.x)
            gap, s, gain = self.base.update(h, r, value - predicted + float(h @ self.base.x))
            self.ll += -0.5 * (np.log(2 * np.pi * s) + gap * gap / s)
            self.anomalies += abs(gap) / np.sqrt(s) > c.ANOMALY_THRESHOLD
            if self.config.gas:
                moved = (1 - c.GAS_BETA) * np.log(self.base_noise(key)) + c.GAS_BETA * self.log_r.setdefault(key, np.log(self.base_noise(key))) + c.GAS_ALPHA * (min(gap * gap / s, c.GAS_MAX_RATIO) - 1)
                self.log_r[key] = float(np.clip(moved, c.GAS_LOW, c.GAS_HIGH))
            self.bank.update(own_h, own_r, value)
            if key in self.sums:
                self.sums[key] = [0.0, 0]
            self.seen[key] = self.step
            self.n += 1
            if self.records is not None:
                self.records.append((self.step, self.n, key, value, predicted, gap, s, gap / float(np.sqrt(s)), gain.tolist(), before.tolist(), self.base.x.tolist(), self.bank.mu.tolist()))

    def state(self) -> str:
        """All that a later run needs to go on, as JSON; numbers come back exactly."""
        own = {k: getattr(self, k) for k in ("step", "n", "ll", "anomalies", "log_r", "seen", "sums", "streak")}
        bank = {"mu": self.bank.mu.tolist(), "n": self.bank.n, "tpm": self.bank.tpm.tolist(), "filters": [{"x": f.x.tolist(), "p": f.p.tolist()} for f in self.bank.filters]}
        return json.dumps(own | {"ll": float(self.ll), "anomalies": int(self.anomalies), "x": self.base.x.tolist(), "p": self.base.p.tolist(), "bank": bank})

    @staticmethod
    def resumed(config: Config, state: str | None) -> Replay:
        """An engine that goes on where the saved one stopped; without a state, a new one."""
        engine = Replay(config)
        if not state:
            return engine
        saved = json.loads(state)
        for k in ("step", "n", "ll", "anomalies", "log_r", "seen", "sums", "streak"):
            setattr(engine, k, saved.get(k, getattr(engine, k)))
        engine.base.x, engine.base.p = np.array(saved["x"]), np.array(saved["p"])
        bank = saved["bank"]
        engine.bank.mu, engine.bank.n, engine.bank.tpm = np.array(bank["mu"]), bank["n"], np.array(bank["tpm"])
        for flt, one in zip(engine.bank.filters, bank["filters"]):
            flt.x, flt.p = np.array(one["x"]), np.array(one["p"])
        return engine

    def row(self, entity: int, day: object) -> tuple:
        return entity, self.config.config_id, day, self.step, self.n, float(self.ll), int(self.anomalies), self.base.x.tolist(), self.bank.mu.tolist()


SUB_SCHEMA = "entity long, day date, regime string, sub_regime string, p double, joint double, active boolean, shadow_inflation double"


def sub_banks(config: Config) -> dict[str, Bank]:
    """For each regime a bank of its sub-regimes, whose shifts come on top of the regime's."""
    both = lambda r, d: {k: c.REGIME_ADJUSTMENTS[r].get(k, 0.0) + d.get(k, 0.0) for k in c.FACTORS}
    return {r: Bank(config, [Branch(k, both(r, d)) for k, d in subs.items()], c.SUB_TRANSITIONS[r], c.SUB_FLOOR) for r, subs in c.SUB_REGIMES.items()}


def nested(obs: DataFrame) -> DataFrame:
    """The plain form of `lockstep.nested`, one entity at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        config = Config()
        engine, banks = Replay(config), sub_banks(config)
        shadows = {r: Filter.fresh(config, vector(c.REGIME_ADJUSTMENTS[r])) for r in c.REGIMES}
        days = list(in_days(pdf))
        for _, observed in days:
            known = [(key, z) for key, z in observed if key in config.streams and z == z]
            engine.day(observed)
            for follower in (*banks.values(), *shadows.values()) if known else ():
                follower.predict()
                for key, z in known:
                    follower.update(vector(config.streams[key]), engine.base_noise(key), z)
        rows = []
        for k, regime in enumerate(c.REGIMES):
            up = float(engine.bank.mu[k])
            for name, p in zip(c.SUB_REGIMES[regime], banks[regime].mu):
                rows.append((int(pdf["entity"].iloc[0]), days[-1][0], regime, name, float(p), round(up * float(p), 4), up >= c.ACTIVE_AT, float(shadows[regime].x[0])))
        return pd.DataFrame(rows, columns=_columns(SUB_SCHEMA))

    return obs.select("entity", "day", "ord", "stream_key", "z").groupBy("entity").applyInPandas(run, SUB_SCHEMA)


def configs(rows: list[dict]) -> dict[str, Config]:
    return {r["config_id"]: replace(Config(), **r) for r in rows}


def in_days(pdf: pd.DataFrame) -> Iterator[tuple[object, list[tuple]]]:
    """(day, its observations in order) of one entity; a column r holds noises of their own."""
    pdf = pdf.sort_values(["day", "ord"], kind="stable")
    days = pdf["day"].to_numpy()
    columns = [pdf["stream_key"].tolist(), pdf["z"].tolist()] + ([pdf["r"].tolist()] if "r" in pdf else [])
    rows = list(zip(*columns))
    cuts = [0, *(np.flatnonzero(days[1:] != days[:-1]) + 1).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield days[a], rows[a:b]


def _observations(obs: DataFrame) -> DataFrame:
    return obs.select("entity", "day", "ord", "stream_key", "z", *[x for x in ("r",) if x in obs.columns])


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def replay(obs: DataFrame, variants: dict[str, Config], every: int = 7) -> DataFrame:
    """The plain form of `lockstep.replay`, one entity at a time. Runs every variant over every entity's (entity, day, ord, stream_key, z[, r]), a snapshot every so many steps and at the end.

    An entity is a task's group, sorted once for all variants; its observations are taken in the order of day and ord.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entity, days, rows = int(pdf["entity"].iloc[0]), list(in_days(pdf)), []
        for config in variants.values():
            engine, last = Replay(config), -1
            for day, observed in days:
                engine.day(observed)
                if engine.step and (engine.step - 1) % every == 0 and engine.step != last:
                    rows.append(engine.row(entity, day))
                    last = engine.step
            if engine.step and last != engine.step:
                rows.append(engine.row(entity, days[-1][0]))
        return pd.DataFrame(rows, columns=_columns(STATE_SCHEMA))

    return _observations(obs).groupBy("entity").applyInPandas(run, STATE_SCHEMA)


UPDATE_SCHEMA = "entity long, config_id string, day date, step int, n long, stream_key string, observed double, predicted double, innovation double, s double, z double, gain array<double>, before array<double>, after array<double>, probabilities array<double>"


def updates(obs: DataFrame, variants: dict[str, Config]) -> DataFrame:
    """The plain form of `lockstep.updates`, one entity at a time. A record of every measurement update: what was observed and predicted, the innovation with its variance, gain, state before and after, probabilities."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entity, days, rows = int(pdf["entity"].iloc[0]), list(in_days(pdf)), []
        for name, config in variants.items():
            engine = Replay(config)
            for day, observed in days:
                engine.records = []
                engine.day(observed)
                rows += [(entity, name, day, *x) for x in engine.records]
        return pd.DataFrame(rows, columns=_columns(UPDATE_SCHEMA))

    return _observations(obs).groupBy("entity").applyInPandas(run, UPDATE_SCHEMA)


CHECKPOINT_SCHEMA = "entity long, config_id string, step int, engine string"


def checkpoints(obs: DataFrame, variants: dict[str, Config], saved: DataFrame | None = None) -> DataFrame:
    """(entity, config_id, step, engine) at the end of obs; engines saved before go on from their states, others start anew.

    Taking a table in parts, each from the checkpoints of the one before, ends where one run over all of it does.
    """
    saved = saved if saved is not None else obs.sparkSession.createDataFrame([], CHECKPOINT_SCHEMA)

    def run(key: tuple, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        old, rows, days = dict(zip(states["config_id"], states["engine"])), [], list(in_days(pdf))
        for name, config in variants.items():
            engine = Replay.resumed(config, old.get(name))
            for _, observed in days:
                engine.day(observed)
            rows.append((int(key[0]), name, engine.step, engine.state()))
        return pd.DataFrame(rows, columns=_columns(CHECKPOINT_SCHEMA))

    return _observations(obs).groupBy("entity").cogroup(saved.groupBy("entity")).applyInPandas(run, CHECKPOINT_SCHEMA)


def pseudo_observations(signals: DataFrame) -> DataFrame:
    """Qualitative signals (entity, day, kind, factor, direction, magnitude, confidence, age_hours) as observations of single factors.

    The value is direction, size and confidence multiplied, the noise doubles with every half-life of age.  Signals older
    than five half-lives are left out.
    """
    size = lambda i: F.create_map(*[x for k, v in c.SIGNAL_SIZES.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("magnitude")]
    half_life = F.create_map(*[x for k, v in c.SIGNAL_HALF_LIVES.items() for x in (F.lit(k), F.lit(24.0 * v))])[F.col("kind")]
    rows = signals.withColumn("ages", F.col("age_hours") / half_life).where("ages <= 5")
    return rows.select("entity", "day", F.lit(1_000).alias("ord"), F.concat(F.lit("@"), "factor").alias("stream_key"), (F.col("direction") * size(1) * F.col("confidence")).alias("z"), (size(0) * F.pow(F.lit(2.0), F.col("ages"))).alias("r"))


#: The perturbations of the sensitivity sweep: shifts, persistence, noise and chance to stay.
SWEEP = [
    *[{"config_id": f"shift_x{k}", "shift_scale": k} for k in (0.5, 0.7, 1.0, 1.5, 2.0)],
    {"config_id": "persistence_-0.03", "persistence_change": -0.03}, {"config_id": "persistence_+0.03", "persistence_change": 0.03},
    *[{"config_id": f"noise_x{k}", "r_scale": k} for k in (0.5, 1.5, 2.0)],
    {"config_id": "stay_-0.02", "stay_change": -0.02}, {"config_id": "stay_+0.02", "stay_change": 0.02},
]
