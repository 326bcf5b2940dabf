"""Ordered folds over ranges of a series, so that one long series is the work of many tasks.

A fold moves a state along the observations of a series.  Rows are cut into ranges of their order; every range is first
summed up by what it does to any state that could come in (`summary`), the few summaries of a series are applied one
after another, which gives each range its start, and then all ranges are replayed at once.  Summaries are small: an
affine map of the mean with a quadratic one of the variance, a clipped affine map, a table over the states of an
automaton, or the ends of the few chains that a range allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_ROWS = 1 << 20
State = tuple[float, ...]


class Fold(Protocol):
    columns: tuple[str, ...]
    outputs: tuple[str, ...]

    def start(self) -> State: ...
    def summary(self, columns: list[np.ndarray]) -> list[float]: ...
    def moved(self, summary: np.ndarray, state: State) -> State: ...
    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]: ...


@dataclass(frozen=True)
class Normaliser:
    """Each value against the mean and deviation before it, which then move towards it by the share a.

    The variance takes in the squared step from the old mean, or with rolling the one from the new mean.  A missing value
    moves nothing and has no z.
    """

    x: str
    a: float
    mean: float
    var: float
    floor: float = 0.01
    rolling: bool = False
    outputs = ("m", "v", "z")

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.x,)

    def start(self) -> State:
        return self.mean, self.var

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """m = p * m0 + q and v = k * v0 + c2 * m0**2 + c1 * m0 + c0 after the range."""
        a, keep = self.a, 1 - self.a
        p, q, k, c2, c1, c0 = 1.0, 0.0, 1.0, 0.0, 0.0, 0.0
        for x in columns[0].tolist():
            if x != x:
                continue
            d = x - q
            if self.rolling:
                p, q = keep * p, q + a * d
                d = x - q
                k, c2, c1, c0 = keep * k, keep * c2 + a * p * p, keep * c1 - 2 * a * p * d, keep * c0 + a * d * d
            else:
                k, c2, c1, c0 = keep * k, keep * (c2 + a * p * p), keep * (c1 - 2 * a * p * d), keep * (c0 + a * d * d)
                p, q = keep * p, q + a * d
        return [p, q, k, c2, c1, c0]

    def moved(self, summary: np.ndarray, state: State) -> State:
        p, q, k, c2, c1, c0 = summary
        m, v = state
        return float(p * m + q), float(k * v + c2 * m * m + c1 * m + c0)

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        (m, v), a, keep, floor = state, self.a, 1 - self.a, self.floor
        ms, vs, zs = [], [], []
        for x in columns[0].tolist():
            if x == x:
                d = x - m
                zs.append(d / max(math.sqrt(v), floor))
                m += a * d
                v = keep * v + a * (x - m) ** 2 if self.rolling else keep * (v + a * d * d)
            else:
                zs.append(math.nan)
            ms.append(m)
            vs.append(v)
        return [ms, vs, zs], (m, v)


@dataclass(frozen=True)
class ClippedNoise:
    """Score-driven log noise: r' = clip((1 - beta) r0 + beta r + a (min(ratio, most) - 1), low, high)."""

    ratio: str
    r0: float
    beta: float
    a: float
    most: float
    low: float
    high: float
    outputs = ("log_r",)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.ratio,)

    def start(self) -> State:
        return (self.r0,)

    def _steps(self, columns: list[np.ndarray]) -> list[float]:
        x = columns[0]
        return ((1 - self.beta) * self.r0 + self.a * (np.minimum(x[~np.isnan(x)], self.most) - 1)).tolist()

    def _clip(self, r: float) -> float:
        return min(max(r, self.low), self.high)

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """clip(p * r + q, low, high): such maps are closed under composition."""
        p, q, low, high = 1.0, 0.0, -math.inf, math.inf
        for u in self._steps(columns):
            p, q, low, high = self.beta * p, self.beta * q + u, self._clip(self.beta * low + u), self._clip(self.beta * high + u)
        return [p, q, low, high]

    def moved(self, summary: np.ndarray, state: State) -> State:
        p, q, low, high = summary
        return (float(min(max(p * state[0] + q, low), high)),)

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        r, out = state[0], []
        for x in columns[0].tolist():
            if x == x:
                r = self._clip((1 - self.beta) * self.r0 + self.beta * r + self.a * (min(x, self.most) - 1))
            out.append(r)
        return [out], (r,)


@dataclass(frozen=True)
class Cooldown:
    """Which times are let through: those at least `wait` after the last that was; wait is constant in a series."""

    at: str
    wait: str
    outputs = ("ok",)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.at, self.wait

    def start(self) -> State:
        return (math.nan,)

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """The last time let through, by the time from which one may be: a step function of few steps, as chains soon meet."""
        at, wait = columns[0], float(columns[1][0])
        following = np.maximum(np.searchsorted(at, at + wait), np.arange(1, len(at) + 1))
        last = at.copy()
        for i in range(len(at) - 1, -1, -1):
            if following[i] < len(at):
                last[i] = last[following[i]]
        reach = min(int(np.searchsorted(at, at[0] + wait)) + 1, len(at))
        ends = np.append(np.flatnonzero(np.diff(last[:reach])), reach - 1)
        return [wait, *at[ends], *last[ends]]

    def moved(self, summary: np.ndarray, state: State) -> State:
        wait, steps = summary[0], summary[1:].reshape(2, -1)
        i = 0 if state[0] != state[0] else int(np.searchsorted(steps[0], state[0] + wait))
        return (float(steps[1][i]),) if i < steps.shape[1] else state

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        last, out = state[0], []
        for at, wait in zip(columns[0].tolist(), columns[1].tolist()):
            ok = not at - last < wait
            last = at if ok else last
            out.append(float(ok))
        return [out], (last,)


@dataclass(frozen=True)
class Novelty:
    """Which values differ by more than `least`, relative to the larger of the two, from the last that did; the first does, missing ones don't."""

    x: str
    least: float
    outputs = ("ok",)

    def __post_init__(self) -> None:
        if not 0 <= self.least < 1:
            raise ValueError("least is a share of at least 0 and under 1")

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.x,)

    def start(self) -> State:
        return (math.nan,)

    def _new(self, last: float, x: np.ndarray) -> np.ndarray:
        return np.abs(x - last) / np.maximum(np.maximum(abs(last), np.abs(x)), 1e-10) > self.least

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """(value, last value accepted from there on) of the rows that may be the first accepted one.

        What isn't accepted lies around the last value, so the first row outside is the highest or the lowest so far.
        """
        x = columns[0][~np.isnan(columns[0])]
        if not len(x):
            return []
        above = np.append(True, x[1:] > np.maximum.accumulate(x)[:-1])
        below = np.append(True, x[1:] < np.minimum.accumulate(x)[:-1])
        end: dict[int, int] = {}
        firsts = np.flatnonzero(above | below).tolist()
        for i in firsts:
            chain = []
            while i not in end:
                chain.append(i)
                following = self._next(x, i)
                if following < 0:
                    end[i] = i
                else:
                    i = following
            for j in chain:
                end[j] = end[i]
        return [v for i in firsts for v in (float(x[i]), float(x[end[i]]))]

    def _next(self, x: np.ndarray, i: int) -> int:
        width, lo = 64, i + 1
        while lo < len(x):
            hit = np.flatnonzero(self._new(float(x[i]), x[lo : lo + width]))
            if len(hit):
                return lo + int(hit[0])
            lo, width = lo + width, width * 2
        return -1

    def moved(self, summary: np.ndarray, state: State) -> State:
        pairs = summary.reshape(-1, 2)
        hit = np.flatnonzero(self._new(state[0], pairs[:, 0])) if state[0] == state[0] else np.arange(len(pairs))
        return (float(pairs[hit[0], 1]),) if len(hit) else state

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        last, out = state[0], []
        for x in columns[0].tolist():
            ok = x == x and (last != last or abs(x - last) / max(abs(last), abs(x), 1e-10) > self.least)
            last = x if ok else last
            out.append(float(ok))
        return [out], (last,)


@dataclass(frozen=True)
class Streak:
    """Fires at every `length`-th row in a row whose size is over the bound, and counts anew."""

    x: str
    bound: float
    length: int
    outputs = ("fired",)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.x,)

    def start(self) -> State:
        return (0.0,)

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """The run after the range; where no row breaks it, the rows to be added to the run before."""
        breaks = np.flatnonzero(~(np.abs(columns[0]) > self.bound))
        n = len(columns[0])
        return [float(len(breaks) > 0), float((n - 1 - breaks[-1]) % self.length if len(breaks) else n % self.length)]

    def moved(self, summary: np.ndarray, state: State) -> State:
        return (float(summary[1] if summary[0] else (state[0] + summary[1]) % self.length),)

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        run, out = int(state[0]), []
        for large in (np.abs(columns[0]) > self.bound).tolist():
            run = run + 1 if large else 0
            out.append(float(run == self.length))
            run %= self.length
        return [out], (float(run),)


@dataclass(frozen=True)
class Approach:
    """Fires at the `length`-th fall in a row that comes within `near` of the bound from above, and counts anew."""

    p: str
    bound: float
    near: float
    length: int
    outputs = ("fired",)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.p,)

    def start(self) -> State:
        return math.nan, 0.0

    def _falls(self, before: float, p: np.ndarray) -> np.ndarray:
        return (p < np.append(before, p[:-1])) & (p > self.bound) & (p - self.bound < self.near)

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """First and last value, and `Streak`'s two numbers of the rows after the first."""
        p = columns[0]
        return [float(p[0]), float(p[-1]), *Streak("", 0.5, self.length).summary([self._falls(math.nan, p)[1:].astype(float)])]

    def moved(self, summary: np.ndarray, state: State) -> State:
        fell = bool(self._falls(state[0], summary[:1])[0])
        run = (state[1] + 1) % self.length if fell else 0.0
        return float(summary[1]), Streak("", 0.5, self.length).moved(summary[2:], (run,))[0]

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        fired, run = Streak("", 0.5, self.length).replay((state[1],), [self._falls(state[0], columns[0]).astype(float)])
        return fired, (float(columns[0][-1]), run[0])


@dataclass(frozen=True)
class Sticky:
    """Shares times what a transition matrix carries over from the shares before, scaled to one; the first row is scaled alone."""

    shares: tuple[str, ...]
    tpm: tuple[tuple[float, ...], ...]
    name: str = "smoothed"

    @property
    def columns(self) -> tuple[str, ...]:
        return self.shares

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(f"{self.name}_{s}" for s in self.shares)

    def start(self) -> State:
        return (math.nan,) * len(self.shares)

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """The product of the rows' matrices, scaled, and what the range gives without shares before it."""
        product, tpm = np.eye(len(self.shares)), np.array(self.tpm)
        rows = np.column_stack(columns)
        alone = self.replay(self.start(), columns)[1]
        for row in rows:
            product = product @ (tpm * row)
            size = product.sum()
            if not size > 1e-15:
                return [0.0, *np.zeros(product.size), *alone]
            product /= size
        return [1.0, *product.ravel(), *alone]

    def moved(self, summary: np.ndarray, state: State) -> State:
        k = len(self.shares)
        if state[0] != state[0] or not summary[0]:
            return tuple(summary[-k:].tolist())
        out = np.array(state) @ summary[1:-k].reshape(k, k)
        return tuple((out / out.sum()).tolist()) if out.sum() > 0 else tuple(summary[-k:].tolist())

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        s, tpm = np.array(state), np.array(self.tpm)
        out = []
        for row in np.column_stack(columns):
            weight = row if np.isnan(s[0]) else (s @ tpm) * row
            total = weight.sum()
            s = weight / total if total > 1e-15 else row
            out.append(s.tolist())
        return [list(c) for c in zip(*out)], tuple(s.tolist())


@dataclass(frozen=True)
class Together:
    """Several folds in one pass over the rows, each with its own state and outputs."""

    folds: tuple[Fold, ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for f in self.folds for c in f.columns))

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(o for f in self.folds for o in f.outputs)

    def _of(self, fold: Fold, columns: list[np.ndarray]) -> list[np.ndarray]:
        at = {c: i for i, c in enumerate(self.columns)}
        return [columns[at[c]] for c in fold.columns]

    def _states(self, state: State) -> list[State]:
        edges = np.cumsum([0, *(len(f.start()) for f in self.folds)]).tolist()
        return [state[a:b] for a, b in zip(edges, edges[1:])]

    def start(self) -> State:
        return tuple(x for f in self.folds for x in f.start())

    def summary(self, columns: list[np.ndarray]) -> list[float]:
        """The lengths of the summaries, then the summaries."""
        each = [f.summary(self._of(f, columns)) for f in self.folds]
        return [*map(float, map(len, each)), *(x for s in each for x in s)]

    def moved(self, summary: np.ndarray, state: State) -> State:
        k = len(self.folds)
        edges = np.cumsum([k, *summary[:k]]).astype(int).tolist()
        return tuple(x for f, s, a, b in zip(self.folds, self._states(state), edges, edges[1:]) for x in f.moved(summary[a:b], s))

    def replay(self, state: State, columns: list[np.ndarray]) -> tuple[list[list[float]], State]:
        out, after = [], []
        for fold, own in zip(self.folds, self._states(state)):
            values, moved = fold.replay(own, self._of(fold, columns))
            out += values
            after += moved
        return out, tuple(after)


def _position(order: str, df: DataFrame) -> Column:
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def _cut(df: DataFrame, keys: list[str], order: list[str], columns: tuple[str, ...], range_rows: int) -> tuple[DataFrame, int]:
    """Rows with __part, the range of their first order column, sorted within tasks of one range of a series; and how many ranges there are.

    Ranges are equally wide and hold `range_rows` rows of all series on average.
    """
    spark = df.sparkSession
    rows = df.select(*keys, *order, *[F.col(c).cast("double").alias(c) for c in columns if c not in order])
    where = _position(order[0], df)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("low"), F.max(where).alias("high")).first()
    parts = max(1, row["n"] // range_rows) if row["low"] is not None and row["high"] > row["low"] else 1
    part = F.lit(0)
    if parts > 1:
        part = F.coalesce(F.least(F.floor((where - row["low"]) / ((row["high"] - row["low"]) / parts)), F.lit(parts - 1)), F.lit(0)).cast("int")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__part", part).repartition(tasks, *keys, "__part")
    return rows.sortWithinPartitions(*keys, "__part", *order), parts


def _segments(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _numbers(batch: pa.RecordBatch, columns: tuple[str, ...]) -> list[np.ndarray]:
    return [pc.fill_null(batch.column(c).cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False) for c in columns]


def _values(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _summaries(rows: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """(keys, __part, n, summary) of each range of a series."""
    by = [*keys, "__part"]
    schema = T.StructType([*_key_fields(rows, by), T.StructField("n", T.LongType()), T.StructField("summary", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        heads: pa.RecordBatch | None = None

        done: list[tuple[pa.RecordBatch, int, list[float]]] = []

        def close() -> None:
            columns = [np.concatenate(c) for c in zip(*held)]
            done.append((heads.select(by), len(columns[0]), fold.summary(columns)))

        def rows_done() -> pa.RecordBatch:
            keyed = pa.Table.from_batches([h for h, _, _ in done]).combine_chunks().to_batches()[0]
            new = [pa.array([n for _, n, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.list_(pa.float64()))]
            done.clear()
            return pa.RecordBatch.from_arrays([keyed.column(k) for k in by] + new, names=[*by, "n", "summary"])

        for batch in batches:
            numbers, starts = _numbers(batch, fold.columns), _segments(batch, by)
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
                if not (held and _values(heads, by, 0) == _values(batch, by, lo)):
                    if held:
                        close()
                    held, heads = [], batch.slice(lo, 1)
                held.append([c[lo:hi] for c in numbers])
            if done:
                yield rows_done()
        if held:
            close()
            yield rows_done()

    return rows.mapInArrow(run, schema)


def _along(summaries: DataFrame, keys: list[str], fold: Fold, last: bool) -> DataFrame:
    """(keys, __part, __start): the state before each range; or with last (keys, n, __state), the one after the last. A row for each range of a series."""
    by = keys if last else [*keys, "__part"]
    numbers = T.ArrayType(T.DoubleType())
    added = [T.StructField("n", T.LongType()), T.StructField("__state", numbers)] if last else [T.StructField("__start", numbers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, head, state, n = None, None, fold.start(), 0
        for batch in batches:
            heads, values, sizes, found = [], batch.column("summary").to_pylist(), batch.column("n").to_pylist(), []
            keyed = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for i, key in enumerate(keyed):
                if key != open_key:
                    if last and open_key is not None:
                        heads.append(head)
                        found.append((n, list(state)))
                    open_key, head, state, n = key, batch.slice(i, 1).select(keys), fold.start(), 0
                if not last:
                    found.append(list(state))
                state, n = fold.moved(np.array(values[i], float), state), n + sizes[i]
            if last and found:
                yield done(heads, found)
            elif not last:
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in by] + [pa.array(found, pa.list_(pa.float64()))], names=[*by, "__start"])
        if last and open_key is not None:
            yield done([head], [(n, list(state))])

    def done(heads: list[pa.RecordBatch], found: list[tuple[int, list[float]]]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
        new = [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([rows.column(k) for k in keys] + new, names=[*keys, "n", "__state"])

    tasks = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = summaries.repartition(tasks, *keys).sortWithinPartitions(*keys, "__part")
    return ordered.mapInArrow(run, T.StructType([*_key_fields(summaries, by), *added]))


def scan(df: DataFrame, keys: list[str], order: list[str], fold: Fold, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, order, the fold's columns, its outputs) of every row; an output without a number is null.

    Rows that tie in all of `order` follow one another in either order.  A null key is a series of its own, null comes
    first in the order, an empty table gives no rows.
    """
    rows, parts = _cut(df, keys, order, fold.columns, range_rows)
    by = [*keys, "__part"]
    if parts > 1:
        starts = _along(_summaries(rows, keys, fold), keys, fold, last=False)
        starts = starts.select(*[F.col(k).alias(f"__of_{k}") for k in by], "__start")
        rows = rows.join(starts, [rows[k].eqNullSafe(starts[f"__of_{k}"]) for k in by], "left").drop(*[f"__of_{k}" for k in by])
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *order)
    kept = list(dict.fromkeys([*keys, *order, *fold.columns]))
    schema = T.StructType([*_key_fields(rows, kept), *[T.StructField(o, T.DoubleType()) for o in fold.outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        state = fold.start()
        for batch in batches:
            numbers, heads = _numbers(batch, fold.columns), _segments(batch, by)
            out: list[list[float]] = [[] for _ in fold.outputs]
            for lo, hi in zip(heads, np.append(heads[1:], batch.num_rows)):
                key = _values(batch, by, lo)
                if key != open_key:
                    given = batch.column("__start")[lo].as_py() if parts > 1 else None
                    open_key, state = key, tuple(given) if given else fold.start()
                new, state = fold.replay(state, [c[lo:hi] for c in numbers])
                for column, values in zip(out, new):
                    column += values
            arrays = [pa.array(np.array(v, float), pa.float64(), from_pandas=True) for v in out]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + arrays, names=[*kept, *fold.outputs])

    return rows.mapInArrow(run, schema)


def last(df: DataFrame, keys: list[str], order: list[str], fold: Fold, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, n, __state): how many rows each series has and the state after the last; nothing is replayed."""
    rows, _ = _cut(df, keys, order, fold.columns, range_rows)
    return _along(_summaries(rows, keys, fold), keys, fold, last=True)
