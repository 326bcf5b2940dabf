"""Scaled hidden-Markov recursions in numpy, over blocks of token-class sequences.

A model has states K, classes M: `start` (K), the distribution before the first token, `move` (K, K) and `emit` (K, M).
Every token is one step v <- (v @ move) * emit[:, class], so any piece of a sequence is a K x K matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sequences of more than LONG tokens are taken in pieces of PIECE tokens, with exact messages at their borders.
PIECE = 64
LONG = 512


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass
class Counts:
    """Expected counts of one or more blocks and the log10 likelihood of their sequences; they add up."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log10: float = 0.0

    @staticmethod
    def zero(states: int, classes: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.move.ravel(), self.emit.ravel(), [self.log10]])

    @staticmethod
    def of(flat: np.ndarray, states: int, classes: int) -> Counts:
        a, b = states * (states + 1), states * (states + 1 + classes)
        return Counts(flat[:states], flat[states:a].reshape(states, states), flat[a:b].reshape(states, classes), float(flat[b]))


def initial(unigram: np.ndarray, states: int, seed: int = 11) -> Model:
    """States that differ from the class unigram by a seeded factor, and mostly stay."""
    rng = np.random.default_rng(seed)
    emit = unigram * np.exp(0.7 * rng.standard_normal((states, len(unigram))))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def maximised(counts: Counts, unigram: np.ndarray, prior: float = 50.0) -> Model:
    """The M step; each state's emissions are smoothed towards the class unigram, so that no class has none."""
    emit = counts.emit + prior * unigram
    move = counts.move + 0.1
    start = counts.start + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


@dataclass
class Pieces:
    """Consecutive pieces of sequences, longest first: their sequence, place in it, and tokens [begin, end)."""

    owner: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def active(self) -> np.ndarray:
        """How many pieces are longer than t, for each t; they come first."""
        size = self.end - self.begin
        return np.searchsorted(-size, -np.arange(int(size.max()) if len(size) else 0), side="left")

    def rows(self, keep: np.ndarray) -> Pieces:
        return Pieces(self.owner[keep], self.place[keep], self.begin[keep], self.end[keep])


def cut(first: np.ndarray) -> Pieces:
    """Sequences up to LONG tokens whole, longer ones in pieces of PIECE."""
    n = np.diff(first)
    length = np.where(n > LONG, PIECE, np.maximum(n, 1))
    pieces = -(-n // length)
    owner = np.repeat(np.arange(len(n)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][owner] + place * length[owner]
    end = np.minimum(begin + length[owner], first[1:][owner])
    order = np.argsort(begin - end, kind="stable")
    return Pieces(owner[order], place[order], begin[order], end[order])


def products(model: Model, classes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of each piece, scaled to a sum of one, and the log10 of what was scaled away: the recursion, bracketed otherwise."""
    k, emit, move = len(model.start), model.emit.T, model.move
    m = np.broadcast_to(np.eye(k, dtype=move.dtype), (len(pieces.begin), k, k)).copy()
    logs = np.zeros(len(m))
    for t, n in enumerate(pieces.active):
        m[:n] = (m[:n].reshape(-1, k) @ move).reshape(-1, k, k) * emit[classes[pieces.begin[:n] + t]][:, None, :]
        s = m[:n].sum(axis=(1, 2))
        m[:n] /= s[:, None, None]
        logs[:n] += np.log10(s)
    return m, logs


def border_messages(model: Model, pieces: Pieces, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state distribution before each piece, backward message after it, log10 of the scale of its forward step), from the pieces' matrices.

    One step goes over all sequences at once: first all first pieces, then all second ones.
    """
    before, after, logs = np.empty(m.shape[:2], m.dtype), np.ones(m.shape[:2], m.dtype), np.zeros(len(m))
    order = np.lexsort((pieces.owner, pieces.place))
    place = pieces.place[order]
    steps = [order[a:b] for a, b in zip(np.searchsorted(place, np.arange(place.max() + 1)), np.searchsorted(place, np.arange(place.max() + 1), side="right"))] if len(m) else []
    at = np.full(int(pieces.owner.max()) + 1, -1) if len(m) else None
    now = None
    for own in steps:
        v = np.broadcast_to(model.start, (len(own), m.shape[1])) if now is None else now[at[pieces.owner[own]]]
        before[own] = v
        now = np.einsum("ni,nij->nj", v, m[own])
        s = now.sum(axis=1)
        now, logs[own] = now / s[:, None], np.log10(s)
        at[pieces.owner[own]] = np.arange(len(own))
    for own, following in zip(steps[-2::-1], steps[:0:-1]):
        back = np.einsum("nij,nj->ni", m[following], after[following])
        back /= back.sum(axis=1)[:, None]
        at[pieces.owner[following]] = np.arange(len(following))
        has = np.isin(pieces.owner[own], pieces.owner[following], assume_unique=True)
        after[own[has]] = back[at[pieces.owner[own[has]]]]
    return before, after, logs


def expect(model: Model, classes: np.ndarray, first: np.ndarray, into: Counts) -> None:
    """Adds the expected counts of whole sequences.

    Pieces of long sequences start from the forward message at their border and end in the backward one, so every
    transition counts and only a sequence's own beginning counts as a start.
    """
    pieces = cut(first)
    if not len(pieces.begin):
        return
    model = Model(model.start.astype(np.float32), model.move.astype(np.float32), model.emit.astype(np.float32))
    states, active = len(model.start), pieces.active
    before = np.broadcast_to(model.start, (len(pieces.begin), states)).copy()
    after = np.ones((len(pieces.begin), states), np.float32)
    long = np.flatnonzero(np.diff(first)[pieces.owner] > LONG)
    if len(long):
        some = pieces.rows(long)
        before[long], after[long], _ = border_messages(model, some, products(model, classes, some)[0])
    offset = np.concatenate(([0], np.cumsum(active)))
    emit, forward, scale = model.emit.T, np.empty((offset[-1], states), np.float32), np.empty(offset[-1], np.float32)
    at = np.concatenate([pieces.begin[:n] + t for t, n in enumerate(active)])
    v = before
    for t, n in enumerate(active):
        v = (v[:n] @ model.move) * emit[classes[at[offset[t] : offset[t + 1]]]]
        s = v.sum(axis=1)
        v = v / s[:, None]
        forward[offset[t] : offset[t + 1]], scale[offset[t] : offset[t + 1]] = v, s
    into.log10 += float(np.log10(scale, dtype=np.float64).sum())
    last = offset[pieces.end - pieces.begin - 1] + np.arange(len(pieces.begin))
    backward = after / np.maximum((forward[last] * after).sum(axis=1), 1e-30)[:, None]
    moved = np.zeros((states, states))
    for t in range(len(active) - 1, -1, -1):
        n, own = active[t], slice(offset[t], offset[t + 1])
        ahead = emit[classes[at[own]]] * backward[:n] / scale[own, None]
        earlier = forward[offset[t - 1] : offset[t - 1] + n] if t else before[:n]
        moved += earlier.T.astype(np.float64) @ ahead
        forward[own] *= backward[:n]
        backward[:n] = ahead @ model.move.T
    begins = pieces.place == 0
    into.start += (before[begins] * backward[begins]).sum(axis=0)
    into.move += moved * model.move
    for k in range(states):
        into.emit[k] += np.bincount(classes[at], weights=forward[:, k], minlength=into.emit.shape[1])


def log10_likelihoods(model: Model, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The exact log10 likelihood of each whole sequence, by scaled forward recursion; pieces of long ones run side by side."""
    pieces = cut(first)
    out = np.zeros(len(first) - 1)
    long = np.diff(first)[pieces.owner] > LONG
    short = pieces.rows(np.flatnonzero(~long))
    emit, v = model.emit.T, np.broadcast_to(model.start, (len(short.begin), len(model.start)))
    for t, n in enumerate(short.active):
        v = (v[:n] @ model.move) * emit[classes[short.begin[:n] + t]]
        s = v.sum(axis=1)
        v = v / s[:, None]
        out[short.owner[:n]] += np.log10(s)
    if long.any():
        some = pieces.rows(np.flatnonzero(long))
        m, logs = products(model, classes, some)
        _, _, steps = border_messages(model, some, m)
        np.add.at(out, some.owner, logs + steps)
    return out
