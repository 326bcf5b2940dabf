"""Gradient-boosted trees with logistic loss over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_BINS = 24


@dataclass
class Boosted:
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin bound and leaf value of a full binary tree
    depth: int
    bias: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, bound, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > bound[at])
            out += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 5, rate: float = 0.25, l2: float = 5.0, columns: float = 0.5, seed: int = 1) -> Boosted:
    """Each tree sees a random half of the features, so that no single sign carries the model."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, MOST_BINS)[1:-1])) if len(np.unique(v)) > 2 else np.unique(v)[:1] for v in x.T]
    binned = _binned(x, edges).astype(np.int64)
    share = float(np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99))
    model = Boosted(edges, [], depth, float(np.log(share / (1 - share))))
    score = np.full(len(x), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, bound = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, MOST_BINS, np.int64)
        allowed = np.flatnonzero(rng.random(x.shape[1]) < columns)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            gain = np.full((width, len(allowed), MOST_BINS), -np.inf)
            for j, f in enumerate(allowed):
                cell = (at - base) * MOST_BINS + binned[:, f]
                gl = np.bincount(cell, weights=g, minlength=width * MOST_BINS).reshape(width, -1).cumsum(axis=1)
                hl = np.bincount(cell, weights=h, minlength=width * MOST_BINS).reshape(width, -1).cumsum(axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain[:, j] = np.where((hl > 1) & (ha - hl > 1), gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2), -np.inf)
            flat = gain.reshape(width, -1)
            top = flat.argmax(axis=1)
            good = flat[np.arange(width), top] > 1e-3
            feature[base : base + width] = np.where(good, allowed[top // MOST_BINS], 0)
            bound[base : base + width] = np.where(good, top % MOST_BINS, MOST_BINS)
            at = 2 * at + 1 + (binned[np.arange(len(x)), feature[at]] > bound[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + l2)
        model.trees.append((feature, bound, value))
        score += value[leaf]
    return model
