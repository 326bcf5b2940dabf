"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word vector beside the mean of its hashed character trigrams; both depend on the word alone,
so a block's distinct words are embedded and projected once.  A text's windows are scored side by side.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from tidemark.llm.tokens import Words, mix

WINDOW, STRIDE = 48, 24
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 1 << 13, 1 << 13, 8, 8
#: Share of words whose word vector is left out in a training step, and the pull of the tables towards zero, to be divided by the square of how many texts the rarer label has.
WORD_DROP, DECAY = 0.3, 67.0
#: Table rows that fewer training texts reach stay zero, so that no text is learnt by heart from its own rare words.
LEAST_TEXTS = 3
#: Signed root of a likelihood ratio that a row reaches by chance.
BY_CHANCE = 2.5
#: Share of the training texts that only tell when to stop, and how many steps pass between two looks at them.
WATCHED, LOOK = 0.15, 20
#: Weight of a step in the running mean of the parameters.
AVERAGED = 0.02
_CLOSE = np.uint64(0x100)


@dataclass
class Vocabulary:
    """The distinct words of a block: table rows of each word and of its character trigrams."""

    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray


@dataclass
class Network:
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (s * rng.standard_normal(shape)).astype(np.float32)
        p = {"words": draw(WORD_ROWS, WIDTH, s=0.02), "grams": draw(GRAM_ROWS, WIDTH, s=0.1)}
        for side in "fb":
            p |= {f"w{side}": draw(2 * WIDTH, 3 * HIDDEN, s=0.4), f"u{side}": draw(HIDDEN, 3 * HIDDEN, s=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(p | {"v": draw(2 * HIDDEN, s=0.3), "o": draw(2 * HIDDEN, s=0.3), "d": np.zeros(1, np.float32)})


def vocabulary(words: Words) -> tuple[Vocabulary, np.ndarray]:
    """The block's distinct lower-cased words, and each word's number among them."""
    hashes = words.hashes(lower=True)
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    starts, size = words.starts[at], words.ends[at] - words.starts[at]
    first = np.concatenate(([0], np.cumsum(size)))
    pos = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(starts, size)
    data = words.data[pos].astype(np.uint64) if len(pos) else np.zeros(0, np.uint64)
    data = np.where((data >= 65) & (data <= 90), data + np.uint64(32), data)
    before, after = np.roll(data, 1), np.roll(data, -1)
    before[first[:-1]] = _CLOSE
    after[first[1:] - 1] = _CLOSE
    grams = mix((before << np.uint64(18)) | (data << np.uint64(9)) | after, 31) % np.uint64(GRAM_ROWS)
    return Vocabulary((hashes[at] % np.uint64(WORD_ROWS)).astype(np.int64), grams.astype(np.int64), first), inverse


def embed(net: Network, vocab: Vocabulary) -> np.ndarray:
    if not len(vocab.word):
        return np.zeros((0, 2 * WIDTH), np.float32)
    grams = np.add.reduceat(net.params["grams"][vocab.grams], vocab.first[:-1], axis=0)
    return np.concatenate([net.params["words"][vocab.word], grams / np.diff(vocab.first)[:, None]], axis=1).astype(np.float32)


def window_spans(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from word, number of words) of the overlapping windows that cover every text; an empty text has one empty window."""
    n = np.diff(first)
    k = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), k)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
    return text, first[:-1][text] + start, np.minimum(n[text] - start, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _direction(net: Network, side: str, projected: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (steps, windows, HIDDEN) of one direction; ids (steps, windows) in its own order of time."""
    u, h3 = net.params[f"u{side}"], 2 * HIDDEN
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    out = np.empty((*ids.shape, HIDDEN), np.float32)
    for t in range(len(ids)):
        x, hu = projected[ids[t]], h @ u
        gates = _sigmoid(x[:, :h3] + hu[:, :h3])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        z = np.where((t < size)[:, None], z, np.float32(1))
        n = np.tanh(x[:, h3:] + r * hu[:, h3:])
        if keep is not None:
            keep.append((h, z, r, n, hu[:, h3:]))
        h = n + z * (h - n)
        out[t] = h
    return out


def forward(net: Network, vectors: np.ndarray, inverse: np.ndarray, start: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window."""
    steps = max(1, int(size.max())) if len(size) else 1
    t = np.arange(steps)[:, None]
    inside = t < size
    last = max(len(inverse) - 1, 0)
    padded = inverse if len(inverse) else np.zeros(1, np.int64)
    source = vectors if len(vectors) else np.zeros((1, 2 * WIDTH), np.float32)
    ids = {"f": padded[np.minimum(start + t, last)], "b": padded[np.clip(start + size - 1 - t, 0, last)]}
    flip = np.where(inside, size - 1 - t, t)
    states, traces = [], {}
    for side in "fb":
        traces[side] = [] if keep is not None else None
        projected = source @ net.params[f"w{side}"] + net.params[f"c{side}"]
        h = _direction(net, side, projected, ids[side], size, traces[side])
        states.append(h if side == "f" else h[flip, np.arange(len(size))])
    both = np.concatenate(states, axis=2)
    weight = both @ net.params["v"]
    weight = np.where(inside, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight = np.where(inside, weight, 0)
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = (weight[:, :, None] * both).sum(axis=0)
    if keep is not None:
        keep |= {"ids": ids, "flip": flip, "both": both, "weight": weight, "pooled": pooled, "traces": traces, "source": source, "inside": inside}
    return pooled @ net.params["o"] + net.params["d"][0]


def _tabled(rows: np.ndarray, grad: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, weights=grad[:, k], minlength=n) for k in range(grad.shape[1])], axis=1).astype(np.float32)


def gradients(net: Network, vocab: Vocabulary, keep: dict, d_logit: np.ndarray, known: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    p, both, weight = net.params, keep["both"], keep["weight"]
    g = {"o": keep["pooled"].T @ d_logit, "d": np.array([d_logit.sum()], np.float32)}
    d_pool = d_logit[:, None] * p["o"]
    d_weight = (both * d_pool).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.tensordot(d_score, both, axes=([0, 1], [0, 1]))
    d_both = weight[:, :, None] * d_pool + d_score[:, :, None] * p["v"]
    d_source = np.zeros_like(keep["source"])
    for side, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
        if side == "b":
            back = np.zeros_like(part)
            back[keep["flip"], np.arange(part.shape[1])] = part
            part = back
        u, du = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
        d_h = np.zeros(part.shape[1:], np.float32)
        d_x = np.empty((*part.shape[:2], 3 * HIDDEN), np.float32)
        for t in range(len(part) - 1, -1, -1):
            h, z, r, n, hn = keep["traces"][side][t]
            d_h = d_h + part[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = np.where(keep["inside"][t][:, None], d_h * (h - n) * z * (1 - z), 0)
            d_r = d_n * hn * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
            du += h.T @ d_hu
            d_h = d_h * z + d_hu @ u.T
        g[f"u{side}"] = du
        tokens = keep["ids"][side].ravel()
        per_word = _tabled(tokens, d_x.reshape(-1, 3 * HIDDEN), len(d_source))
        g[f"c{side}"] = per_word.sum(axis=0)
        g[f"w{side}"] = keep["source"].T @ per_word
        d_source += per_word @ p[f"w{side}"].T
    size = np.diff(vocab.first)
    g["words"] = _tabled(vocab.word, d_source[:, :WIDTH] * known[:, None], WORD_ROWS) + decay * p["words"]
    g["grams"] = _tabled(vocab.grams, np.repeat(d_source[:, WIDTH:] / size[:, None], size, axis=0), GRAM_ROWS) + decay * p["grams"]
    return g


def text_counts(blocks: list[tuple], rows: int, of: str) -> np.ndarray:
    """How many of the texts reach each row of a table."""
    seen = np.zeros(rows, np.int64)
    for vocab, *_ in blocks:
        seen[np.unique(getattr(vocab, of))] += 1
    return seen


def leaning(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """What the tables start from: the signed root of each row's likelihood ratio against no association with the label, beyond chance."""
    n = clean + toxic
    share = n_toxic / (n_clean + n_toxic)
    g = toxic * np.log(np.maximum(toxic, 1) / np.maximum(n * share, 1e-9)) + clean * np.log(np.maximum(clean, 1) / np.maximum(n * (1 - share), 1e-9))
    return (np.sign(toxic - n * share) * np.maximum(np.sqrt(2 * np.maximum(g, 0)) - BY_CHANCE, 0) / 2).astype(np.float32)


def _narrow(words: Words) -> tuple:
    """What training keeps of a text: its vocabulary and windows, numbers in 32 bits, without the text."""
    vocab, inverse = vocabulary(words)
    text, start, size = (x.astype(np.int32) for x in window_spans(words.first))
    return Vocabulary(vocab.word.astype(np.int32), vocab.grams.astype(np.int16), vocab.first.astype(np.int32)), inverse.astype(np.int32), text, start, size


def train(texts: Iterable[Words], labels: np.ndarray, steps: int = 260, batch: int = 24, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on balanced batches of texts; a text's logit is the softmax-weighted mean of its windows', ever nearer their maximum.

    texts holds one text each, and is read once.  A seeded part of them is only watched: of the running means of the parameters, those of the
    least loss on it are kept.
    Without both labels the network stays neutral and gives every text a score of 0.5 or less.
    """
    net = Network.fresh(seed)
    groups = [np.flatnonzero(labels == y) for y in (0, 1)]
    if not all(len(x) for x in groups):
        net.params["o"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    blocks = [_narrow(w) for w in texts]
    watched = [rng.permutation(g)[: int(len(g) * WATCHED)] for g in groups]
    groups = [np.setdiff1d(g, x) for g, x in zip(groups, watched)]
    common = {}
    for k, rows, of in (("words", WORD_ROWS, "word"), ("grams", GRAM_ROWS, "grams")):
        seen = [text_counts([blocks[i] for i in g], rows, of) for g in groups]
        common[k] = sum(seen) >= LEAST_TEXTS
        net.params[k] *= common[k][:, None]
        net.params[k][:, 0] = leaning(*seen, *map(len, groups))
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    s = {k: np.zeros_like(v) for k, v in net.params.items()}
    mean = Network({k: v.copy() for k, v in net.params.items()})
    best, kept, decay = np.inf, net, DECAY / min(map(len, groups)) ** 2
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        vocab, inverse, text, start, size = _joined([blocks[i] for i in chosen])
        keep: dict = {}
        vectors = embed(net, vocab)
        known = rng.random(len(vectors)) >= WORD_DROP
        vectors[:, :WIDTH] *= known[:, None]
        logit = forward(net, vectors, inverse, start, size, keep)
        whole, share = _text_logits(logit, text, len(chosen), 1.0 + 3.0 * step / steps)
        error = (_sigmoid(whole) - labels[chosen])[text] * share / len(chosen)
        rate_now = rate * (1 - 0.8 * step / steps)
        for k, grad in gradients(net, vocab, keep, error.astype(np.float32), known, decay).items():
            if k in common:
                grad = grad * common[k][:, None]
            norm = float(np.sqrt((grad * grad).sum()))
            grad = grad / max(1.0, norm)
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad * grad
            net.params[k] -= (rate_now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        for k, v in net.params.items():
            mean.params[k] += (v - mean.params[k]) * np.float32(max(1 / step, AVERAGED))
        if step % LOOK == 0 and all(len(x) for x in watched):
            loss = _watched_loss(mean, blocks, watched)
            if loss < best:
                best, kept = loss, Network({k: v.copy() for k, v in mean.params.items()})
    return kept if np.isfinite(best) else mean


def _text_logits(logit: np.ndarray, text: np.ndarray, n: int, sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """(logit of each text, share of each window in it): a softmax-weighted mean, the nearer the maximum the larger `sharp`."""
    top = np.full(n, -1e9)
    np.maximum.at(top, text, logit)
    share = np.exp(sharp * (logit - top[text]))
    share /= np.bincount(text, weights=share)[text]
    return np.bincount(text, weights=share * logit, minlength=n), share


def _watched_loss(net: Network, blocks: list[tuple], watched: list[np.ndarray]) -> float:
    """Mean log loss of the largest window of the watched texts, both labels alike in weight; bounded by the sample's size."""
    total = 0.0
    for label, own in enumerate(watched):
        losses = []
        for at in range(0, len(own), 64):
            vocab, inverse, text, start, size = _joined([blocks[i] for i in own[at : at + 64]])
            top = np.full(len(own[at : at + 64]), -np.inf)
            np.maximum.at(top, text, forward(net, embed(net, vocab), inverse, start, size))
            losses.append(np.logaddexp(0, -top if label else top))
        total += float(np.concatenate(losses).mean())
    return total


def _joined(blocks: list[tuple]) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, grams, first, inverse, text, start, size = [], [], [0], [], [], [], []
    n_words = n_tokens = n_grams = 0
    for i, (vocab, inv, _, st, sz) in enumerate(blocks):
        words.append(vocab.word)
        grams.append(vocab.grams)
        first.extend((vocab.first[1:] + n_grams).tolist())
        inverse.append(inv + n_words)
        text.append(np.full(len(st), i))
        start.append(st + n_tokens)
        size.append(sz)
        n_words, n_tokens, n_grams = n_words + len(vocab.word), n_tokens + len(inv), n_grams + len(vocab.grams)
    return Vocabulary(np.concatenate(words), np.concatenate(grams), np.array(first)), np.concatenate(inverse), np.concatenate(text), np.concatenate(start), np.concatenate(size)


def text_scores(net: Network, words: Words, side_by_side: int = 4096) -> np.ndarray:
    """The largest window probability of each text of a block."""
    vocab, inverse = vocabulary(words)
    vectors = embed(net, vocab)
    text, start, size = window_spans(words.first)
    order = np.argsort(-size, kind="stable")
    logit = np.empty(len(text))
    for at in range(0, len(order), side_by_side):
        own = order[at : at + side_by_side]
        logit[own] = forward(net, vectors, inverse, start[own], size[own])
    top = np.full(len(words.counts), -np.inf)
    np.maximum.at(top, text, logit)
    return _sigmoid(top)
