"""Periodic runs of words: an online sparse diagonal DP over each text.

Two equal words `lag` apart lie on a diagonal; a stretch of equal words on one diagonal is a match, and a run of period
q and length n is a match of n - q words on the diagonal of lag q.  Walking through a text, a word's earlier occurrences
tell the diagonals that are active there; a diagonal that goes on has its match lengthened by one, and one that ends
long enough gives a run at once.

What keeps the active diagonals few: a run that counts (`least` words, three periods) matches at least 2q words, so an
occurrence opens a diagonal only where the `span` words from there on occur earlier too, for lags in (span / 2, span]
at each doubling of span.  Two occurrences of such words nearer than q would give the run a smaller period, so the
nearest earlier occurrence is the one that counts: a word has one active diagonal for each span, whatever the text, and
periods found are smallest ones.  Work is n log n for n words, also where one word fills a text.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import map_columns
from tidemark.llm.tokens import Words, blocks, numbered

LEAST_WORDS = 24
EXPONENT = 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of keys that occur more than once, their dense numbers)."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(count[number] > 1)
    return rows, number[rows]


def _ended(at: np.ndarray, lag: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, lag) of the diagonals over ascending places: a diagonal ends where the next place has another lag."""
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (np.diff(at) != 1) | (np.diff(lag) != 0)
    head = np.flatnonzero(opens)
    matched = np.diff(np.append(head, len(at))) + span - 1
    return at[head] - lag[head], matched + lag[head], lag[head]


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; words first[i]:first[i + 1] are text i's."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    opening = 1 << ((2 * least // 3).bit_length() - 1)  # a run matches least - q and 2q words, so 2 least / 3 at the least
    at, number = _repeated(text * (int(ids.max(initial=0)) + 1) + ids)
    span, found = 1, []
    while len(at):
        if span >= opening:
            order = np.argsort(number, kind="stable")
            before = np.zeros(len(at), dtype=np.int64)
            before[order[1:]] = np.where(number[order[1:]] == number[order[:-1]], at[order[1:]] - at[order[:-1]], 0)
            lag = np.where((before > (span // 2 if span > opening else 0)) & (before <= span), before, 0)
            some = np.flatnonzero(lag)
            start, length, period = _ended(at[some], lag[some], span)
            enough = length >= np.maximum(least, EXPONENT * period)
            found.append((start[enough], length[enough], period[enough]))
        # the words from each place on, twice as far, named by the names of both halves
        named = np.full(len(ids) + 1, -1, dtype=np.int64)
        named[at] = number
        after = np.minimum(at + span, len(ids))
        long_enough = counts[text[at]] >= EXPONENT * (span if span >= opening else 1)
        going = np.flatnonzero((named[after] >= 0) & long_enough & (text[np.minimum(after, len(ids) - 1)] == text[at]))
        rows, number = _repeated(number[going] * (int(number.max()) + 1) + named[after[going]])
        at, span = at[going][rows], span * 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start, length, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return text[start], start - first[text[start]], length, period


def _columns(words: Words, least: int) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """(word counts, runs, collapsed texts) of a block."""
    text, start, length, period = find_runs(numbered(words), words.first, least)
    edges = np.searchsorted(text, np.arange(len(words.counts) + 1))
    runs, collapsed = [], []
    data = words.data.tobytes()
    for i, n in enumerate(words.counts):
        of = slice(edges[i], edges[i + 1])
        runs.append(list(zip(start[of].tolist(), length[of].tolist(), period[of].tolist())))
        tokens = data[words.offsets[i] : words.offsets[i + 1]].split()
        if runs[-1]:
            gone = np.zeros(n + 1, dtype=np.int64)
            np.add.at(gone, start[of] + period[of], 1)
            np.add.at(gone, start[of] + length[of], -1)
            tokens = compress(tokens, np.cumsum(gone)[:-1] == 0)
        collapsed.append(b" ".join(tokens).decode())
    return words.counts.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Adds n_words, runs (start, length and period in words, by start, then period) and the collapsed text as text.

    A run is a stretch of at least `least` words and three periods that no neighbouring word extends, with its smallest
    period.  Collapsed, it keeps its first period; what any run holds after that goes, and what stays is joined by one
    space.  Null and empty texts have no words and no runs; rows are read each on its own, whole, so repeated rows and
    ids get equal results; an empty table stays empty, and input columns named like the added ones are replaced.
    """

    def found(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, runs, texts = [], [], []
        for _, _, words in blocks(batch.column("text")):
            for out, new in zip((counts, runs, texts), _columns(words, least)):
                out += new
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        names = ("start", "length", "period")
        rows = pa.array([[dict(zip(names, r)) for r in of] for of in runs], kind)
        return {"n_words": pa.array(counts, pa.int64()), "runs": rows, "text": pa.array(texts, pa.string())}

    return map_columns(docs, {"n_words": "bigint", "runs": RUNS, "text": "string"}, found)


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, compared as fractions; of equal ones the first, null where there is none."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))
