"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests under false-discovery control.

A candidate is a run of 20 or more characters of base64 and its kin.  Its encoding is the smallest listed alphabet that
holds it; a run that no alphabet holds, or that doesn't look random, is judged by its pieces between separators, since a key
may be joined to a path or prefix.  It looks random if chi-squared uniformity over that alphabet, the runs test and the serial correlation don't
reject; its p-value against ordinary text is the inverse likelihood ratio of the uniform alphabet over the corpus's own
character frequencies (a valid p-value by Markov's inequality).  Benjamini-Hochberg within each class of lengths, over the
candidates of all documents, sets the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import field, kept_columns, slices
from tidemark.llm.storage import written
from tidemark.llm.tokens import string_buffers

# The base patterns, in order of kind, with the least length of the checked group.
KINDS = ("assign", "access", "hex", "random")
BASE = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    (re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Runs of 16 hex digits or more are the maximal runs of that length: the same matches as BASE[2], found faster.
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Pieces of a candidate run of the same least length, for each way to split it.
PIECES = tuple(re.compile(f"[A-Za-z0-9{joined}]{{20,}}={{0,2}}") for joined in ("+/", "_-", "+_-", ""))
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = tuple(
    "".join(sorted(x))
    for x in (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "+/", _DIGITS + _LOWER + _UPPER + "-_")
)
LENGTH_EDGES = (24, 32, 48, 64)
FALSE_DISCOVERIES = 0.01
REJECT = 1e-3
STEP = 0.25  # of -log10 p in the histogram of p-values
MOST_BIN = 400


def _normal_p(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def battery(text: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of the string as uniform draws: chi-squared (upper tail, Wilson-Hilferty), runs about the median rank, serial correlation."""
    m, n = len(alphabet), len(text)
    ranks = np.searchsorted(np.frombuffer(alphabet.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8))
    chi = float(((np.bincount(ranks, minlength=m) - n / m) ** 2).sum() * m / n)
    df = m - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))
    uniform = 0.5 * erfc(z / sqrt(2))
    high = ranks >= m / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
        runs = _normal_p((1 + int((high[1:] != high[:-1]).sum()) - mean) / sqrt(var))
    else:
        runs = 2.0 ** (1 - n)
    x = ranks - ranks.mean()
    spread = float((x * x).sum())
    serial = _normal_p((float((x[1:] * x[:-1]).sum()) / spread + 1 / n) * sqrt(n)) if spread else 0.0
    return uniform, runs, serial


def judged(text: str, text_log: np.ndarray) -> float | None:
    """-log10 of the p-value against ordinary text of a random-looking string, else None; digits alone are no secret."""
    body = text.rstrip("=")
    own = set(body)
    alphabet = next((a for a in ALPHABETS if own <= set(a)), None)
    if alphabet is None or alphabet == _DIGITS:
        return None
    if 3 * min(battery(body, alphabet)) < REJECT:
        return None
    ratio = -len(body) * log10(len(alphabet)) - float(text_log[np.frombuffer(body.encode(), np.uint8)].sum())
    return max(ratio, 0.0)


def random_runs(run: str, text_log: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, -log10 p) of the run if it looks random, else of its random-looking pieces between separators, without overlaps.

    A run may join a key to a path or a prefix, so it is split at - and _, at + and /, at / and at all of them; of
    overlapping pieces the one least like text counts.
    """
    p = judged(run, text_log)
    if p is not None:
        return [(0, len(run), p)]
    spans = {m.span() for piece in PIECES for m in piece.finditer(run)} - {(0, len(run))}
    found = [(a, b, p) for a, b in sorted(spans) if (p := judged(run[a:b], text_log)) is not None]
    kept: list[tuple[int, int, float]] = []
    for a, b, p in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0])):
        if all(b <= s or e <= a for s, e, _ in kept):
            kept.append((a, b, p))
    return sorted(kept)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind; failing matches are dropped."""
    found = [(m.start(), 0, m.end()) for m in BASE[0][0].finditer(text) if len(m[2]) >= BASE[0][2]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in BASE[1][0].finditer(text) if len(m[0]) >= BASE[1][2]]
    return found + [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]


def character_logs(docs: DataFrame) -> np.ndarray:
    """log10 frequency of each byte within the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            total += np.bincount(string_buffers(batch.column("text"))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    rows = docs.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256 rows
    n = np.zeros(256)
    for r in rows:
        n[r["byte"]] = r["n"]
    n[[0x20, *range(0x09, 0x0E)]] = 0
    return np.log10((n + 1) / (n + 1).sum())


_SPAN = "struct<start:int,kind:int,end:int>"


def scan(docs: DataFrame, text_log: np.ndarray) -> DataFrame:
    """docs without text, with base: array of spans, and maybe: array of (start, end, length class, bin of -log10 p)."""
    keep = [c for c in kept_columns(docs, ["base", "maybe"]) if c != "text"]
    schema = T.StructType([docs.schema[c] for c in keep] + [field("base", f"array<{_SPAN}>"), field("maybe", "array<struct<start:int,end:int,class:int,bin:int>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            bases, maybes = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                own = []
                for m in CANDIDATE.finditer(text or ""):
                    if any(s <= m.start() and m.end() <= e for s, _, e in spans):
                        continue
                    for a, b, p in random_runs(m[0], text_log):
                        start, end = m.start() + a, m.start() + b
                        if b - a == len(m[0]) or not any(s <= start and end <= e for s, _, e in spans):
                            own.append({"start": start, "end": end, "class": int(np.searchsorted(LENGTH_EDGES, end - start, side="right")), "bin": min(int(p / STEP), MOST_BIN)})
                maybes.append(own)
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            maybe = pa.struct([(x, pa.int32()) for x in ("start", "end", "class", "bin")])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(bases, pa.list_(span)), pa.array(maybes, pa.list_(maybe))], names=[*keep, "base", "maybe"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def cuts(scanned: DataFrame, rate: float) -> list[int]:
    """For each class of lengths the least bin that Benjamini-Hochberg keeps, from the counts by class and bin of all candidates."""
    x = scanned.select(F.explode("maybe").alias("x")).groupBy("x.class", "x.bin").count()
    rows = x.collect()  # at most 5 * 401 rows
    out = []
    for c in range(len(LENGTH_EDGES) + 1):
        bins = sorted(((r["bin"], r["count"]) for r in rows if r["class"] == c), reverse=True)
        total, above, cut = sum(n for _, n in bins), 0, MOST_BIN + 1
        for b, n in bins:
            above += n
            if total * 10 ** (-b * STEP) <= rate * above:
                cut = b
        out.append(cut)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """docs without text, with n_assign, n_access, n_hex, n_random, base and spans ("kind:start:end,...") and base_sha256.

    Offsets are code points, ends exclusive; spans go by start, then kind in the order of KINDS.  Null text is empty.
    Every row is scanned on its own, so null and repeated doc_ids are no matter; an empty table gives no rows; input
    columns named like added ones are replaced.
    """
    scanned = written(scan(docs, character_logs(docs)), "secret-spans")
    least = F.array(*[F.lit(c) for c in cuts(scanned, rate)])
    random = F.transform(
        F.filter("maybe", lambda x: x["bin"] >= F.element_at(least, x["class"] + 1)),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )
    added = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    keep = [c for c in kept_columns(scanned, added) if c not in ("base", "maybe")]
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    rows = scanned.withColumn("all", F.array_sort(F.concat("base", random)))
    base_text = _joined(F.array_sort("base"))
    return rows.select(*keep, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(base_text, 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
