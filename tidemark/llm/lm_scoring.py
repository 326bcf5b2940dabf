"""Language-model scores of whole texts by a hidden Markov model over token classes.

Words are counted through hash buckets: each home of documents sends every distinct word once, with its training count,
and gets its total back.  The model emits a token as its class (a hash of the word) by the hidden state, and the word
within its class by the counts, each class keeping a share for words it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hmm
from tidemark.llm.homes import HOME_BYTES, HOMES_OF_TASK, home_column, parts
from tidemark.llm.storage import partitions, text_bytes, written
from tidemark.llm.tokens import Words, blocks, mix, pack, unpack

STATES, CLASSES, ROUNDS = 8, 4096, 4
#: Gain in log10 likelihood a token under which training stops before its last round.
LEAST_GAIN = 1e-4
HELD_OUT_OF = 5
END = np.uint64(0xE4D0E4D0E4D0E4D1)
CHUNK = 256
_PACKED = "kind int, place int, home int, payload binary"


def held_out(parts_of: int) -> Column:
    """crc32 of the doc_id as text, modulo parts_of, is 1; a row without a doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts_of == 1, F.lit(False))


def token_stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first of each text + 1 end): the lower-cased words of each text, then one end."""
    hashes, n = words.hashes(lower=True), words.counts
    first = words.first + np.arange(len(n) + 1)
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
    return out, first


def classes_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    return (mix(hashes, 21) % np.uint64(classes)).astype(np.int64)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds, places, homes, payloads = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "place": pa.array(places, pa.int32()), "home": pa.array(homes, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _own_words(key: tuple, table: pa.Table, buckets: int) -> pa.Table:
    """A home's distinct words with their training counts, packed for each bucket."""
    found, counts = [], []
    for batch in table.combine_chunks().to_batches():
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for lo, hi, words in blocks(batch.column("text")):
            tokens, first = token_stream(words)
            u, inverse = np.unique(tokens, return_inverse=True)
            found.append(u)
            counts.append(np.bincount(inverse, weights=np.repeat(train[lo:hi], np.diff(first)), minlength=len(u)).astype(np.int64))
    u, inverse = np.unique(np.concatenate(found), return_inverse=True)
    c = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
    place = (mix(u, 3) % np.uint64(buckets)).astype(np.int64)
    return _rows([(0, b, key[0].as_py(), pack(u[r], c[r])) for b, r in parts(place)])


def _totals(key: tuple, table: pa.Table, classes: int) -> pa.Table:
    """A bucket: kind 1, to every home the totals of the words it sent; kind 2, [words, tokens, class sums]."""
    sent = [unpack(p, 2) for p in table.column("payload").to_pylist()]
    u, inverse = np.unique(np.concatenate([h for h, _ in sent]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in sent]), minlength=len(u)).astype(np.int64)
    rows, at = [], 0
    for home, (h, _) in zip(table.column("home").to_pylist(), sent):
        rows.append((1, 0, home, pack(h, total[inverse[at : at + len(h)]])))
        at += len(h)
    known = total > 0
    sums = np.bincount(classes_of(u[known], classes), weights=total[known] + 0.5, minlength=classes)
    rows.append((2, 0, -1, np.concatenate([[known.sum(), total.sum()], sums]).astype(np.float64).tobytes()))
    return _rows(rows)


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Adds up binary columns of doubles: (key, payload) rows of one width per key, as one (keys, width) array on the driver."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for p in table.column("payload").to_pylist():
            total += np.frombuffer(p)
        return pa.table({"key": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([total.tobytes()], pa.binary())})

    # twice, so that no task gathers a row from every other task
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("payload"), F.lit(16)))
    once = salted.groupBy("key", "salt").applyInArrow(lambda key, table: add(key[:1], table), "key int, payload binary")
    found = once.groupBy("key").applyInArrow(add, "key int, payload binary").collect()  # as many numbers as the model has
    return np.array([np.frombuffer(r["payload"]) for r in sorted(found, key=lambda r: r["key"])]).reshape(-1, width)


def train(docs: DataFrame, unigram: np.ndarray, states: int, rounds: int, least_gain: float = LEAST_GAIN) -> tuple[hmm.Model, list[float]]:
    """Baum-Welch over all training documents: (model, log10 likelihood of the documents before each round).

    The expected counts of the partitions are added up in Spark each round.  It stops after `rounds`, or when a round
    raised the likelihood by less than `least_gain` a token.
    """
    classes = len(unigram)
    model, trace = hmm.initial(unigram, states), []
    texts = docs.where(~F.col("held_out")).select("text")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: hmm.Model = model) -> Iterator[pa.RecordBatch]:
            counts = hmm.Counts.zero(states, classes)
            for batch in batches:
                for _, _, words in blocks(batch.column("text")):
                    tokens, first = token_stream(words)
                    hmm.expect(model, classes_of(tokens, classes), first, counts)
            flat = counts.flat()
            flat = np.pad(flat, (0, -len(flat) % CHUNK)).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["key", "payload"])

        flat = _summed(texts.mapInArrow(run, "key int, payload binary"), CHUNK).ravel()
        if not len(flat):
            break
        counts = hmm.Counts.of(flat, states, classes)
        model = hmm.maximised(counts, unigram)
        trace.append(counts.log10)
        if len(trace) > 1 and trace[-1] - trace[-2] < least_gain * counts.emit.sum():
            break
    return model, trace


def lm_scores(docs: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, whole texts, lower-cased A-Z.

    Null text is empty: its only token is the end.  Rows are scored one by one, so repeated doc_ids are no matter; a
    row without a doc_id is not held out.  Other columns are ignored; an empty table gives no rows.  Without training
    rows every word is unknown.
    """
    spark = docs.sparkSession
    _, n_bytes = text_bytes(docs)
    n = max(2 * partitions(spark), n_bytes // HOME_BYTES)
    rows = docs.select("doc_id", "text", held_out(HELD_OUT_OF).alias("held_out")).withColumn("home", home_column(n, F.col("doc_id"), F.col("text")))
    tasks = max(partitions(spark), n // HOMES_OF_TASK)
    sent = rows.select("home", "held_out", "text").repartition(tasks, "home").groupBy("home").applyInArrow(lambda key, table: _own_words(key, table, n), _PACKED)
    back = written(sent.repartition(tasks, "place").groupBy("place").applyInArrow(lambda key, table: _totals(key, table, classes), _PACKED), "word-totals")
    sums = _summed(back.where("kind = 2").select(F.lit(0).alias("key"), "payload"), classes + 2)
    stats = sums[0] if len(sums) else np.zeros(classes + 2)
    distinct, tokens, within = stats[0], stats[1], stats[2:]
    unigram = (within + 0.5) / (within + 0.5).sum()
    model, _ = train(rows, unigram, states, rounds)
    base_log, class_log = float(np.log10(tokens + 0.5 * (distinct + 1))), np.log10(within + 0.5)

    def score(key: tuple, own: pa.Table, totals: pa.Table) -> pa.Table:
        words_in, total = (np.concatenate(x) for x in zip(*(unpack(p, 2) for p in totals.column("payload").to_pylist()))) if totals.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(words_in)
        words_in, total = words_in[order], total[order]
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for batch in own.combine_chunks().to_batches():
            for _, _, words in blocks(batch.column("text")):
                hashes, first = token_stream(words)
                c = total[np.searchsorted(words_in, hashes)]
                cls = classes_of(hashes, classes)
                word_log = np.add.reduceat(np.log10(c + 0.5), first[:-1])
                size = np.diff(first)
                out["n_tokens"].append(size)
                out["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), first[:-1]))
                out["base_score"].append(word_log - size * base_log)
                out["score"].append(hmm.log10_likelihoods(model, cls, first) + word_log - np.add.reduceat(class_log[cls], first[:-1]))
        columns = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        ends = {"doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "train_tokens": pa.array(np.full(own.num_rows, int(tokens)), pa.int64())}
        types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table(ends | {k: pa.array(v, types[k]) for k, v in columns.items()})

    schema = "doc_id long, held_out boolean, train_tokens long, n_tokens long, n_known long, base_score double, score double"
    replies = back.where("kind = 1").select("home", "payload")
    scored = rows.select("home", F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").repartition(tasks, "home").groupBy("home").cogroup(replies.repartition(tasks, "home").groupBy("home")).applyInArrow(score, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
