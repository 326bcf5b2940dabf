"""Exact substring dedup: Rabin-Karp hashes of every window of so many words, counted across the corpus.

Windows travel as packed columns of (hash, document, position): each map block keeps the first occurrence of a hash
and notes the others as repeats at once, so a passage that a third of all documents share reaches its bucket once for
each block.  Buckets are dealt by a second, independent hash, so two different windows are taken for one only if 64 bits
and the bucket agree: with a bucket for each 12 MB of text that is 0.0003 expected pairs in 10^9 windows and less than one
in 10^13, and as many within the blocks, where the first hash decides alone.  A bucket finds the first occurrence of each hash, and the repeats go home to their documents, where they merge into
maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import field, kept_columns, order_id
from tidemark.llm.homes import HOMES_OF_TASK, home_column, home_of, parts
from tidemark.llm.storage import partitions, text_bytes
from tidemark.llm.tokens import blocks, pack, unpack, words_of

WIDTH = 20
BUCKET_BYTES = 12 << 20
BLOCK_BYTES = 6 << 20
#: Map blocks whose windows of one bucket meet in one group; of more blocks, groups of a bucket are merged before it.
BLOCKS_OF_GROUP = 1 << 16
_PACKED = "kind int, place int, payload binary"


def _first_of_each(hashes: np.ndarray, ids: np.ndarray, prints: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """True for the rows that come first, by document and position, among those of their hash; all of several equal ones are first."""
    order = np.lexsort((positions, prints, ids, hashes))
    h, i, f, p = hashes[order], ids[order], prints[order], positions[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), bool)
    out[order] = (i == i[lead]) & (f == f[lead]) & (p == p[lead])
    return out


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, places, payloads = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "place", "payload"])


def window_rows(docs: DataFrame, width: int, buckets: int, homes: int, told_apart: bool) -> DataFrame:
    """Kind 0: first windows of a block for bucket `place`; kind 1: repeats already seen, on their way to home `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column("d").to_numpy(zero_copy_only=False)
            all_prints = batch.column("print").to_numpy(zero_copy_only=False)
            for lo, hi, words in blocks(batch.column("text"), BLOCK_BYTES):
                word_hashes, second = words.strong_hashes()
                hashes, text, position = words.windows(word_hashes, width)
                if not len(hashes):
                    continue
                ids = all_ids[lo:hi][text]
                prints = all_prints[lo:hi][text] if told_apart else np.zeros(len(ids), np.int64)
                first = _first_of_each(hashes, ids, prints, position)
                out = []
                bucket = (words.second_windows(second, text, position, width) % np.uint64(buckets)).astype(np.int64)
                keep = np.flatnonzero(first)
                keep = keep[np.lexsort((position[keep], prints[keep], ids[keep]))]
                for place, rows in parts(bucket[keep]):
                    rows = keep[rows]
                    out.append((0, place, pack(hashes[rows], ids[rows], prints[rows], position[rows])))
                again = np.flatnonzero(~first)
                for place, rows in parts(home_of(homes, ids[again], prints[again])):
                    rows = again[rows]
                    out.append((1, place, pack(prints[rows].view(np.uint64), ids[rows], position[rows])))
                yield _packed_rows(out)

    source = docs.select(order_id().alias("d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("print") if told_apart else F.lit(0).cast("long").alias("print"), "text")
    return source.mapInArrow(run, _PACKED)


def _repeats(key: tuple, table: pa.Table, homes: int, keep_firsts: bool) -> pa.Table:
    """A bucket, or with keep_firsts a part of one: which of its windows have an earlier occurrence. The first ones of a part go on, kind 1 passes through."""
    kind, place = (x.as_py() for x in key)
    payloads = table.column("payload").to_pylist()
    if kind == 1:
        return pa.Table.from_batches([_packed_rows([(1, place, p) for p in payloads])])
    hashes, ids, prints, positions = (np.concatenate(x) for x in zip(*(unpack(p, 4) for p in payloads)))
    first = _first_of_each(hashes, ids, prints, positions)
    again = np.flatnonzero(~first)
    again = again[np.lexsort((positions[again], ids[again]))]
    rows = [(1, home, pack(prints[again[r]].view(np.uint64), ids[again[r]], positions[again[r]])) for home, r in parts(home_of(homes, ids[again], prints[again]))]
    if keep_firsts:
        kept = np.flatnonzero(first)
        kept = kept[np.lexsort((positions[kept], prints[kept], ids[kept]))]
        rows.append((0, place, pack(hashes[kept], ids[kept], prints[kept], positions[kept])))
    return pa.Table.from_batches([_packed_rows(rows)])


def covered_words(positions: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """The union of the windows that start at these positions, as a mask of the document's words."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, positions, 1)
    np.add.at(steps, np.minimum(positions + width, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Removes each word that a window covers whose word sequence also starts earlier; text becomes the kept words joined by a space.

    Adds n_words, n_removed and intervals (half-open word ranges, maximal).  Null text has no words and becomes ''.
    A null doc_id comes after all others.  Rows that share a doc_id go by a hash of their text; equal rows count as one
    and the same start, so neither is earlier.  Empty tables stay empty; input columns named like added ones are replaced.
    """
    spark = docs.sparkSession
    n_rows, n_bytes = text_bytes(docs)
    buckets = max(2 * partitions(spark), n_bytes // BUCKET_BYTES)
    homes = max(2 * partitions(spark), n_bytes // BUCKET_BYTES)
    told_apart = docs.select(F.count_distinct("doc_id").alias("n")).first()["n"] < n_rows
    tasks = max(partitions(spark), buckets // HOMES_OF_TASK)

    def merged(rows: DataFrame, parts_of_bucket: int) -> DataFrame:
        spread = F.xxhash64("payload")
        salted = rows.withColumn("salt", F.when(F.col("kind") == 1, spread).otherwise(F.pmod(spread, F.lit(parts_of_bucket))))
        keep = parts_of_bucket > 1
        return salted.repartition(tasks, "kind", "place", "salt").groupBy("kind", "place", "salt").applyInArrow(lambda key, table: _repeats(key[:2], table, homes, keep), _PACKED)

    found = window_rows(docs, width, buckets, homes, told_apart)
    parts_of_bucket = -(-n_bytes // (BLOCK_BYTES * BLOCKS_OF_GROUP))
    for n in (parts_of_bucket, 1) if parts_of_bucket > 1 else (1,):
        found = merged(found, n)

    added = {"text": "string", "n_words": "long", "n_removed": "long", "intervals": "array<struct<start:long,end:long>>"}
    keep = kept_columns(docs, list(added))
    schema = docs.select(*keep).schema
    for name, kind in added.items():
        schema = schema.add(field(name, kind))
    print_column = F.coalesce(F.xxhash64("text"), F.lit(0)) if told_apart else F.lit(0).cast("long")
    placed = docs.withColumns({"__d": order_id(), "__print": print_column}).withColumn("__home", home_column(homes, F.col("__d"), F.col("__print")))

    def rebuild(key: tuple, own: pa.Table, repeats: pa.Table) -> pa.Table:
        if repeats.num_rows:
            prints, ids, positions = (np.concatenate(x) for x in zip(*(unpack(p, 3) for p in repeats.column("payload").to_pylist())))
            prints = prints.view(np.int64)
        else:
            prints = ids = positions = np.zeros(0, np.int64)
        order = np.lexsort((prints, ids))
        prints, ids, positions = prints[order], ids[order], positions[order]
        texts, n_words, n_removed, intervals = [], [], [], []
        for d, f, text in zip(own.column("__d").to_pylist(), own.column("__print").to_pylist(), own.column("text").cast(pa.binary()).to_pylist()):
            a, b = np.searchsorted(ids, [d, d + 1]) if d < (1 << 63) - 1 else (np.searchsorted(ids, d), len(ids))
            starts = positions[a:b][prints[a:b] == f]
            data = np.frombuffer(text or b"", np.uint8)
            words = words_of(data, np.array([0, len(data)]))
            n = len(words.starts)
            gone = covered_words(starts, width, n)
            left = np.flatnonzero(~gone)
            texts.append(b" ".join([text[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist())]).decode("utf-8", "replace"))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            intervals.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
            n_words.append(n)
            n_removed.append(n - len(left))
        new = {"text": pa.array(texts, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "intervals": pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table([own.column(c) for c in keep] + [new[c] for c in added], names=keep + list(added))

    return placed.repartition(tasks, "__home").groupBy("__home").cogroup(found.repartition(tasks, "place").groupBy("place")).applyInArrow(rebuild, schema)
