"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id.  The hashes of a batch's new lines are found by a merge anti-join
with the runs of all earlier batches and become a sorted run of their own; when a level holds `fanout` runs they are
compacted into one run of the next level.  Every run maps a line key to the smallest doc_id that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import map_columns, order_id, slices
from tidemark.llm.hot import most_of, spread_join
from tidemark.llm.storage import drop_path, new_path, written

KEY = ["h1", "h2"]
MIN_KEY_CHARS = 10
_KEYS_SCHEMA = "d long, print long, h1 long, h2 long"
_RUN_SCHEMA = "h1 long, h2 long, first long"


def line_key(line: bytes) -> bytes:
    """[\\x20\\x09-\\x0D] stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least)


def _hash(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def _print(told_apart: bool) -> Column:
    """What tells rows of one order id apart, where there are any: a hash of their text."""
    return F.coalesce(F.xxhash64("text"), F.lit(0)) if told_apart else F.lit(0).cast("long")


def line_keys(docs: DataFrame, least: int = MIN_KEY_CHARS, told_apart: bool = True) -> DataFrame:
    """(d, print, h1, h2): the 128-bit hashes of the distinct line keys of each row, d its order id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            counts, digests = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                own = {line_key(line) for line in (text or b"").split(b"\n")}
                found = [_hash(k) for k in own if _long_enough(k, least)]
                counts.append(len(found))
                digests += found
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            ids = [pa.array(np.repeat(batch.column(c).to_numpy(), counts), pa.int64()) for c in ("d", "print")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(both[:, 0]), pa.array(both[:, 1])], names=["d", "print", *KEY])

    return docs.select(order_id().alias("d"), _print(told_apart).alias("print"), "text").mapInArrow(run, _KEYS_SCHEMA)


class LineRuns:
    """The levels of sorted runs; levels[i] lists the paths of level i."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def rows(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(_RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _RUN_SCHEMA)

    def _store(self, rows: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"line-run-{level}")
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, keys: DataFrame) -> None:
        """Takes a later batch's (d, h1, h2): keys that no run holds become a run."""
        firsts = keys.groupBy(*KEY).agg(F.min("d").alias("first"))
        if any(self.levels):
            firsts = firsts.join(self.rows().select(*KEY).hint("merge"), KEY, "left_anti")
        self._store(firsts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout and level < 8:
            paths, self.levels[level] = self.levels[level], []
            self._store(self.spark.read.schema(_RUN_SCHEMA).parquet(*paths).repartitionByRange(*KEY), level + 1)
            for p in paths:
                drop_path(self.spark, p)
            level += 1


def batch_bounds(keys: DataFrame, batches: int) -> list[int]:
    """Upper doc_id bounds of all batches but the last: at most batches - 1 numbers."""
    shares = [(i + 1) / batches for i in range(batches - 1)]
    found = keys.agg(F.percentile_approx("d", shares, 1000).alias("q")).first()["q"] if shares else None
    return sorted(set(found or []))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drops each line whose key is held by a smaller doc_id; adds n_lines and n_dropped and replaces text.

    Keys of fewer than min_chars code points are never dropped.  Null text is one empty line and comes back as ''.
    Rows with the same doc_id are one document, so their common lines all stay; a null doc_id comes after all others.
    What a row loses is collected for its own lines, also where many rows share one id or have none, and a line that many
    documents hold is dealt to shares.  An empty table gives an empty result.  Input columns named n_lines or n_dropped are replaced.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    told_apart = ids["ids"] < ids["rows"]
    keys = written(line_keys(docs, min_chars, told_apart), "line-keys")
    runs, bounds = LineRuns(docs.sparkSession, fanout), batch_bounds(keys, batches)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = keys
        part = part if low is None else part.where(F.col("d") > low)
        runs.add(part if high is None else part.where(F.col("d") <= high))
    most, rows = most_of(keys, *KEY)
    drops = spread_join(keys, runs.rows(), KEY, "d", most, rows).where(F.col("d") > F.col("first"))
    per_row = drops.groupBy("d", "print").agg(F.collect_set(F.struct(*KEY)).alias("__drop")).withColumnsRenamed({"d": "__d", "print": "__print"})
    rest = docs.withColumns({"__d": order_id(), "__print": _print(told_apart)}).join(per_row, ["__d", "__print"], "left")

    def keep(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, n_lines, n_dropped = [], [], []
        drop_lists = batch.column("__drop").to_pylist()
        for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), drop_lists):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if drop:
                gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drop}
                lines = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in gone)]
            texts.append(b"\n".join(lines).decode("utf-8", "replace"))
            n_dropped.append(n_lines[-1] - len(lines))
        return {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}

    return map_columns(rest, {"text": "string", "n_lines": "long", "n_dropped": "long"}, keep, drop=("__d", "__print", "__drop"))
