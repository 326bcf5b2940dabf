"""Toxicity of whole texts by a bidirectional gated recurrent network over all their overlapping windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.frames import map_columns
from tidemark.llm.tokens import blocks, words_of

HELD_OUT_OF = 3
REJECT_AT = 0.7
SAMPLE_PER_CLASS = 1200
SAMPLE_TEXT_BYTES = 12_000


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, text_bytes: int = SAMPLE_TEXT_BYTES) -> list:
    """At most per_class labelled texts of each class that are not held out, of at most text_bytes bytes, by a hash of doc_id.

    Twice as many labels are drawn, so that longer texts among them don't leave the sample short unless they are over half.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF != 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    drawn = [usable.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(2 * per_class) for y in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]).select("doc_id", "toxic"))  # 4 * per_class rows at most
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= text_bytes).join(ids, "doc_id")
    order = (F.xxhash64("doc_id"), "doc_id", "text")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("toxic").orderBy(*order))).where(F.col("k") <= per_class)
    return first.orderBy(*order).select("doc_id", "text", "toxic").collect()


def fit(docs: DataFrame, labels: DataFrame) -> gru.Network:
    rows = training_rows(docs, labels)
    data = (np.frombuffer(r["text"].encode(), np.uint8) for r in rows)
    return gru.train((words_of(d, np.array([0, len(d)])) for d in data), np.array([r["toxic"] for r in rows], np.int64))


def score_texts(docs: DataFrame, net: gru.Network) -> DataFrame:
    """Adds score (0 to 1) to every row; null text counts as empty, whose one window is empty."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [gru.text_scores(net, words) for _, _, words in blocks(batch.column("text"))]
        return {"score": pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())}

    return map_columns(docs, {"score": "double"}, run)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted, learnt from the labels of rows that are not held out.

    Only the text enters a score.  Null and empty texts are scored as no words; a row without a doc_id is not held out
    and not learnt from; repeated rows get equal scores.  Without labels of both classes every score is 0.5.  Input
    columns named like added ones are replaced; an empty table gives no rows.
    """
    scored = score_texts(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == 1, F.lit(False))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= REJECT_AT).cast("int")})
