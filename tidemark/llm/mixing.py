"""Mixing sources to target weights by a golden-ratio schedule, with DataFrame functions only.

Slot j draws the point frac(j * golden ratio) and takes the source whose share of the cumulative targets holds it; the
r-th slot of a source takes block r, so many consecutive words of that source's documents laid end to end in shuffled
order, twice over.  Blocks beyond a source's target are cut off, and one last slot fills what its slots fell short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import partitions, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
GOLDEN = 0.6180339887498949
#: frac(2**20 * golden ratio), so that points stay exact for any number of slots
GOLDEN_HIGH = 0.607787409740351
CELLS = 1024


@dataclass
class Mix:
    sources: DataFrame  # sid, source, source_size, target
    pieces: DataFrame  # slot, sid, source, block, doc_id, row, from_word, n_words
    documents: DataFrame  # one row for each input row


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """(sid, source, source_size, target, low, high): shares by weight, stopped at `most` times a source's size.

    In order of size by weight, the stopped sources are those that still fall short of their share of what is left.
    Works on one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("sid") % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all", F.sum("source_size").over(everything) * F.lit(total_share)).withColumn("all_w", F.sum("w").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("stopped", F.col("cap") * left_w <= left * F.col("w"))
    stopped = lambda c: F.sum(F.when(F.col("stopped"), F.col(c)).otherwise(0.0)).over(everything)
    share = (F.col("all") - stopped("cap")) / F.nullif(F.col("all_w") - stopped("w"), F.lit(0.0)) * F.col("w")
    rows = rows.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(F.least(share, F.col("cap"))))
    high = F.sum("target").over(Window.orderBy("sid"))
    sum_all = F.sum("target").over(everything)
    part = F.nullif(sum_all, F.lit(0.0))  # without a word no source has a part of the schedule
    return rows.select("sid", "source", "source_size", "target", ((high - F.col("target")) / part).alias("low"), (high / part).alias("high"), sum_all.alias("all"))


def points() -> Column:
    """frac(j * golden ratio) of column slot = j."""
    x = F.shiftright(F.col("slot"), 20) * F.lit(GOLDEN_HIGH) + F.col("slot").bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(GOLDEN)
    return x - F.floor(x)


def schedule(sources: DataFrame, n_slots: int, segment: int) -> DataFrame:
    """(slot, sid, r): each slot's source and its rank among the slots of that source, from 0.

    Ranks are counts of the segments before plus the rank inside a segment of consecutive slots: no task sees a whole source.
    """
    spark = sources.sparkSession
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", points()).withColumn("cell", F.floor(F.col("u") * CELLS))
    spans = sources.where(F.col("target") > 0).select("sid", "low", "high").withColumn("high", F.when(F.col("high") > 1 - 1e-12, F.lit(1.1)).otherwise(F.col("high")))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))))
    drawn = slots.join(spans, (slots.cell == spans.cell) & (slots.u >= spans.low) & (slots.u < spans.high)).select("slot", "sid", F.floor(F.col("slot") / segment).alias("seg"))
    counts = drawn.groupBy("sid", "seg").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("sid", "seg", (F.sum("n").over(Window.partitionBy("sid").orderBy("seg")) - F.col("n")).alias("before"))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("sid", "seg").orderBy("slot")) - 1)
    return ranked.join(base, ["sid", "seg"]).select("slot", "sid", (F.col("before") + F.col("k")).alias("r"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 17) -> Mix:
    """Mixes all documents; a document's size is its words, null text has none.

    A null source is a source of its own, after all others.  Empty documents, sources and tables get 0 words; rows
    that share a doc_id are documents of their own.  Other columns are ignored.  Same input, same mix, in any row order.

    Where each document lies and the schedule are written before they meet, so that the driver never plans, nor broadcasts for, all of it at once.
    """
    spark = docs.sparkSession
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = written(targets(sizes, weights, total_share, most), "mix-sources")
    words = float(sources.agg(F.max("all")).first()[0] or 0.0)
    n_rows = sizes.count()

    buckets = max(64, n_rows // 20_000)
    keyed = sizes.join(sources.select("sid", F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bk", F.pmod(F.col("h"), F.lit(buckets)))
    sums = keyed.groupBy("sid", "bk").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "bk", (F.sum("n").over(Window.partitionBy("sid").orderBy("bk")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("sid", "bk").orderBy("h", "doc_id", "size")
    laid = keyed.withColumn("row", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(base, ["sid", "bk"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size")).withColumn("limit", F.floor("target"))
    laid = written(laid.select("doc_id", "source", "size", "source_size", "target", "sid", "bk", "row", "start", "limit"), "mix-laid")

    slots = schedule(sources, int(-(-words // block)), max(4096, int(words // block) // (4 * partitions(spark)) + 1))
    drawn = written(slots.select("slot", "sid", (F.col("r") * block).alias("from"), ((F.col("r") + 1) * block).alias("to")), "mix-slots")
    reached = drawn.groupBy("sid").agg(F.max("to").alias("reached"))
    short = sources.join(reached, "sid", "left").select(F.lit(-1).cast("long").alias("slot"), "sid", F.coalesce("reached", F.lit(0)).alias("from"), F.floor("target").alias("to")).where(F.col("from") < F.col("to"))
    fill = short.withColumn("r", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))).select("slot", "sid", "r", (F.col("r") * block).alias("from"), F.least((F.col("r") + 1) * block, F.col("to")).alias("to"))
    slots = drawn.withColumn("r", F.floor(F.col("from") / block)).unionByName(fill)

    rounds = laid.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    rounds = rounds.withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("limit"))).where(F.col("lo") < F.col("hi"))
    rounds = rounds.withColumn("r", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    pieces = rounds.join(slots, ["sid", "r"]).withColumn("a", F.greatest("lo", "from")).withColumn("b", F.least("hi", "to")).where(F.col("a") < F.col("b"))
    pieces = pieces.select("slot", "sid", "source", F.col("r").alias("block"), "doc_id", "bk", "row", (F.col("a") - F.col("lo")).alias("from_word"), (F.col("b") - F.col("a")).alias("n_words"))
    taken = pieces.groupBy("sid", "bk", "row").agg(F.sum("n_words").alias("taken"))
    documents = laid.join(taken, ["sid", "bk", "row"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(sources.select("sid", "source", "source_size", "target"), pieces, documents)
