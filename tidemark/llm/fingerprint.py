"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is the multiset of its paragraphs: the non-empty pieces between line breaks and sentence ends.  Each paragraph
hashes to a wide vector and a text's vector is the sum, so order doesn't matter and paragraphs can be added or taken
away.  A vector is the number of paragraphs and, for each of two hashes, the sums of its two halves and 32 packed pairs
of bit counts.  The sums (printed modulo 2**32) with the counts give equality; the 128 bit counts (printed modulo 2**16)
give likeness: twice a count less the number of paragraphs is a sum of random signs, so the cosine of two such vectors
estimates the share of paragraphs in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import partitions, text_bytes, written

PARAGRAPH_BREAK = r"\n|(?<=[.!?]) "
LOW = 0xFFFFFFFF
PAIR = 0x0000000100000001
HASHES = 2
LANES = 2 + 32  # of one hash: its two halves, then bits i and i + 32 for i from 0 to 31
FIRST_ID = -(1 << 63)  # where a null doc_id sorts: after all others in descending order
RANGE_KEYS = 1 << 21


def vector(text: Column) -> Column:
    """The summed vector of one text as a column, 1 + 2 * 34 longs, for adding and taking away; `summed` does whole tables. An empty text has the zero vector. No sum can overflow: a string has under 2**31 pieces."""
    pieces = F.filter(F.split(text, PARAGRAPH_BREAK), lambda x: x != "")
    sums = [F.aggregate(F.transform(pieces, _salted(k)), F.array(*[F.lit(0).cast("long")] * LANES), _added) for k in range(HASHES)]
    return F.concat(F.array(F.size(pieces).cast("long")), *sums)


def _salted(k: int) -> Callable[[Column], Column]:
    return lambda x: F.xxhash64(F.lit(k), x)


def _added(sums: Column, h: Column) -> Column:
    """One step over all lanes: a single lambda call for each paragraph."""
    return F.array(*[F.get(sums, F.lit(i)) + x for i, x in enumerate(_lanes(h))])


def _lanes(h: Column) -> list[Column]:
    lanes = [h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)]
    return lanes + [F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR)) for i in range(32)]


def _wide(v: Column) -> Column:
    return F.concat(*[F.slice(v, 2 + k * LANES, 2) for k in range(HASHES)])


def _pairs(v: Column) -> Column:
    return F.concat(*[F.slice(v, 4 + k * LANES, 32) for k in range(HASHES)])


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector of both multisets together, or with sign -1 of left without right (which must be part of it)."""
    return F.zip_with(left, right, lambda a, b: a + b * F.lit(sign))


def printed(v: Column) -> Column:
    """The vector as fixed-width lowercase hex: the number of paragraphs and wide sums modulo 2**32, bit counts modulo 2**16."""
    wide = F.transform(F.concat(F.slice(v, 1, 1), _wide(v)), lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(LOW))), 8, "0"))
    pairs = F.transform(_pairs(v), lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0x0000FFFF0000FFFF))), 16, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(pairs, "")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of common paragraphs that the bit counts estimate; equal vectors 1, an empty against another text 0."""
    dot = _signed_dot(a, b)
    norm = F.sqrt(_signed_dot(a, a) * _signed_dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / norm))).otherwise(F.lit(0.0))


def _signed_dot(a: Column, b: Column) -> Column:
    na, nb = F.get(a, F.lit(0)).cast("double"), F.get(b, F.lit(0)).cast("double")

    def each(x: Column, y: Column) -> Column:
        low = (x.bitwiseAND(F.lit(LOW)) * F.lit(2.0) - na) * (y.bitwiseAND(F.lit(LOW)) * F.lit(2.0) - nb)
        return low + (F.shiftrightunsigned(x, 32) * F.lit(2.0) - na) * (F.shiftrightunsigned(y, 32) * F.lit(2.0) - nb)

    return F.aggregate(F.zip_with(_pairs(a), _pairs(b), each), F.lit(0.0), lambda s, x: s + x)


def _hashes(text: Column) -> Column:
    """Both hashes of each paragraph."""
    pieces = F.filter(F.split(text, PARAGRAPH_BREAK), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(*[F.xxhash64(F.lit(k), x).alias(f"h{k}") for k in range(HASHES)]))


def summed(rows: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """(keys, vectors): the vectors of several columns of paragraph hashes, in order.

    Paragraphs become rows and every lane a sum of its own, so the work runs in generated code, and where rows already
    lie by some of the keys no shuffle follows.
    """
    each = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("hs")) for i, c in enumerate(hashes)])).alias("x"))
    each = each.select(*keys, "x.kind", F.explode_outer("x.hs").alias("p")).select(*keys, "kind", *[f"p.h{k}" for k in range(HASHES)])
    lanes = [x for k in range(HASHES) for x in _lanes(F.col(f"h{k}"))]
    sums = each.groupBy(*keys, "kind").agg(F.count("h0").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)])
    v = F.array("n", *[F.coalesce(f"s{i}", F.lit(0)) for i in range(len(lanes))])
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", v.alias("v")))), lambda x: x["v"]).alias("vectors"))


def followers(keyed: DataFrame, n_rows: int) -> DataFrame:
    """(r, h, c, n, next_r, next_h): each distinct (r, h), its rows and code points, and what follows it in order, after the last the first.

    Only keys are sorted, in ranges; the first key of each range goes to the range before (a row for each range).
    """
    spark = keyed.sparkSession
    keys = keyed.groupBy("r", "h").agg(F.count(F.lit(1)).alias("c"), F.max(F.char_length("text")).alias("n"))
    ranges = max(partitions(spark), n_rows // RANGE_KEYS)
    keys = written(keys.repartitionByRange(ranges, "r", "h").withColumn("b", F.spark_partition_id()), "ordered")
    rows = keys.withColumn("next", F.lead(F.struct("r", "h")).over(Window.partitionBy("b").orderBy("r", "h")))
    heads = keys.groupBy("b").agg(F.min(F.struct("r", "h")).alias("head"))
    along = Window.orderBy("b")
    heads = heads.select("b", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("next"))
    ends = rows.where("next is null").drop("next").join(heads, "b")
    both = rows.where("next is not null").unionByName(ends)
    return written(both.select("r", "h", "c", "n", F.col("next.r").alias("next_r"), F.col("next.h").alias("next_h")), "followers")


def with_next(docs: DataFrame) -> DataFrame:
    """(r, h, k, text, given, next_hashes): each document with what the next by descending doc_id gives it, after the last the first.

    given is the start of the next text, a third of the document's own code points long.  r and h are the order and
    identity of a document: the complement of its doc_id, and a hash of its text whose last bit tells a null doc_id; k
    tells equal ones apart.  Null texts are empty, a null doc_id comes last, documents of one doc_id go by h, and equal
    rows follow one another.
    """
    text, none = F.coalesce("text", F.lit("")), F.col("doc_id").isNull()
    o = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    h = F.shiftleft(F.shiftright(F.xxhash64(text), 1), 1).bitwiseOR(none.cast("long"))
    keyed = docs.select(F.bitwise_not(o).alias("r"), h.alias("h"), text.alias("text"))
    order = followers(keyed, text_bytes(docs)[0])
    repeated = (order.agg(F.max("c")).first()[0] or 0) > 1
    takers = order.select(F.col("next_r").alias("r"), F.col("next_h").alias("h"), F.col("r").alias("to_r"), F.col("h").alias("to_h"), "c", F.floor(F.col("n") / 3).cast("int").alias("cut"))
    # by merge joins on both sides, so that the texts are shuffled once for both
    gifts = keyed.join(takers.hint("merge"), ["r", "h"]).select(F.col("to_r").alias("r"), F.col("to_h").alias("h"), "c", F.expr("substring(text, 1, cut)").alias("given"), _hashes(F.col("text")).alias("next_hashes"))
    if not repeated:
        return keyed.join(gifts.hint("merge"), ["r", "h"]).withColumn("k", F.lit(1)).drop("c")
    rows = keyed.join(gifts.dropDuplicates(["r", "h"]).hint("merge"), ["r", "h"])
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("r", "h").orderBy("c")))
    again = F.col("k") < F.col("c")
    own = F.expr("substring(text, 1, cast(floor(char_length(text) / 3) as int))")
    return rows.withColumns({"given": F.when(again, own).otherwise(F.col("given")), "next_hashes": F.when(again, _hashes(F.col("text"))).otherwise(F.col("next_hashes"))}).drop("c")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of the code points replaced from the next document.

    Null text is empty.  One row comes back for each input row, other columns do not; an empty table gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), given)"))
    rows = rows.select("r", "h", "k", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _hashes(F.col("text")).alias("own_hashes"), _hashes(F.col("edited")).alias("edited_hashes"), "next_hashes")
    rows = summed(rows, ["r", "h", "k", "n_chars", "edited_sha256"], ["own_hashes", "edited_hashes", "next_hashes"])
    own, edited, following = (F.get("vectors", F.lit(i)) for i in range(3))
    return rows.select(
        F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, F.bitwise_not("r")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        printed(own).alias("fingerprint"),
        printed(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
    )
