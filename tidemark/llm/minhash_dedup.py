"""b-bit MinHash near-duplicates: bands of minima propose, packed low bits estimate, full shingle sets confirm.

1. One pass over the texts: shingle sets become set hashes (exact copies collapse), band keys, and signatures of the
   low bits of each minimum.
2. Every class representative is linked with the best estimated of the smallest members of its band buckets, if the
   full sets agree; these stars join most of each group of copies.
3. Only buckets that still hold several components are compared pairwise, in blocks of bounded size, and only across
   components.  Packed signatures go first: members without a partner whose collision-corrected estimate could reach
   the threshold drop out.  Full sets of those left follow, and confirm.
Components come from alternating large and small stars over written edge tables.  Hot buckets, leaders, stars, classes
and components are dealt to shares in every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import order_id
from tidemark.llm.hot import most_of, spread_join
from tidemark.llm.storage import written
from tidemark.llm.tokens import Words, blocks, mix, segment_hashes

SHINGLE = 5
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 4
PERMS = BANDS * ROWS
LANES = 64 // BITS
LONGS = PERMS // LANES
COLLIDE = 1.0 / (1 << BITS)
#: Least estimate of a pair that may have the similarity 0.75: five and a half standard deviations below.
LEAST_ESTIMATE = 0.75 - 5.5 * ((0.75 + 0.25 * COLLIDE) * 0.25 * (1 - COLLIDE) / PERMS) ** 0.5 / (1 - COLLIDE)
#: Members whose signatures, and bytes of shingle sets that, a task compares with as many others at once.
BLOCK_MEMBERS, BLOCK_BYTES = 8192, 2 << 20

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIPS = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)
_LANE_LOW = np.uint64(int("0001" * LANES, 2))
_FEATURES = "o long, print long, n long, s1 long, s2 long, bands array<long>, sig array<long>"
_SETS = "node long, shingles binary"


def shingle_sets(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first of each text + 1 end); fewer words than width are one shingle."""
    hashes = words.hashes(lower=True)
    grams, text, _ = words.windows(hashes, width)
    counts = words.counts
    few = np.flatnonzero((counts > 0) & (counts < width))
    whole = mix(segment_hashes(hashes, words.first[few], words.first[few + 1]), 100) + counts[few].astype(np.uint64) if len(few) else np.zeros(0, np.uint64)
    grams, text = np.concatenate([grams, whole]), np.concatenate([text, few])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(counts) + 1))


def minima(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, PERMS) minima; texts without shingles get the largest value."""
    out = np.full((len(first) - 1, PERMS), 0xFFFFFFFF, np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first))
    step = 1 << 13
    for at in range(0, len(low), step):
        to = min(at + step, len(low))
        a = np.searchsorted(first, at, side="right") - 1
        b = np.searchsorted(first, to, side="left")
        own = full[(full >= a) & (full < b)]
        values = (low[at:to, None] ^ _FLIPS) * _FACTORS
        values ^= values >> np.uint32(15)
        part = np.minimum.reduceat(values, np.maximum(first[own] - at, 0), axis=0)
        out[own] = np.minimum(out[own], part)
    return out


def set_hash(grams: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams, salt), out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def signatures(minimum: np.ndarray) -> np.ndarray:
    lanes = (minimum & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minimum), LONGS, LANES)
    return (lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(minimum), BANDS), np.uint64)
    parts = minimum.astype(np.uint64).reshape(len(minimum), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys ^ parts[:, :, r], r)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 9)


def estimates(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of one signature to many, corrected for low bits that agree by chance."""
    x = sig ^ others
    for shift in (1, 2):
        x |= x >> np.uint64(shift)
    differ = np.bitwise_count(x & _LANE_LOW).sum(axis=1)
    return ((1 - differ / PERMS) - COLLIDE) / (1 - COLLIDE)


def estimate(a: Column, b: Column) -> Column:
    """The same for two signature columns."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(int(_LANE_LOW))))

    total = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    return ((F.lit(1.0) - total / PERMS) - COLLIDE) / (1 - COLLIDE)


def similar(inter: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int) -> np.ndarray | bool:
    return 100 * inter >= PERCENT * (na + nb - inter)


def _nested(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def text_print() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """(o, n, s1, s2, bands, sig) of each row; rows without words have n = 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in blocks(batch.column("text")):
                grams, first = shingle_sets(words)
                least = minima(grams, first)
                n = np.diff(first)
                columns = [*(batch.column(c).slice(lo, hi - lo) for c in ("o", "print")), pa.array(n), pa.array(set_hash(grams, first, 7)), pa.array(set_hash(grams, first, 11)), _nested(band_keys(least)), _nested(signatures(least))]
                yield pa.RecordBatch.from_arrays(columns, names=["o", "print", "n", "s1", "s2", "bands", "sig"])

    return docs.select(order_id().alias("o"), text_print().alias("print"), "text").mapInArrow(run, _FEATURES)


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the full sets of the wanted (o, s1, s2, node), 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2 = (batch.column(c).to_numpy() for c in ("s1", "s2"))
            for lo, hi, words in blocks(batch.column("text")):
                grams, first = shingle_sets(words)
                own = (set_hash(grams, first, 7) == s1[lo:hi]) & (set_hash(grams, first, 11) == s2[lo:hi])
                at = np.flatnonzero(own)
                sets = [grams[first[i] : first[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(lo + at)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    texts = docs.select(order_id().alias("o"), "text").join(wanted, "o")
    return texts.select("node", "s1", "s2", "text").mapInArrow(run, _SETS)


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The written edges (a, b) whose full sets are similar; b may be hot."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = spread_join(both, sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), ["b"], "a", *most_of(edges, "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the edges, comp the smallest node reachable, by alternating stars until nothing moves."""
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    ends, before = written(ends, "edges"), None
    while True:
        after = ends.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or after[0] == 0:
            return ends.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(ends.select("v", "v").distinct())
        before = after
        both = ends.union(ends.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = _star(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = _star(large, least).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        ends = written(small.where("u > v").distinct(), "edges")


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with u's least neighbour m; a centre u may be hot."""
    most, rows = least.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return spread_join(edges, least.drop("n"), ["u"], "v", most, rows)


def in_blocks(placed: DataFrame, n_blocks: Column) -> DataFrame:
    """Bucket members (key, node, ...) once for each pair of blocks (i, j) of their bucket that theirs, `side`, is one of."""
    placed = placed.withColumn("__n", n_blocks.cast("long")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("__n")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return placed.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "__n")


def _candidates(node: np.ndarray, comp: np.ndarray, side: np.ndarray, size: np.ndarray, sigs: np.ndarray, i: int, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, its likely partners of other components in the other block, their estimates) of one block pair."""
    others = np.flatnonzero(side == j)
    for x in np.flatnonzero(side == i):
        ys = others[(comp[others] != comp[x]) & ((node[others] > node[x]) if i == j else True)]
        ys = ys[np.minimum(size[ys], size[x]) * 100 >= PERCENT * np.maximum(size[ys], size[x])]
        if len(ys):
            likely = estimates(sigs[x], sigs[ys])
            keep = likely >= LEAST_ESTIMATE
            if keep.any():
                yield int(x), ys[keep], likely[keep]


def _signatures_of(table: pa.Table) -> np.ndarray:
    return np.array(table.column("sig").to_pylist(), np.int64).view(np.uint64).reshape(-1, LONGS)


def active_members(key: tuple, table: pa.Table) -> pa.Table:
    """The members of one block pair of a bucket that have a likely partner in another component, by signatures alone."""
    columns = [table.column(c).to_numpy() for c in ("node", "comp", "side", "n")]
    active = np.zeros(table.num_rows, bool)
    for x, ys, _ in _candidates(*columns, _signatures_of(table), key[1].as_py(), key[2].as_py()):
        active[x] = True
        active[ys] = True
    return table.select(["key", "node", "comp", "n"]).filter(pa.array(active))


def cross_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links between different components of one block pair of a bucket, at most one for each pair of components met."""
    node, comp, side, size = (table.column(c).to_numpy() for c in ("node", "comp", "side", "n"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table.column("shingles").chunks for x in chunk]
    root = {int(c): int(c) for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    a, b = [], []
    for x, ys, likely in _candidates(node, comp, side, size, _signatures_of(table), key[1].as_py(), key[2].as_py()):
        for y in ys[np.argsort(-likely, kind="stable")]:
            p, q = find(int(comp[x])), find(int(comp[y]))
            if p != q and similar(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), size[x], size[y]):
                root[p] = q
                a.append(int(node[x]))
                b.append(int(node[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, first, print) of each row: whole texts, lower-cased A-Z, shingles of five words.

    component_id is the smallest doc_id reachable over links of similarity 0.75 or more.  Null or blank text has no
    shingles and no links.  Each row is a text of its own even where doc_ids repeat; rows without a doc_id take part in
    linking, and a component of such rows only has a null component_id.  `first` marks one row of each component, the
    smallest by doc_id.  Other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = written(features(docs).withColumn("node", F.monotonically_increasing_id()), "minhash")
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    reps = rows.join(classes.select(F.col("rep").alias("node")), "node")

    members = reps.select("node", F.explode("bands").alias("key"))
    leaders = written(members.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1"), "leaders")
    in_buckets = leaders.agg(F.coalesce(F.max("m"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()  # of the largest bucket, of all
    members = written(spread_join(members, leaders, ["key"], "node", *in_buckets), "buckets")  # (key, node, b, m): buckets of two or more
    pairs = written(members.where("node > b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    sigs = reps.select("node", "n", "sig")
    signed = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    signed = spread_join(signed, sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), ["b"], "a", *most_of(pairs, "b"))
    signed = signed.select("a", "b", estimate(F.col("sig_a"), F.col("sig_b")).alias("e")).where(F.col("e") >= LEAST_ESTIMATE)
    stars = written(signed.groupBy("a").agg(F.max(F.struct("e", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b")), "stars")

    wanted = rows.select("node", "o", "s1", "s2").join(members.select("node").distinct(), "node")
    sets = written(shingle_table(docs, wanted), "sets")
    links = written(confirmed(stars, sets), "links")
    found = written(components(links), "components")

    placed = members.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
    placed = spread_join(placed, mixed, ["key"], "node", *in_buckets).select("key", "node", "comp", "m")
    blocks_of = in_blocks(placed, F.ceil(F.col("m") / BLOCK_MEMBERS)).join(sigs, "node")
    active = written(blocks_of.groupBy("key", "i", "j").applyInArrow(active_members, "key long, node long, comp long, n long").distinct(), "active")
    sizes = written(active.groupBy("key").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count(F.lit(1)).alias("m")), "sizes")
    in_active = sizes.agg(F.coalesce(F.max("m"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    full = in_blocks(spread_join(active, sizes.drop("m"), ["key"], "node", *in_active), F.ceil(F.col("bytes") / BLOCK_BYTES)).drop("bytes")
    full = full.join(sets.join(sigs.drop("n"), "node"), "node")
    more = full.groupBy("key", "i", "j").applyInArrow(cross_links, "a long, b long")
    more = written(more.distinct(), "links")
    final = written(components(links.union(more)), "components")

    copies = classes.agg(F.coalesce(F.max("copies"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    labels = spread_join(rows.select("node", "o", "print", "n", "s1", "s2"), classes, ["s1", "s2", "n"], "node", *copies, how="left").withColumn("rep", F.coalesce("rep", "node"))
    labels = spread_join(labels, final.withColumnRenamed("node", "rep"), ["rep"], "node", *copies, how="left").withColumn("comp", F.coalesce("comp", "rep"))
    labels = written(labels.select("node", "o", "print", "n", "comp"), "labels")
    least = labels.groupBy("comp").agg(F.min(F.struct("o", "node")).alias("x"), F.count(F.lit(1)).alias("m"))
    least = written(least.select("comp", F.col("x.o").alias("least_o"), F.col("x.node").alias("least_node"), "m"), "least")
    in_groups = least.agg(F.coalesce(F.max("m"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    done = spread_join(labels, least.drop("m"), ["comp"], "node", *in_groups)
    ids = lambda c: F.when(F.col(c) != F.lit((1 << 63) - 1), F.col(c))
    done = done.select(ids("o").alias("doc_id"), F.col("n").alias("n_shingles"), ids("least_o").alias("component_id"), (F.col("node") == F.col("least_node")).alias("first"), "print")
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which near_duplicates marks one in each group as `first`."""
    found = near_duplicates(docs).where("first")
    keys = found.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__o"), F.col("print").alias("__print"))
    placed = docs.withColumns({"__o": order_id(), "__print": text_print()})
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    kept = placed.join(keys, ["__o", "__print"], "left_semi")
    return (kept.dropDuplicates(["__o", "__print"]) if ids < rows else kept).drop("__o", "__print")
