"""The trie of conversation prefixes by van Emde Boas recursion.

A trie of 2w levels is cut at depth w: its upper half is the trie of the first w turns, and under each prefix that is
cut there hangs a lower trie of the turns after it.  Both halves are cut again, all pieces of one size at once, until
single nodes are left.  A cut prefix is named by the name of the piece's root and the block of w turns between, so the
node at depth d is named by its ancestor at depth d - w and the w turns since, where w is the lowest set bit of d, and
a block by its two halves.  Equal prefixes meet by name.

Totals come back the same way.  At width w the totals of the lower tries, complete within their pieces by then, are
grafted to the w nodes above each cut prefix; after the last width every node holds the sum over its subtree.  Each
width makes half a row for each node, and no task sees more than one block of a conversation.

The cuts up to SPAN turns are made inside rows that hold SPAN turns of a conversation, the wider ones by joins of such
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hot import most_of, spread_join
from tidemark.llm.storage import partitions, written

SPAN = 64
NAME_BYTES = 16
ROOT = bytes(NAME_BYTES)
ROWS_OF_RANGE = 1 << 21
IDS_OF_CHUNK = 512
NOTHING = hashlib.sha256(b"").hexdigest()
PATHS = "name binary, conv_id bigint, depth bigint, parent binary, size bigint, ends boolean, above array<binary>"


def _hash(kind: bytes, left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(kind + left + right).digest()[:NAME_BYTES]


def _hash_of(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value.cast("binary"), 256), 1, 2 * NAME_BYTES))


def _joined(kind: bytes, left: Column, right: Column) -> Column:
    """The same hash as _hash."""
    return _hash_of(F.concat(F.lit(kind), left, right))


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, key, size) of every turn: its place from 0, a hash of role and text, and the code points of its text.

    Turns go by number, null first, those of one number by their key; null role or text is empty; rows without conv_id
    belong to no conversation and are left out.  Places are counted in ranges of all turns, so a conversation may be long.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = _hash_of(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", key.alias("key"), F.char_length(text).cast("bigint").alias("size"))
    ranges = max(partitions(spark), conversations.count() // ROWS_OF_RANGE)
    order = ["conv_id", "turn", "key"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            head = np.flatnonzero(np.append(True, np.diff(conv) != 0))
            place = np.arange(len(conv)) - np.repeat(head, np.diff(np.append(head, len(conv))))
            if conv[0] == last:
                place[: head[1] if len(head) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            columns = [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int64)), pa.array(place), batch.column("key"), batch.column("size")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "place", "key", "size"])

    sorted_turns = turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = written(sorted_turns.mapInArrow(placed, "conv_id bigint, part bigint, place bigint, key binary, size bigint"), "turns")
    # a conversation that crosses a border of ranges starts anew after it: there are fewer of those than ranges
    counts = rows.groupBy("conv_id", "part").count()
    crossing = counts.join(counts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), "conv_id")
    upto = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part"))
    before = crossing.select("conv_id", "part", (upto - F.col("count")).alias("before"))
    return rows.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "key", "size")


def _border_names(full: DataFrame) -> DataFrame:
    """(conv_id, seg, name): the names of the prefixes of SPAN * seg turns, from blocks (conv_id, seg, block) of SPAN turns.

    Blocks are joined pairwise up to the widest; names are made from the widest cut down.
    """
    spark = full.sparkSession
    most = full.agg(F.max("seg")).first()[0]
    names = spark.createDataFrame([], "conv_id bigint, seg bigint, name binary")
    if most is None:
        return names
    levels = [full]
    while most + 1 >= 2 << (len(levels) - 1):
        pairs = levels[-1].groupBy("conv_id", F.expr("seg div 2").alias("half")).agg(F.array_sort(F.collect_list(F.struct("seg", "block"))).alias("two")).where("size(two) = 2")
        levels.append(written(pairs.select("conv_id", F.col("half").alias("seg"), _joined(b"b", F.col("two")[0]["block"], F.col("two")[1]["block"]).alias("block")), "blocks"))
    for k in reversed(range(len(levels))):
        cut = levels[k].where("seg % 2 = 0").select("conv_id", F.expr(f"seg * {1 << k}").alias("from"), "block")
        upper = names.select("conv_id", F.col("seg").alias("from"), "name")
        named = cut.join(upper, ["conv_id", "from"], "left")
        new = named.select("conv_id", F.expr(f"from + {1 << k}").alias("seg"), _joined(b"n", F.coalesce("name", F.lit(ROOT)), F.col("block")).alias("name"))
        names = written(names.unionByName(new), "border-names")
    return names


def _block(keys: list[bytes]) -> bytes:
    return keys[0] if len(keys) == 1 else _hash(b"b", _block(keys[: len(keys) // 2]), _block(keys[len(keys) // 2 :]))


def _names(root: bytes, keys: list[bytes], width: int) -> list[bytes]:
    """The names of the nodes along keys in a piece of so many levels under root, root first."""
    if width == 1:
        return [root]
    half = width // 2
    names = _names(root, keys[: half - 1], half)
    return names + _names(_hash(b"n", root, _block(keys[:half])), keys[half:], half) if len(keys) >= half else names


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each row of up to SPAN turns leads to, and the root once for each conversation."""
    kind = pa.schema([("name", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("size", pa.int64()), ("ends", pa.bool_()), ("above", pa.list_(pa.binary()))])
    for batch in batches:
        out: list[list] = [[] for _ in kind.names]
        for conv, seg, turns, name, border, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "turns", "name", "border", "last"))):
            turns.sort(key=lambda t: t["position"])
            names = _names(name or ROOT, [t["key"] for t in turns][: SPAN - 1], SPAN)
            if border is not None:
                names.append(border)
            base = seg * SPAN
            if base == 0:
                for column, value in zip(out, (ROOT, conv, 0, None, 0, False, None)):
                    column.append(value)
            for r in range(1, len(names)):
                low = (base + r) & -(base + r)
                above = names[r - low : r] if low <= r else None
                ends = last and r == len(names) - 1
                for column, value in zip(out, (names[r], conv, base + r, names[r - 1], turns[r - 1]["size"], ends, above)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(name, conv_id, depth, parent, size, ends, above): every conversation's nodes, its root included.

    above are the names of the lowest-set-bit-of-depth nodes over it, from the top; null where that is more than SPAN.
    """
    segs = turns.groupBy("conv_id", F.expr(f"position div {SPAN}").alias("seg")).agg(F.collect_list(F.struct("position", "key", "size")).alias("turns"))
    segs = written(segs, "segments")
    keys = F.transform(F.array_sort("turns"), lambda t: t["key"])
    full = segs.where(F.size("turns") == SPAN).select("conv_id", "seg", keys.alias("keys"))
    for _ in range(SPAN.bit_length() - 1):
        halves = F.transform(F.sequence(F.lit(0), F.size("keys") - 2, F.lit(2)), lambda i: _joined(b"b", F.get("keys", i), F.get("keys", i + 1)))
        full = full.withColumn("keys", halves)
    borders = _border_names(written(full.select("conv_id", "seg", F.element_at("keys", 1).alias("block")), "blocks"))
    own = borders.select("conv_id", "seg", "name")
    after = borders.select("conv_id", (F.col("seg") - 1).alias("seg"), F.col("name").alias("border"))
    going = segs.where("seg > 0").select("conv_id", (F.col("seg") - 1).alias("seg"), F.lit(False).alias("last"))
    rows = segs.join(own, ["conv_id", "seg"], "left").join(after, ["conv_id", "seg"], "left").join(going, ["conv_id", "seg"], "left")
    rows = rows.withColumn("last", F.coalesce("last", F.lit(True))).select("conv_id", "seg", "turns", "name", "border", "last")
    silent = ids.join(segs.where("seg = 0").select("conv_id"), "conv_id", "left_anti")
    silent = silent.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("ends"), F.lit(None).cast("array<binary>").alias("above"))
    return written(rows.mapInArrow(_paths, PATHS).unionByName(silent), "paths")


def _level() -> Column:
    """The exponent of the lowest set bit of depth; -1 at the root."""
    low = F.col("depth").bitwiseAND(-F.col("depth"))
    return F.when(F.col("depth") == 0, F.lit(-1)).otherwise(F.round(F.log2(low.cast("double"))).cast("int"))


def _grafted(nodes: DataFrame, along: DataFrame, depth: int) -> list[DataFrame]:
    """(name, level, leaves, saved): what each width adds to the nodes above its cuts; level is that of nodes that are cuts later on."""
    grafts: list[DataFrame] = []
    for k in range(max(depth, 0).bit_length()):
        width = 1 << k
        cut = nodes.where(F.col("level") == k)
        sums = cut.select("name", "conv_id", "depth", "above", "leaves", "saved")
        for g in grafts:
            sums = sums.unionByName(g.where(F.col("level") == k).select("name", "leaves", "saved"), allowMissingColumns=True)
        if grafts:
            sums = sums.groupBy("name").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.first("above", ignorenulls=True).alias("above"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        if width <= SPAN:
            up = sums.select((F.col("depth") - width).alias("top"), "leaves", "saved", F.posexplode("above").alias("i", "name")).select("name", (F.col("top") + F.col("i")).alias("depth"), "leaves", "saved")
        else:
            segs = F.sequence(F.expr(f"(depth - {width}) div {SPAN}"), F.expr(f"depth div {SPAN} - 1"))
            reach = sums.select("conv_id", F.explode(segs).alias("seg"), "leaves", "saved")
            up = along.select("conv_id", F.expr(f"depth div {SPAN}").alias("seg"), "name", "depth").join(reach, ["conv_id", "seg"]).select("name", "depth", "leaves", "saved")
        level = F.when(F.col("depth") % (2 * width) == 0, _level()).otherwise(F.lit(-1))
        added = up.groupBy("name").agg(F.max(level).alias("level"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        grafts.append(written(added, "grafts"))
    return grafts


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to IDS_OF_CHUNK sorted ids of one name, joined by commas."""
    for batch in batches:
        names, ids = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
        heads, lo = [], 0
        for hi in range(1, len(names) + 1):
            if hi == len(names) or names[hi] != names[lo] or hi - lo == IDS_OF_CHUNK:
                heads.append((names[lo], ids[lo], ",".join(map(str, ids[lo:hi]))))
                lo = hi
        columns = list(zip(*heads)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["name", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each name's chunks, read in order with one open hash."""
    name, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for of, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if of != name:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = of, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield _digest_rows(done)
    if name is not None:
        yield _digest_rows([(name, digest.hexdigest())])


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["name", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the hash of the ids of the conversations that end at each node, ascending, joined by commas.

    Ids are sorted and joined to chunks in ranges; only chunks of a node, a row for IDS_OF_CHUNK ids, go through one task, one after another.
    """
    ranges = partitions(ends.sparkSession)
    chunks = ends.repartitionByRange(ranges, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_chunked, "name binary, first bigint, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digests, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node of the trie of the conversations ids, from their turns (conv_id, position, key, size).

    conv_id is a node's smallest member, n_convs its members, n_leaves and saved_tokens are sums over its subtree of
    childless nodes and of (n_convs - 1) * size, ends_sha256 digests the members that end there.  Conversations without
    turns are members of the root alone; without conversations there is no node.  Positions of a conversation count
    from 0 without gaps, ids are unique and not null.
    """
    along = paths(turns, ids)
    grouped = along.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("depth").alias("depth"),
        F.max("size").alias("size"), F.first("parent", ignorenulls=True).alias("parent"), F.first("above", ignorenulls=True).alias("above"),
    )
    nodes = grouped.withColumns({"leaves": (F.col("n_ends") == F.col("n_convs")).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("size"), "level": _level()})
    nodes = written(nodes.drop("n_ends", "size"), "nodes", by=["level"])
    depth = int(nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])
    each = nodes.select("name", "leaves", "saved", F.lit(0).alias("children"))
    for g in _grafted(nodes, along, depth):
        each = each.unionByName(g.select("name", "leaves", "saved", F.lit(0).alias("children")))
    each = each.unionByName(nodes.where("depth > 0").select(F.col("parent").alias("name"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"), F.lit(1).alias("children")))
    totals = each.groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children"))
    digests = ends_digests(along.where("ends").select("name", "conv_id"))
    rows = nodes.select("name", "parent", "conv_id", "depth", "n_convs").join(totals, "name").join(digests, "name", "left")
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    most, n = most_of(nodes.where("parent is not null"), "parent")
    rows = spread_join(rows, parents, ["parent"], "name", most, n, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
