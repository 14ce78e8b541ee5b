"""Sharding by a k-d tree over metadata.

The space has one axis for each of size (logarithm), language and source (hashes of their values, so an axis needs no
dictionary). A node is cut along the axis on which its documents spread widest, at the weighted median of bytes (for an
odd number of leaves in proportion), until each leaf is one shard. Positions on an axis are 31 bits of the coordinate and 32
of a tie-breaker, so a language or source that holds a third of all rows is cut like any other.

Equal texts are a group: they share the position of their first document (smallest doc_id) and stay in one shard. A group
heavier than `group_share` of a shard is one item with a weight: at each node such items are cut in the order of the axis, as
long as either side can hold its own, and the rest of the node is cut so that both sides come out even. There are at most
shards / group_share items, which the driver holds. Only groups that find no room in a shard spread by doc_id: those heavier
than a whole shard, and some of about that weight where there are more of them than shards.

Medians are found by sums over ranges of positions, narrowed 13 bits at a time: each round is one aggregation, of which the
driver sees one row for each open node. A tree is a table of cuts; applying it is a broadcast join of at most as
many rows as shards for each level. Slots are numbered from counts by (shard, bucket), so no shard is sorted in one task.

Law `bytes`: shards have nearly equal sums of sizes, off by no more than a group (or the largest document) at each cut.

Defined results: a null text has size 1 and belongs to the group of empty texts; null metadata has a position of its own;
repeated rows have slots of their own; an empty table gives an empty result; extra columns are kept by `shard_documents`,
whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

AXES, BINS = 3, 13


@dataclass
class Tree:
    """levels: for each depth (node, axis, cut, left, right); leaves are the shards' nodes."""

    levels: list[list[tuple[int, int, int, int, int]]] = field(default_factory=list)
    shards: dict[int, int] = field(default_factory=dict)  # node -> shard
    items: dict[bytes, int] = field(default_factory=dict)  # key of a heavy group -> shard


@dataclass
class Item:
    """A heavy group: key, bytes, positions on the axes."""

    key: bytes
    size: int
    at: list[int]


def _emptiest(items: list[Item], bins: int, room: float) -> list[int | None]:
    """For each item the bin it goes to, heaviest first and to the emptiest; None where it finds no room."""
    out: list[int | None] = [None] * len(items)
    loads = [(0, b) for b in range(bins)]
    for i in sorted(range(len(items)), key=lambda i: (-items[i].size, items[i].key)):
        load, b = loads[0]
        if load + items[i].size <= room:
            heapq.heapreplace(loads, (load + items[i].size, b))
            out[i] = b
    return out


def _divided(items: list[Item], axis: int, bins: int, room: float) -> tuple[list[Item], list[Item]]:
    """The items of a node's left and right side: cut in the order of the axis at the median where both sides can hold
    theirs, else as they pack into the node's shards."""
    half = bins // 2
    goal, before, n = sum(x.size for x in items) * half / bins, 0, 0
    ordered = sorted(items, key=lambda x: (x.at[axis], x.key))
    for x in ordered:
        if before + x.size / 2 > goal:
            break
        before, n = before + x.size, n + 1
    left, right = ordered[:n], ordered[n:]
    if None not in _emptiest(left, half, room) and None not in _emptiest(right, bins - half, room):
        return left, right
    packed = _emptiest(items, bins, room)
    return [x for x, b in zip(items, packed) if b is not None and b < half], [x for x, b in zip(items, packed) if b is None or b >= half]


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def _positions(size: Column, lang: Column, source: Column, tie: Column) -> Column:
    top = float(2**31 - 1)
    hashed = lambda c, seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), c.cast("string")), 33)
    axes = [F.floor(F.least(F.log2(size.cast("double")) / 32, F.lit(1.0)) * top).cast("long"), hashed(lang, 1), hashed(source, 2)]
    low = F.shiftrightunsigned(F.xxhash64(F.lit(3), tie), 32)
    return F.array(*[F.shiftleft(a, 32).bitwiseOR(low) for a in axes])


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _slim(docs: DataFrame, *more: Column) -> DataFrame:
    """What placing reads of a document: id, key of its text, size, lang, source. Texts are not dealt around."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), _key(F.col("text")).alias("key"), _size(F.col("text")).alias("size"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *more)


def _groups(slim: DataFrame) -> DataFrame:
    """Texts that several rows have: key, first (document), size (of a row), bytes (of all)."""
    return slim.groupBy("key").agg(F.min(F.struct("id", "lang", "source")).alias("first"), F.max("size").alias("size"), F.sum("size").alias("bytes"), F.count("*").alias("n")).where("n > 1").drop("n")


def _items(groups: DataFrame, heaviest: int) -> list[Item]:
    at = _positions(F.col("size"), F.col("first.lang"), F.col("first.source"), F.xxhash64("key"))
    return [Item(bytes(r[0]), r[1], r[2]) for r in groups.where(F.col("bytes") > heaviest).select("key", "bytes", at).collect()]


def _placed(slim: DataFrame, groups: DataFrame, kept: dict[bytes, bool]) -> DataFrame:
    """slim, `at`, the positions on the axes, and `kept`: null but for rows of heavy groups, which stay together or don't.
    Rows of a group take the positions of its first document."""
    fates = slim.sparkSession.createDataFrame(list(kept.items()), "_kd_key binary, kept boolean")
    groups = groups.select("key", "first").join(F.broadcast(fates), F.col("key") == F.col("_kd_key"), "left").drop("_kd_key")
    grouped = F.col("first").isNotNull()
    tie = F.when(~F.col("kept"), F.xxhash64("key", "id")).otherwise(F.xxhash64("key"))
    own = lambda c: F.when(grouped, F.col(f"first.{c}")).otherwise(F.col(c))
    return slim.join(groups, "key", "left").withColumn("at", _positions(F.col("size"), own("lang"), own("source"), tie)).drop("first")


def _descend(rows: DataFrame, level: list[tuple[int, int, int, int, int]], at: Column, node: str) -> DataFrame:
    spark = rows.sparkSession
    cuts = spark.createDataFrame(level, "_kd_c_node int, _kd_c_axis int, _kd_c_cut long, _kd_c_left int, _kd_c_right int")
    x = rows.join(F.broadcast(cuts), F.col(node) == F.col("_kd_c_node"), "left")
    to = F.when(F.col("_kd_c_node").isNull(), F.col(node)).when(F.element_at(at, F.col("_kd_c_axis") + 1) < F.col("_kd_c_cut"), F.col("_kd_c_left")).otherwise(F.col("_kd_c_right"))
    return x.withColumn(node, to).drop("_kd_c_node", "_kd_c_axis", "_kd_c_cut", "_kd_c_left", "_kd_c_right")


def _medians(rows: DataFrame, goals: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node (axis, bytes wanted on the left) the cut whose left side comes nearest. A round sums bytes by range of
    positions and finds, on the cluster, the range that reaches the goal: the driver sees one row for each open node."""
    spark = rows.sparkSession
    state = {n: (0, 0) for n in goals}  # start of the open range, bytes before it
    out: dict[int, int] = {}
    for shift in (50, 37, 24, 11, 0):
        width = min(BINS, 63 - shift) if shift else 11
        open_ = [(n, goals[n][0], lo, before, float(goals[n][1])) for n, (lo, before) in state.items() if n not in out]
        if not open_:
            break
        plan = spark.createDataFrame(open_, "node int, axis int, lo long, before long, goal double")
        x = rows.join(F.broadcast(plan), "node").withColumn("p", F.element_at("at", F.col("axis") + 1) - F.col("lo"))
        x = x.where((F.col("p") >= 0) & (F.shiftrightunsigned("p", shift + width) == 0)) if shift + width < 63 else x
        sums = x.groupBy("node", "before", "goal", F.shiftrightunsigned("p", shift).cast("int").alias("b")).agg(F.sum("size").alias("w"))
        run = sums.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("node").orderBy("b")))  # at most 2 ** BINS rows a node
        got = {r[0]: r for r in run.where("upto >= goal").groupBy("node").agg(F.min(F.struct("b", "w", "upto")).alias("r")).select("node", "r.b", "r.w", "r.upto").collect()}
        for n, _, lo, _, goal in open_:
            if n not in got:
                out[n] = lo + (1 << (shift + width)) if shift + width < 63 else (1 << 63) - 1
                continue
            _, b, w, upto = got[n]
            start = lo + (b << shift)
            if shift == 0:  # a single position: to the side that is nearer
                out[n] = start if goal - (upto - w) <= upto - goal else start + 1
            else:
                state[n] = (start, upto - w)
    return out


def build(rows: DataFrame, leaves: int, items: list[Item] = (), room: float = 0) -> Tree:
    """rows: size, at. The tree with `leaves` leaves. items go to leaves as a whole; `room` is what a leaf can hold of them."""
    ws = Workspace(rows.sparkSession, "kd")
    tree, open_, following, depth = Tree(), {0: (0, leaves)}, 1, 0  # node -> first shard, number of shards
    held = {0: list(items)}  # node -> its heavy groups
    rows = ws.cut(rows.withColumn("node", F.lit(0)), "level0")
    while True:
        for n, (first, k) in list(open_.items()):
            if k == 1:
                tree.shards[n] = first
                tree.items |= {x.key: first for x in held.pop(n)}
                del open_[n]
        if not open_:
            return tree
        spread = [F.max(F.shiftrightunsigned(F.element_at("at", i + 1), 32)) - F.min(F.shiftrightunsigned(F.element_at("at", i + 1), 32)) for i in range(AXES)]
        seen = {r[0]: r for r in rows.groupBy("node").agg(F.sum("size"), *spread).collect()}
        goals, sides = {}, {}
        for n, (_, k) in open_.items():
            r = seen.get(n)
            widest = max(range(AXES), key=lambda i: (r[2 + i], -i)) if r else 0
            own = held.pop(n)
            sides[n] = _divided(own, widest, k, room)
            light = r[1] if r else 0
            wanted = (light + sum(x.size for x in own)) * (k // 2) / k - sum(x.size for x in sides[n][0])
            goals[n] = (widest, min(max(wanted, 0), light))
        cuts = _medians(rows, goals)
        level, new = [], {}
        for n, (first, k) in open_.items():
            left, right = following, following + 1
            following += 2
            level.append((n, goals[n][0], cuts[n], left, right))
            new[left], new[right] = (first, k // 2), (first + k // 2, k - k // 2)
            held[left], held[right] = sides[n]
        tree.levels.append(level)
        open_, depth = new, depth + 1
        rows = ws.cut(_descend(rows, level, F.col("at"), "node"), f"level{depth}")
        ws.drop(f"level{depth - 1}")


def _numbered(ws: Workspace, slim: DataFrame, shards: int | None, target_bytes: int | None, group_share: float, per_bucket: int) -> DataFrame:
    """slim and shard, slot."""
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    groups = ws.cut(_groups(slim), "groups")
    room = total / shards
    items = _items(groups, int(room * group_share))
    bins = _emptiest(items, shards, room)
    placed = ws.cut(_placed(slim, groups, {x.key: b is not None for x, b in zip(items, bins)}), "placed")
    tree = build(placed.where("kept is null or not kept").select("size", "at"), shards, [x for x, b in zip(items, bins) if b is not None], room)
    x = placed.withColumn("node", F.lit(0))
    for level in tree.levels:
        x = _descend(x, level, F.col("at"), "node")
    leaves = slim.sparkSession.createDataFrame(list(tree.shards.items()), "_kd_leaf int, _kd_shard int")  # a row for each shard
    x = x.join(F.broadcast(leaves), F.col("node") == F.col("_kd_leaf"), "left")
    whole = slim.sparkSession.createDataFrame(list(tree.items.items()), "_kd_item binary, _kd_at int")
    x = x.join(F.broadcast(whole), F.col("key") == F.col("_kd_item"), "left")
    x = x.withColumn("shard", F.coalesce("_kd_at", "_kd_shard")).drop("node", "at", "kept", "_kd_item", "_kd_at", "_kd_leaf", "_kd_shard")
    buckets = max(1, n // shards // per_bucket)
    x = ws.cut(x.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")), "sharded")
    counts = x.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards * buckets rows
    start = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    w = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "key")
    return x.withColumn("i", F.row_number().over(w) - 1).join(start, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("i")).cast("long")).drop("i", "start", "bucket")


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, group_share: float = 0.02, names: tuple[str, str] = ("shard", "slot"), per_bucket: int = 4096) -> DataFrame:
    """The documents, all columns kept, with their shard and slot. shards: how many; else leaves of about target_bytes.
    Places are found on ids and keys; texts are shuffled once, to meet them."""
    ws = Workspace(docs.sparkSession, "shards")
    slim = ws.cut(_slim(docs), "slim")
    w = Window.partitionBy("id", "key").orderBy("shard", "slot")
    found = ws.cut(_numbered(ws, slim, shards, target_bytes, group_share, per_bucket).select("id", "key", "shard", "slot", F.row_number().over(w).alias("turn")), "found")
    k, i, t = "_kd_key", "_kd_id", "_kd_turn"
    x = docs.withColumn(k, _key(F.col("text"))).withColumn(i, F.col("doc_id").cast("long"))
    again = found.where("turn > 1").select(F.col("id").alias("_kd_a"), F.col("key").alias("_kd_b")).distinct()  # repeated rows
    if again.isEmpty():
        x = x.withColumn(t, F.lit(1))
    else:
        same = F.col(i).eqNullSafe(F.col("_kd_a")) & (F.col(k) == F.col("_kd_b"))
        once, many = x.join(again, same, "left_anti"), x.join(again, same, "left_semi")
        x = once.withColumn(t, F.lit(1)).union(many.withColumn(t, F.row_number().over(Window.partitionBy(i, k).orderBy(i))))
    place = found.select(F.col("id").alias("_kd_id2"), F.col("key").alias("_kd_key2"), F.col("turn").alias("_kd_turn2"), F.col("shard").cast("int").alias("_kd_shard"), F.col("slot").alias("_kd_slot"))
    met = x.join(place, (F.col(k) == F.col("_kd_key2")) & F.col(i).eqNullSafe(F.col("_kd_id2")) & (F.col(t) == F.col("_kd_turn2")))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], F.col("_kd_shard").alias(names[0]), F.col("_kd_slot").alias(names[1]))


def shard_plan(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's digest: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ws = Workspace(docs.sparkSession, "shards")
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    out = _numbered(ws, ws.cut(_slim(docs, crc.alias("crc")), "slim"), shards, None, 0.02, 4096)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
