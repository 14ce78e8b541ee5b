"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles (the whole sequence where it has fewer words), hashed to 64 bits by one
function. Equal sets form a class; classes are linked where the Jaccard index of their full sets reaches the threshold.

1. One Arrow pass makes, for each document, the set's size, its 128-bit digest and its bottom-k sketch.
2. Classes: documents with equal digests, led by their smallest doc_id. Copies are never paired.
3. Candidates come from inverted lists over retained values. A value retained by more than `HOT` classes is hot.
   - Every class is listed under its cold values: such lists have HOT members at most, so the pairs grow with the input.
     Pairs that overlap in MEET values are candidates.
   - Classes with many hot values among their smallest (large groups of near copies; short texts around a passage that many
     documents share) are also listed under pairs of minima of sketch bins. Long lists of those are first resolved around
     a hub: the member nearest to the others is compared with all, so a group of m near copies costs about m comparisons,
     not m * m. Where then HOT members at most are outside a list's largest component, those are compared with all. The
     members of the other lists, where they are few in all (FEW, FEW_VALUES), are compared with each other on their full sets.
     Otherwise the lists are split: their members are listed anew under more and longer keys (4, 8, then 12 minima of SLOTS slots
     of the full set). Documents that merely mix the same passages part at once. What the longest keys do not split is
     compared in blocks, members of different components alone.
4. The union of two sketches estimates the Jaccard index; pairs below the threshold by more than 5 standard errors go.
5. The remaining pairs are verified on their full sets, recomputed from the two texts.
6. Linked classes meet in components by minimum labels with pointer jumping: on the driver up to HELD links, beyond that in DataFrames.

Of 24 retained values at least 16 are cold, and a pair at the threshold of 0.85 shares fewer than MEET of them with a
probability of about 1e-6 at worst; with fewer cold values the second kind of list applies (16 keys, each shared with a probability over 0.7: miss below 1e-8).

Defined results: null, empty and blank texts have an empty set, link with nothing and stay; repeated rows and equal
texts fall in one class; rows with a null doc_id are returned with a null component_id and kept = true, unlinked;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, chunks, few_tasks, hash64, mix64, word_codes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK, K, PREFIX, HOT, MEET, BINS = 1_000_000, 64, 24, 48, 3, 32
#: How many of its long lists, by key, a member meets the hub of: most lists of a group have the same hub.
HUBS = 4
#: Of the longer keys that split long lists: minima in a key, and slots that they are of.
DEPTHS, SLOTS = (4, 8, 12), 128
BLOCK = 1024
#: Members of open lists, and values of theirs, up to which they are compared with each other at once.
FEW, FEW_VALUES = 4096, 1_000_000
#: Links that the driver joins to components itself (16 bytes each), and ids that it gathers for a filter (8 bytes each).
HELD = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    codes, lens, uniq = word_codes(WORDS.findall(ascii_lower(t)) if t else [] for t in texts)
    words = hash64(uniq)[codes] if len(uniq) else np.empty(0, np.uint64)

    def rolled(x: np.ndarray, w: int) -> np.ndarray:
        h = np.full(max(0, len(x) - w + 1), w, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(w):
                h = mix64(h * _GOLD + x[j : j + len(h)])
        return h

    whole, out, at = rolled(words, size), [], 0  # of all texts end to end; each takes its own
    for n in lens.tolist():
        h = np.sort(whole[at : at + n - size + 1] if n >= size else rolled(words[at : at + n], n) if n else words[:0])
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
        at += n
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _sketcher(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK):
            sets = shingle_sets(b.column("text").to_pylist(), size)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), np.int64).reshape(-1, 2)
            # hashes as signed numbers of the same order
            sketches = [(s[:k] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
            values = pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, sketches)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(offsets, values)], schema=_SKETCH)

    return run


def _exploder(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK):
            sets = shingle_sets(b.column("text").to_pylist(), size)
            reps = np.repeat(b.column("rep").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "v"])

    return run


def estimate(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard index as the k smallest values of the union show it: the share of them that both sketches have."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for big in batches:
            for b in chunks([big], CHUNK, "b_text"):
                ids_a, a_texts = b.column("a").to_pylist(), b.column("a_text")
                fresh, need = [], {}
                for i, x in enumerate(ids_a):
                    if x != last[0] and x not in need:
                        need[x] = len(fresh)
                        fresh.append(a_texts[i].as_py())
                sets_a, sets_b = shingle_sets(fresh, size), shingle_sets(b.column("b_text").to_pylist(), size)
                own, keep = dict(zip(need, sets_a)) | {last[0]: last[1]}, []  # rows come in any order
                for x, s in zip(ids_a, sets_b):
                    both = len(np.intersect1d(own[x], s, assume_unique=True))
                    keep.append(100 * both >= percent * (len(own[x]) + len(s) - both))
                last = (ids_a[-1], own[ids_a[-1]])
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _only(texts: DataFrame, ids: DataFrame, most_bits: int = 26) -> DataFrame:
    """(rep, text) of the texts whose doc_id is, or seems to be, among ids (rep): a Bloom filter of bounded size (8 MB) keeps
    the other texts out of the shuffle. An exact join follows; beyond the bound it only lets more through."""
    n = ids.count()
    bits = min(most_bits, max(10, (16 * n).bit_length()))
    h = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    mask, hashed = np.zeros(1 << (bits - 6), np.int64), ids.select(h(F.col("rep")).alias("h"))
    if n <= HELD:  # as they are, without a shuffle
        at = hashed.toArrow()["h"].to_numpy()
        np.bitwise_or.at(mask, at >> 6, np.int64(1) << (at & 63))
    else:
        got = hashed.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m")).toPandas()
        mask[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("h").to_numpy()
            keep = (mask[at >> 6] >> (at & 63)) & 1
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("text")], names=["rep", "text"]).filter(pa.array(keep.astype(bool)))

    return texts.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text", h(F.col("doc_id")).alias("h")).mapInArrow(run, "rep long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, rows: int | None = None) -> DataFrame:
    """pairs (a, b), `rows` at most, of class leaders whose full sets reach the threshold."""
    with_b = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text")), "a")
    return few_tasks(both.select("a", "b", "a_text", "b_text"), rows).mapInArrow(_verifier(size, percent), "a long, b long")


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links (u, v), each once, and the smallest end that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (label[x] != label[y]).any():
        a, b = label[x], label[y]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return nodes, nodes[label]


def components(ws: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for every end of a link: the smallest node reachable. Up to HELD links meet on the driver; more are joined,
    where each round halves the distance."""
    if links.count() <= HELD:
        got = links.select("a", "b").toArrow()
        nodes, label = smallest_reachable(got["a"].to_numpy(), got["b"].to_numpy())
        return ws.cut(ws.spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(label, pa.int64())})), name, len(nodes))
    both = ws.cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = ws.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = ws.cut(new.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), f"{name}-{step}")
        moved = new.where("old <> label").limit(1).count()
        ws.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if not moved:
            return labels


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.drop("label").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _open(lists: DataFrame) -> DataFrame:
    """key and m, its members, of lists with members in different components."""
    return lists.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "m")


def _scarce(full: DataFrame) -> DataFrame:
    """v, rep and held, the sets with v, of the values that HOT sets at most have. A partition gives HOT + 1 rows of a value at
    most to the shuffle, so what all sets have in common costs no more than the rest."""
    by = Window.partitionBy("v")
    first = full.withColumn("place", F.row_number().over(by.orderBy("rep"))).where(F.col("place") <= HOT + 1)
    return first.withColumn("held", F.count("*").over(by)).where(F.col("held") <= HOT).select("v", "rep", "held")


def _packer(size: int):
    """rep, text, label -> rep, label and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK):
            sets = shingle_sets(b.column("text").to_pylist(), size)
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "label", "vs"])

    return run


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """How many values each set of xs has in common with each of ys: products of 0/1 matrices, `wide` values at a time."""
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the values in `both`, by column."""
        v, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0))
        has = both[at] == v if len(both) else np.zeros(len(v), bool)
        order = np.argsort(at[has], kind="stable")
        return row[has][order], at[has][order]

    (xr, xc), (yr, yc) = cells(xs), cells(ys)
    out = np.zeros((len(xs), len(ys)), np.float32)  # exact below 2 ** 24
    for lo in range(0, len(both), wide):
        m = []
        for r, c, n in ((xr, xc, len(xs)), (yr, yc, len(ys))):
            a, b = np.searchsorted(c, [lo, lo + wide])
            m.append(np.zeros((n, min(wide, len(both) - lo)), np.float32))
            m[-1][r[a:b], c[a:b] - lo] = 1
        out += m[0] @ m[1].T
    return out


def _crossed(sets: DataFrame, members: int, percent: int) -> DataFrame:
    """Links (a, b) between sets (rep, label, vs) of different labels, every pair compared on its full sets: blocks of about
    BLOCK meet two by two."""
    blocks = -(-members // BLOCK)

    def run(t: pa.Table) -> pa.Table:
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        rep, label, place = (t[c].to_numpy() for c in ("rep", "label", "place"))
        vs = [np.asarray(x.values) for x in t["vs"]]
        n = np.array([len(v) for v in vs])
        i, j = np.flatnonzero(place == p), np.flatnonzero(place == q)
        if not len(i) or not len(j):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = shared_counts([vs[k] for k in i], [vs[k] for k in j]).astype(np.int64)
        linked = (100 * both >= percent * (n[i][:, None] + n[j][None, :] - both)) & (label[i][:, None] != label[j][None, :])
        if p == q:
            linked &= rep[i][:, None] < rep[j][None, :]
        x, y = np.nonzero(linked)
        a, b = rep[i[x]], rep[j[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    placed = sets.withColumn("place", F.pmod(F.xxhash64("rep"), F.lit(blocks).cast("long")))
    cells = placed.withColumn("other", F.explode(F.array(*[F.lit(i).cast("long") for i in range(blocks)])))
    return cells.select("rep", "label", "place", "vs", F.least("place", "other").alias("p"), F.greatest("place", "other").alias("q")).groupBy("p", "q").applyInArrow(run, "a long, b long")


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Each list's members with its hub, the one whose values most others have."""
    hubs = lists.groupBy("key").agg(F.max_by("rep", F.struct("central", F.negate("rep"))).alias("hub"))
    return lists.join(hubs, "key").where("hub <> rep").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def _could(x: Column, y: Column, percent: int) -> Column:
    """Whether two members of a list may be linked and aren't yet: by component, sizes, and values shared at most."""
    enough = F.least(x["shared"], y["shared"]) * (100 + percent) >= (x["n"] + y["n"]) * percent
    return (x["label"] != y["label"]) & (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & enough


def _mates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within lists of HOT members at most: key, r (array of rep, n, shared, label)."""
    one = lists.select(F.explode("r").alias("x"), "r")
    return one.select(F.col("x.rep").alias("a"), F.explode(F.transform(F.filter("r", lambda y: (y["rep"] > F.col("x.rep")) & _could(F.col("x"), y, percent)), lambda y: y["rep"])).alias("b"))


def tables_for(depth: int, percent: int) -> int:
    """So many keys of `depth` minima that a pair somewhat below the threshold shares none with a probability of 1e-6."""
    return math.ceil(math.log(1e-6) / math.log(1 - (percent / 100 - 0.04) ** depth))


def _signer(size: int):
    """rep, text -> rep, sig: the least value in each of SLOTS slots of the full set. An empty slot borrows the value of another,
    in an order that is the slot's own."""
    rng = np.random.default_rng(SLOTS)
    detours = np.stack([rng.permutation(SLOTS) for _ in range(SLOTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK):
            sigs = np.zeros((b.num_rows, SLOTS), np.uint64)
            for i, s in enumerate(shingle_sets(b.column("text").to_pylist(), size)):
                slot, first = np.unique((s % np.uint64(SLOTS)).astype(np.int64), return_index=True)  # sets are sorted
                has = np.zeros(SLOTS, bool)
                has[slot], sigs[i, slot] = True, s[first]
                lender = np.where(has, np.arange(SLOTS), detours[np.arange(SLOTS), has[detours].argmax(axis=1)])
                sigs[i] = sigs[i, lender]
            offsets = pa.array(np.arange(0, (b.num_rows + 1) * SLOTS, SLOTS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(offsets, pa.array(sigs.ravel().view(np.int64)))], names=["rep", "sig"])

    return run


def _keyer(depth: int, tables: int):
    """Rows with a signature -> a row for each key, of `depth` of its slots."""
    rng = np.random.default_rng(depth)
    picks = np.stack([rng.permutation(SLOTS)[:depth] for _ in range(tables)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                part = big.slice(at, 128)
                sig = part.column("sig").flatten().to_numpy().view(np.uint64).reshape(part.num_rows, SLOTS)
                key = np.broadcast_to(np.arange(tables, dtype=np.uint64), (part.num_rows, tables))
                with np.errstate(over="ignore"):
                    for j in range(depth):
                        key = mix64(key * _GOLD + sig[:, picks[:, j]])
                again = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), tables))
                yield pa.RecordBatch.from_arrays([*map(again, _MEMBER), pa.array(np.tile(np.arange(tables), part.num_rows)), pa.array(key.ravel().view(np.int64))], names=[*_MEMBER, "i", "key"])

    return run


_MEMBER = ["rep", "n", "shared", "central", "label"]


def _deep_lists(signatures: DataFrame, members: DataFrame, depth: int, percent: int) -> DataFrame:
    """members under longer keys: a row for each key."""
    rows = members.join(signatures, "rep").select(*_MEMBER, "sig")
    return rows.mapInArrow(_keyer(depth, tables_for(depth, percent)), ", ".join(f"{c} long" for c in [*_MEMBER, "i", "key"]))


def _parted(lists: DataFrame) -> DataFrame:
    """key, m (members), big (the label of most) and rest (members with others) of lists of more than one component."""
    x = lists.groupBy("key", "label").count().groupBy("key").agg(F.sum("count").alias("m"), F.max(F.struct("count", "label")).alias("t"))
    return x.select("key", "m", F.col("t.label").alias("big"), (F.col("m") - F.col("t.count")).alias("rest")).where("rest > 0")


def _rest_pairs(lists: DataFrame, percent: int, once: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) of a list's members outside its largest component with all others: `lists` joined with _parted. Both sides
    are dealt into blocks of about BLOCK that meet two by two, so no list is one task's. once: the columns of a member's
    keys and of this one's place; a pair then counts under the first key that both have."""
    of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("rep"), of(n)).cast("int")
    one = F.struct("rep", "n", "shared", "label", *(once or []))
    left = lists.where("label <> big").select("key", "big", place("rest").alias("q"), F.explode(F.sequence(F.lit(0), of("m") - 1)).alias("p"), one.alias("x"))
    right = lists.select("key", place("m").alias("p"), F.explode(F.sequence(F.lit(0), of("rest") - 1)).alias("q"), one.alias("y"))
    met = (F.col("y.label") == F.col("big")) | (F.col("x.rep") < F.col("y.rep"))
    if once:
        keys, at = once
        met = met & ~F.exists(F.arrays_zip(F.col(f"x.{keys}").alias("x"), F.col(f"y.{keys}").alias("y"), F.sequence(F.lit(0), F.lit(BINS // 2 - 1)).alias("at")), lambda z: (z["x"] == z["y"]) & (z["at"] < F.col(f"x.{at}")))
    pairs = left.join(right, ["key", "p", "q"]).where(met & _could(F.col("x"), F.col("y"), percent))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = ws.cut(texts.mapInArrow(_sketcher(size, k), "doc_id long, n long, d1 long, d2 long, sketch array<long>"), "sketch")
    usable = sketched.where("n > 0 and doc_id is not null")
    # the leader's sketch, from the leader's own row
    classes = ws.cut(usable.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch")), "classes", sketched.count())
    n_classes = classes.count()

    values = classes.select("rep", "n", F.explode(F.slice("sketch", 1, PREFIX)).alias("v"))
    hot = ws.cut(values.groupBy("v").agg(F.count("*").alias("held")).where(F.col("held") > HOT), "hot", n_classes * PREFIX // HOT)
    marked = values.join(hot, "v", "left")
    info = classes.select("rep", "n", "sketch")
    a, b = info.toDF("a", "na", "sa"), info.toDF("b", "nb", "sb")
    error = 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate(F.col("sa"), F.col("sb"), k) >= percent / 100 - error)

    paired = lambda x: x.where(F.size("reps") > 1).select(F.explode("reps").alias("a"), "reps").select("a", F.explode(F.filter("reps", lambda x: x > F.col("a"))).alias("b")).distinct()
    # a pair at the threshold shares most cold values of its ends; chance pairs seldom share MEET, or differ in size
    cold = marked.where("held is null").groupBy("v").agg(F.collect_list(F.struct("rep", "n")).alias("r")).where(F.size("r") > 1)  # HOT members at most
    sized = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    mates = cold.select(F.explode("r").alias("x"), "r").select(F.col("x.rep").alias("a"), F.explode(F.transform(F.filter("r", lambda y: (y["rep"] > F.col("x.rep")) & sized(F.col("x"), y)), lambda y: y["rep"])).alias("b"))
    pairs = mates.groupBy("a", "b").count().where(F.col("count") >= MEET).select("a", "b")

    # classes with many hot values: lists under pairs of minima of sketch bins
    leader_texts = lambda e: _only(texts, e).join(e, "rep", "left_semi").dropDuplicates(["rep"])
    crowded = ws.cut(marked.groupBy("rep", "n").agg(F.count("held").alias("hot"), F.count("*").alias("all"), F.avg("held").alias("held")).where("3 * hot > all").select("rep", "n", "held"), "crowded", n_classes)
    n_crowded = crowded.count()
    # Two crowded sets either share a cold value of theirs, or no more than their hot values. Values that more than HOT
    # sets have are set aside (they are n - own of a set).
    scarce = ws.cut(_scarce(leader_texts(crowded.select("rep")).mapInArrow(_exploder(size), "rep long, v long")), "scarce")
    counted = scarce.groupBy("rep").agg(F.count("*").alias("own"), F.sum((F.col("held") == 1).cast("long")).alias("only"))
    own = crowded.join(counted, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("only", F.coalesce("only", F.lit(0)))
    # central: how well a set is known, as its common values and the mean count of the hot ones among its smallest tell
    own = ws.cut(own.select("rep", "n", "own", "only", ((F.col("n") - F.col("own")) * F.col("held")).cast("long").alias("central")), "own", n_crowded)
    room = F.col("n") * (100 - percent)
    able = own.where(F.col("only") * 100 <= room).select("rep")
    rare = scarce.where("held > 1").join(able, "rep", "left_semi").groupBy("v").agg(F.collect_list("rep").alias("reps"))
    minima = lambda s: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.array_min(F.filter(s, lambda x: F.pmod(x, F.lit(BINS)) == i)))
    dense = ws.cut(classes.select("rep", "sketch").join(own.where(F.col("own") * 100 <= room), "rep").withColumn("m", minima(F.col("sketch"))).drop("sketch"), "dense", n_crowded)
    keys = F.transform(F.sequence(F.lit(0), F.lit(BINS // 2 - 1)), lambda i: F.when(F.coalesce(F.element_at("m", i * 2 + 1), F.element_at("m", i * 2 + 2)).isNotNull(), F.xxhash64(i, F.element_at("m", i * 2 + 1), F.element_at("m", i * 2 + 2))))  # empty bins say nothing
    dense = ws.cut(dense.withColumn("keys", keys).drop("m"), "keyed")
    listed = ws.cut(dense.select("rep", "n", (F.col("n") - F.col("own")).alias("shared"), "central", "keys", F.posexplode("keys").alias("i", "key")).where("key is not null"), "listed")
    n_listed = listed.count()
    counts = listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    short = listed.join(counts.where(F.col("m") <= HOT), "key", "left_semi").groupBy("key").agg(F.collect_list("rep").alias("reps"))
    long_lists = ws.cut(listed.join(counts.where(F.col("m") > HOT), "key", "left_semi"), "long", n_listed)
    # candidates of all kinds meet their sketches once
    met = pairs.union(paired(rare)).union(paired(short)).union(_hub_pairs(long_lists.where(F.col("i") < HUBS))).distinct()

    first = ws.cut(met.join(a, "a").join(b, "b").where(alike).select("a", "b"), "pairs")
    n_first = first.count()
    ends = ws.cut(first.select(F.col("a").alias("rep")).union(first.select("b")).distinct(), "linked", 2 * n_first)
    end_texts = ws.cut(leader_texts(ends), "ends", ends.count())
    links = ws.cut(_verified(first, end_texts, size, percent, n_first), "links")
    ws.drop("ends")
    labels = components(ws, links)

    tried, parts = first, None
    if not long_lists.isEmpty():
        placed = ws.cut(_labelled(long_lists, labels), "placed", n_listed)
        parts = ws.cut(_parted(placed), "parted", n_listed // HOT)
    if parts is not None and not parts.isEmpty():
        members = ws.cut(placed.join(parts, "key", "left_semi").select("rep", "n", "label").distinct(), "open", n_crowded)
        n_open, n_values = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_open <= FEW and n_values <= FEW_VALUES:
            sets = few_tasks(leader_texts(members.select("rep")).join(members.select("rep", "label"), "rep"), n_open).mapInArrow(_packer(size), "rep long, label long, vs array<long>")
            more = ws.cut(_crossed(sets, n_open, percent), "crossed")
            if not more.isEmpty():
                labels = components(ws, links.union(more), "cc-crossed")
            parts = None
    if parts is not None and not parts.isEmpty():
        few = placed.join(parts.where(F.col("rest") <= HOT), "key")
        found = _rest_pairs(few, percent, ["keys", "i"])
        members = placed.join(parts.where(F.col("rest") > HOT), "key", "left_semi").select("rep").distinct()
        for depth in (*DEPTHS, None):
            found = ws.cut(found.join(tried, ["a", "b"], "left_anti").join(a, "a").join(b, "b").where(alike).select("a", "b"), f"found{depth}")
            tried = tried.union(found)
            ends = found.select(F.col("a").alias("rep")).union(found.select("b")).distinct()
            more = ws.cut(_verified(found, leader_texts(ends), size, percent), f"more{depth}")
            if not more.isEmpty():
                links = links.union(more)
                labels = components(ws, links, f"cc{depth}")
            if members is None or depth is None:
                break
            members = ws.cut(_labelled(members.join(own, "rep").select("rep", "n", (F.col("n") - F.col("own")).alias("shared"), "central"), labels).select(*_MEMBER), f"members{depth}")
            if members.isEmpty():
                break
            if depth == DEPTHS[0]:
                signatures = ws.cut(leader_texts(members.select("rep")).mapInArrow(_signer(size), "rep long, sig array<long>"), "signatures")
            lists = ws.cut(_deep_lists(signatures, members, depth, percent), f"lists{depth}")
            counts = _open(lists)
            mates = lists.join(counts.where(F.col("m") <= HOT), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("rep", "n", "shared", "label")).alias("r"))
            rest = ws.cut(lists.join(counts.where(F.col("m") > HOT), "key", "left_semi"), f"long{depth}")
            # a pair at the threshold shares many keys: of the short lists two, or most of its lists are long and it goes on
            found = _mates(mates, percent).groupBy("a", "b").count().where("count > 1").select("a", "b").union(_hub_pairs(rest.where(F.col("i") < 2 * HUBS))).distinct()
            members = rest.select("rep").distinct()
            if depth == DEPTHS[-1]:  # what no key has split
                found = found.union(_rest_pairs(rest.join(_parted(rest), "key"), percent)).distinct()
                members = None

    members = usable.select("d1", "d2", "n", "doc_id").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select("doc_id", "n", "rep")
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    alone = sketched.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
