"""SimHash fingerprints, in DataFrame functions alone.

Terms are pairs of neighbouring words (of the lower-cased text; a last word stands alone), hashed to two 64-bit words, so a
fingerprint has 128 bits. A term votes once for each occurrence with its length, up to 31 characters, as its weight:
long, rare words say more about a text than articles. Votes are summed two bits to a long, (h >>> j) & 0x100000001
times the weight: 64 plain sums that stay in generated code. Bit i is set where its votes exceed half of the weight.

`near(...)` searches by block tables: with radius r the fingerprint is cut into r + 1 blocks (or more, of which `pick`
are joined to a key); two fingerprints within r bits agree on at least one key, so equi-joins on the permuted keys find
all of them and the distance decides. Equal fingerprints are one entry of the tables. A wide radius would need many short
blocks, which meet by chance; instead, of `blocks` blocks one differs by radius // blocks bits at most, so the queries, the
smaller side, also look up every key so close to theirs. The search stays exact. The keys are sorted, not broadcast: they
grow with the table.

Defined results: null, empty and blank texts have a fingerprint of zeros; repeated rows are separate rows, each other's
neighbours in order (ascending doc_id, then text; nulls first); other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

LANES = 0x100000001
BITS = 128
#: Chosen from the distances of near copies in sf0.1, see the README.
RADIUS = 16


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"[ \t-\r]+")
    return F.when(text.rlike(r"[^ \t-\r]"), F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")))


def _votes() -> tuple[list[Column], Column]:
    """The sums, and the total weight, over rows that have a term `t`."""
    w = F.when(F.col("t.a").isNull(), F.lit(0)).otherwise(F.least(F.length("t.a") + F.coalesce(F.length("t.b"), F.lit(0)), F.lit(31))).cast("long")
    sums = []
    for part in range(2):
        h = F.xxhash64("t.a", "t.b") if part == 0 else F.xxhash64("t.b", "t.a", F.lit(part))
        sums += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * w).alias(f"s{part}_{j}") for j in range(32)]
    return sums, F.sum(w).alias("total")


def _fingerprint(part: int) -> Column:
    """One 64-bit word of the fingerprint from the sums of a group."""
    bits = []
    for j in range(32):
        s = F.col(f"s{part}_{j}")
        for shift, votes in ((j, s.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(s, 32))):
            bits.append(F.shiftleft((votes * 2 > F.col("total")).cast("long"), shift))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def to_hex(*words: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and f1, f2: the fingerprint's two words. No shuffle where the input is dealt by some of the keys."""
    sums, total = _votes()
    terms = rows.select(*keys, F.explode_outer(_terms(F.col(text))).alias("t"))
    return terms.groupBy(*keys).agg(*sums, total).select(*keys, _fingerprint(0).alias("f1"), _fingerprint(1).alias("f2"))


def with_next(docs: DataFrame, per_bucket: int = 2048, most_buckets: int = 8192) -> DataFrame:
    """doc_id, text, next_text, and bucket, rid, next_rid: rows in ascending order, cut into buckets of about equal
    counts by quantiles of doc_id. The first rows of a bucket are also dealt to the one before it, so each bucket
    finds its neighbours alone: one shuffle, no global sort. The driver holds one bound and one id for each bucket."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))
    n = ids.count()
    k = max(1, min(most_buckets, -(-n // per_bucket)))
    bounds = sorted(set(ids.agg(F.percentile_approx("k", [i / k for i in range(1, k)] or [0.5], 20 * k)).first()[0] or [])) if k > 1 else []
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    steps = max(1, len(bounds).bit_length())
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else None

    def bucket(k: Column) -> Column:  # how many bounds are <= k, by halving
        if array is None:
            return F.lit(0)
        probe = lambda pos, by: F.when((pos + by <= len(bounds)) & (F.try_element_at(array, pos + by) <= k), pos + by).otherwise(pos)
        return F.aggregate(F.array(*[F.lit(1 << j) for j in range(steps - 1, -1, -1)]), F.lit(0), probe)

    firsts = sorted((r[0], r[1]) for r in ids.groupBy(bucket(F.col("k")).alias("b")).agg(F.min("k")).collect())
    # the first id of a bucket, and the bucket before it; the very first follows the last
    before = {b: (firsts[i - 1][0], first, i == 0) for i, (b, first) in enumerate(firsts)}
    rows = docs.withColumn("home", bucket(key))
    if before:
        home = F.create_map(*[F.lit(x) for b, v in before.items() for x in (b, v[0])])
        first = F.create_map(*[F.lit(x) for b, v in before.items() for x in (b, v[1])])
        is_first = F.element_at(first, F.col("home")) == key
        places = F.when(is_first, F.array(F.struct(F.col("home").alias("bucket"), F.lit(0).alias("copy")), F.struct(F.element_at(home, F.col("home")).alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("home").alias("bucket"), F.lit(0).alias("copy"))))
    else:
        places = F.array(F.struct(F.col("home").alias("bucket"), F.lit(0).alias("copy")))
    rows = rows.select("doc_id", "text", "home", F.explode(places).alias("p")).select("doc_id", "text", "home", "p.bucket", "p.copy")
    w = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    rid = lambda b, i: F.shiftleft(b.cast("long"), 40) + i
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("next", F.lead(F.struct("text", "copy", "home")).over(w))
    return rows.where("copy = 0").select(
        "bucket", rid(F.col("bucket"), F.col("i")).alias("rid"), "doc_id", "text", F.col("next.text").alias("next_text"),
        F.when(F.col("next.copy") == 1, rid(F.col("next.home"), F.lit(1))).otherwise(rid(F.col("bucket"), F.col("i") + 1)).alias("next_rid"),
    )


def block_keys(f1: Column, f2: Column, blocks: int, pick: int) -> Column:
    """One key for each choice of `pick` among `blocks` blocks of the 128 bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def part(lo: int, hi: int) -> list[Column]:
        if lo < 64 < hi:
            return part(lo, 64) + part(64, hi)
        word, at = (f1, lo) if hi <= 64 else (f2, lo - 64)
        n = hi - lo
        return [F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << n) - 1))] if n < 64 else [word]

    return F.array(*[F.xxhash64(F.lit(i), *[x for b in choice for x in part(edges[b], edges[b + 1])]) for i, choice in enumerate(combinations(range(blocks), pick))])


def least_probe(radius: int, blocks: int, pick: int = 1) -> int:
    """By how many bits the `pick` blocks that differ least can differ where fingerprints are within the radius."""
    q, s = divmod(radius, blocks)
    return pick * q + max(0, pick - (blocks - s))


def _flips(blocks: int, pick: int, probe: int) -> Column:
    """For each key, as structs of its number and two words, all ways to flip up to `probe` bits of its blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for i, choice in enumerate(combinations(range(blocks), pick)):
        places = [b for c in choice for b in range(edges[c], edges[c + 1])]
        for m in (sum(1 << b for b in flip) for k in range(probe + 1) for flip in combinations(places, k)):
            rows.append(f"named_struct('i', {i + 1}, 'm1', {signed(m & (1 << 64) - 1)}L, 'm2', {signed(m >> 64)}L)")
    return F.expr(f"array({', '.join(rows)})")


def near_pairs(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = RADIUS + 1, pick: int = 1, probe: int = 0) -> DataFrame:
    """The pairs within the radius, once each: q1, q2, a distinct fingerprint of `queries`, and f1, f2, one of `table`.

    More blocks with pick = 2 make keys longer and chance candidates rarer, for tables of billions of rows. With fewer
    blocks than the radius needs, queries also look up keys that differ from theirs by up to `probe` bits."""
    if probe < least_probe(radius, blocks, pick):
        raise ValueError("blocks - radius must be at least pick, or probe at least least_probe(...), or pairs would be lost")
    q = queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct()
    if probe:
        q = q.withColumn("x", F.explode(_flips(blocks, pick, probe)))
        flipped = block_keys(F.col("q1").bitwiseXOR(F.col("x.m1")), F.col("q2").bitwiseXOR(F.col("x.m2")), blocks, pick)
        q = q.select("q1", "q2", F.element_at(flipped, F.col("x.i")).alias("key"))
    else:
        q = q.withColumn("key", F.explode(block_keys(F.col("q1"), F.col("q2"), blocks, pick)))
    t = table.select("f1", "f2").distinct().withColumn("key", F.explode(block_keys(F.col("f1"), F.col("f2"), blocks, pick)))
    hits = q.join(t.hint("merge"), "key").where(distance(F.col("q1"), F.col("q2"), F.col("f1"), F.col("f2")) <= radius)
    return hits.select("q1", "q2", "f1", "f2").distinct()


def near(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = RADIUS + 1, pick: int = 1, probe: int = 0) -> DataFrame:
    """For each distinct fingerprint (f1, f2) of `queries`: n_within, the rows of `table` within the radius."""
    return _counted(near_pairs(queries, table, radius, blocks, pick, probe), table)


def _counted(pairs: DataFrame, table: DataFrame) -> DataFrame:
    rows = table.groupBy("f1", "f2").agg(F.count("*").alias("rows"))
    return pairs.join(rows, ["f1", "f2"]).groupBy(F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg(F.sum("rows").alias("n_within"))


def near_documents(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """Which documents are within the radius: doc_id (of `queries`), near_doc_id (of `table`) and their distance in bits; a
    document's own doc_id is left out, once. Both tables hold doc_id, f1, f2; repeated rows count as rows, and null ids
    stay. One row a pair of documents: large groups of near copies make as many as they have pairs with queries."""
    pairs = near_pairs(queries, table, radius, blocks, probe=least_probe(radius, blocks))
    asked = queries.select(F.col("doc_id"), F.col("f1").alias("q1"), F.col("f2").alias("q2"))
    w = Window.partitionBy("doc_id", "near_doc_id", "turn").orderBy("bits")
    asked = asked.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("q1", "q2")))
    met = asked.join(pairs, ["q1", "q2"]).join(table.select(F.col("doc_id").alias("near_doc_id"), "f1", "f2"), ["f1", "f2"])
    met = met.withColumn("bits", distance(*map(F.col, ("q1", "q2", "f1", "f2")))).withColumn("i", F.row_number().over(w))
    return met.where(~((F.col("i") == 1) & F.col("doc_id").eqNullSafe(F.col("near_doc_id")))).select("doc_id", "near_doc_id", F.col("bits").cast("int").alias("bits"))


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """The contract's digest of the operator: fingerprints of texts and of texts whose end is replaced by the next one's
    beginning, the likeness of both, and for every 100th doc_id the number of other documents within the radius."""
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next_text", cut))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select("bucket", "rid", "next_rid", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"))
    keys = ["bucket", "rid", "next_rid", "doc_id", "n_chars", "edited_sha256"]
    both = fingerprints(rows.select(*keys, "x.which", "x.text"), [*keys, "which"])
    one = lambda f, k: F.max(F.when(F.col("which") == k, F.col(f)))
    made = ws.cut(both.groupBy(*keys).agg(one("f1", 0).alias("f1"), one("f2", 0).alias("f2"), one("f1", 1).alias("e1"), one("f2", 1).alias("e2")), "fingerprints")
    following = made.select(F.col("rid").alias("next_rid"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    queries = made.where("doc_id % 100 = 0")
    found = near(queries, made, radius, blocks, probe=least_probe(radius, blocks))
    like = lambda *x: F.lit(1.0) - distance(*map(F.col, x)) / BITS
    out = made.join(following, "next_rid").join(found, ["f1", "f2"], "left")
    asked = F.col("doc_id") % 100 == 0
    return out.select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("f1"), F.col("f2")).alias("fingerprint"), to_hex(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        like("f1", "f2", "e1", "e2").alias("near_edited"), like("f1", "f2", "n1", "n2").alias("near_next"), F.when(asked, F.col("n_within") - 1).alias("n_near"),
    )
