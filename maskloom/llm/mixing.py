"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source. The total budget of tokens is handed down: a node shares its budget among its
children by their weights, none getting more than its subtree can supply (its tokens times the epochs allowed). What a
child cannot use goes to its siblings, by their weights; because a node is never given more than its subtree can supply,
a shortage reaches an ancestor's other branches only when all siblings are full.

A leaf's documents are ordered anew for each epoch by a hash of (seed, epoch, doc_id); full epochs take all of them, the last
one the prefix whose tokens stay within the budget. The prefix ends at a value of that hash, found from sums over ranges of
it: no leaf is ever sorted or gathered in one task, so one source may hold any share of the rows. Documents with equal
hashes (repeated rows) stand or fall together.

The driver holds one row for each leaf, at most `MOST_LEAVES`.

Defined results: a null domain, language or source is a leaf of its own; null and empty texts are 1 token; leaves or nodes
with weight 0 get nothing; an empty table gives an empty result; a null doc_id has a hash as any other; other columns are
carried, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

MOST_LEAVES, RANGE_BITS = 200_000, 12


def token_count(text: Column) -> Column:
    """Words of [^ \\t-\\r]+ and one end."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long") + 1


@dataclass
class Node:
    weight: float
    supply: int = 0
    children: dict[str | None, Node] = field(default_factory=dict)
    budget: float = 0.0


def share(budget: float, children: list[Node]) -> None:
    """Water-filling: proportional to weights, capped by supply, shortages to siblings by their weights."""
    budget = min(budget, sum(c.supply for c in children if c.weight > 0))
    open_ = [c for c in children if c.weight > 0]
    while open_:
        total = sum(c.weight for c in open_)
        full = [c for c in open_ if budget * c.weight / total >= c.supply]
        if not full:
            for c in open_:
                c.budget = budget * c.weight / total
            return
        for c in full:
            c.budget = float(c.supply)
            budget -= c.supply
        open_ = [c for c in open_ if all(c is not f for f in full)]


def budgets(leaves: list[tuple[tuple[str | None, ...], int]], total: float, weights: dict[tuple[str | None, ...], float], alpha: float, epochs: int) -> dict[tuple[str | None, ...], float]:
    """Budget of each leaf. weights: of any node by its path; the others weigh their tokens to the power alpha."""
    if not leaves:
        return {}
    root, tokens = Node(1.0), {}
    for path, n in leaves:
        for i in range(len(path) + 1):
            tokens[path[:i]] = tokens.get(path[:i], 0) + n
    for path, _ in sorted(leaves, key=lambda x: [(v is not None, v or "") for v in x[0]]):
        node = root
        for i in range(1, len(path) + 1):
            at = path[:i]
            node = node.children.setdefault(path[i - 1], Node(float(weights.get(at, tokens[at] ** alpha)), tokens[at] * epochs))
    root.budget, todo, out = total, [((), root)], {}
    # a subtree supplies only what its branches with weight can use
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack += node.children.values()
    for node in reversed(order):
        if node.children:
            node.supply = sum(c.supply for c in node.children.values() if c.weight > 0)
    while todo:
        path, node = todo.pop()
        if node.children:
            share(node.budget, list(node.children.values()))
            todo += [((*path, k), c) for k, c in node.children.items()]
        else:
            out[path] = node.budget
    return out


def mix(docs: DataFrame, domain: Column | None = None, fraction: float = 0.8, total: float | None = None, weights: dict[tuple[str | None, ...], float] | None = None, alpha: float = 0.7, epochs: int = 1, seed: int = 29, copies: str = "copies", tokens: str = "n_tokens") -> DataFrame:
    """The documents, all columns kept, with `tokens` and `copies`: how often each is taken (0 to epochs), 0 included.

    total: tokens to take, `fraction` of the corpus unless given. weights: by path (domain,), (domain, lang) or
    (domain, lang, source). Every leaf's taken tokens are within its budget."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    names = {"d": "_domain", "h": "_hash"}
    while set(names.values()) & set(docs.columns):
        names = {k: v + "_" for k, v in names.items()}
    dom = F.lit("all") if domain is None else domain
    base = docs.withColumn(names["d"], dom.cast("string")).withColumn(tokens, token_count(F.col("text")))
    # of each document no more than its leaf, size and id: what the sums read
    slim = ws.cut(base.select(F.col(names["d"]).alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(tokens).alias("n"), F.col("doc_id").cast("long").alias("id")), "slim")
    path = ["domain", "lang", "source"]
    found = slim.groupBy(*path).agg(F.sum("n").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves: choose coarser sources")
    leaves = [((r["domain"], r["lang"], r["source"]), int(r["n"])) for r in found]
    size = dict(leaves)
    goal = fraction * sum(size.values()) if total is None else total
    got = budgets(leaves, goal, weights or {}, alpha, epochs)
    full = {p: min(epochs, int(b // size[p])) for p, b in got.items()}
    rest = {p: max(0.0, b - full[p] * size[p]) for p, b in got.items()}

    # one row a leaf, a bounded table; null-safe keys
    plan = spark.createDataFrame([(*p, full[p], float(rest[p])) for p in size] or [(None, None, None, 0, 0.0)], "domain string, lang string, source string, full int, rest double")
    order = lambda i, k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), k.cast("int"), i), 1)  # noqa: E731  63 bits
    # the value of the hash at which each leaf's prefix ends: ranges of it are narrowed, 12 bits at a time
    keyed = slim.alias("s").join(F.broadcast(plan).alias("p"), (F.col("s.domain").eqNullSafe(F.col("p.domain"))) & F.col("s.lang").eqNullSafe(F.col("p.lang")) & F.col("s.source").eqNullSafe(F.col("p.source")))
    keyed = ws.cut(keyed.select("s.domain", "s.lang", "s.source", "n", order(F.col("id"), F.col("full")).alias("h")), "keyed")
    ends: dict[tuple, tuple[int, float]] = {p: (0, rest[p]) for p in size}  # hash below which all are taken, budget left in the open range
    for shift in range(63 - RANGE_BITS, -RANGE_BITS, -RANGE_BITS):
        low = max(shift, 0)
        width = RANGE_BITS if shift >= 0 else RANGE_BITS + shift
        open_ = spark.createDataFrame([(*p, e, float(b)) for p, (e, b) in ends.items()] or [(None, None, None, 0, 0.0)], "domain string, lang string, source string, low long, left double")
        x = keyed.alias("k").join(F.broadcast(open_).alias("o"), F.col("k.domain").eqNullSafe(F.col("o.domain")) & F.col("k.lang").eqNullSafe(F.col("o.lang")) & F.col("k.source").eqNullSafe(F.col("o.source")))
        inside = (F.col("h") >= F.col("low")) & (F.shiftrightunsigned(F.col("h") - F.col("low"), low + width) == 0) if low + width < 63 else F.col("h") >= 0
        sums = x.where(inside).groupBy("k.domain", "k.lang", "k.source", "low", "left", F.shiftrightunsigned(F.col("h") - F.col("low"), low).cast("int").alias("r")).agg(F.sum("n").alias("n"))
        # within a leaf at most 2^12 ranges: running sums stay small
        w = Window.partitionBy(*path).orderBy("r")
        run = sums.withColumn("upto", F.sum("n").over(w)).groupBy(*path, "low", "left").agg(F.min(F.when(F.col("upto") > F.col("left"), F.col("r"))).alias("r"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("taken"))
        new, moved = {}, False
        for r in run.collect():
            p = (r["domain"], r["lang"], r["source"])
            if r["r"] is None:  # all of the open range fits
                new[p] = (r["low"] + (1 << (low + width)) if low + width < 63 else (1 << 63) - 1, 0.0)
            else:
                new[p] = (r["low"] + (r["r"] << low), r["left"] - r["taken"])
                moved = True
        ends |= new
        if not moved:
            break
    last = spark.createDataFrame([(*p, full[p], e) for p, (e, _) in ends.items()] or [(None, None, None, 0, 0)], "_m_domain string, _m_lang string, _m_source string, _m_full int, _m_end long")
    joined = base.join(F.broadcast(last), F.col(names["d"]).eqNullSafe(F.col("_m_domain")) & F.col("lang").cast("string").eqNullSafe(F.col("_m_lang")) & F.col("source").cast("string").eqNullSafe(F.col("_m_source")))
    n = F.col("_m_full") + (order(F.col("doc_id").cast("long"), F.col("_m_full")) < F.col("_m_end")).cast("int")
    return joined.withColumn(copies, n).select(*[F.col(f"`{c}`") for c in docs.columns if c not in (copies, tokens)], tokens, copies)


def source_domain(source: Column) -> Column:
    """A stand-in for a table of domains: four, by the digits that end a source's name."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("long") % 4, F.lit(0)).cast("string"))
