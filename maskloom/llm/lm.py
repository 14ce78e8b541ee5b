"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

    P(w | v) = l2[b(v)] * c(v, w) / c(v) + l1[b(v)] * c(w) / N + l0[b(v)] / (V + 1)

Counts come from training documents alone. b(v) buckets contexts by the logarithm of their frequency; each bucket's
weights are learned by expectation-maximisation on held-out counts: every training bigram is held out in turn, so its
estimates are (c(v,w)-1) / (c(v)-1), (c(w)-1) / (N-1) and 1 / (V+1) (the uniform part leaves room for unseen words).

How it is spread out, for corpora whose vocabulary and bigrams no machine can hold:
1. Documents are cut into blocks of about `BLOCK` characters; a block is tokenised once and written as a dictionary of word
   hashes and compressed codes.
2. Each block asks for the counts of its distinct words, then bigrams: per shard of the hash range one message of sorted
   hashes with the block's training counts. A shard adds them up and answers with an array of totals in the same order.
   Messages are aggregated before the shuffle; a word however frequent is one entry of each block's message.
3. Weights: each block's bigrams fall in cells (context bucket, quantised logarithms of both estimates); the sums by cell
   are a bounded grid, which is all that the driver sees.
4. Blocks meet their answers again and score their documents.
Every step is a Spark job over written tables, so a lost executor costs the tasks it ran.

Defined results: null and empty texts have one token, the end; rows without doc_id count as id 'null' in the hash that
holds documents out, and are scored; repeated rows are separate documents; other columns are ignored. Words are of any
length. With no training document all counts are 0 and the weights stay uniform, so each token has 1 / (V + 1) = 1 as V = 0
from each part that is defined.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, Workspace, ascii_lower, chunks, hash64, mix64

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK = 6_000_000
END = "\n"  # no word can be this
_END_HASH = hash64([END])[0]
STEP = 4  # cells per octave of an estimate
BUCKETS = 40


def held_out(doc_id: int | None, parts: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"null") % parts == fold


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers and sorted differences take few bytes."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).tobytes(), dtype) if raw else np.empty(0, dtype)


def _blocks(parts: int, fold: int):
    """Rows of the blocks table. Block ids are hashes of the documents' contents and ids; one task's blocks never meet another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, serial = TaskContext.get(), 0
        ids: list[int | None] = []
        parts_of: list[np.ndarray] = []
        known, size = Codes(), 0

        def block() -> pa.RecordBatch:
            nonlocal serial
            codes, lens = np.concatenate(parts_of), np.fromiter(map(len, parts_of), np.int64, len(parts_of))
            order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")  # frequent words get small codes
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words = hash64(known)[order]
            serial += 1
            row = {"block": [ctx.partitionId() * 1_000_000 + serial], "ids": [ids], "held": [[held_out(i, parts, fold) for i in ids]], "lens": [pack(lens.astype(np.uint32))], "words": [words.tobytes()], "codes": [pack(rank[codes].astype(np.uint32))]}
            return pa.RecordBatch.from_pydict(row, schema=_BLOCKS)

        for b in chunks(batches, BLOCK // 8):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                t = t.as_py()
                words = [*WORDS.findall(ascii_lower(t)), END] if t else [END]
                ids.append(i)
                parts_of.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(t or "") + 1
                if size >= BLOCK:
                    yield block()
                    ids, parts_of, known, size = [], [], Codes(), 0
        if ids:
            yield block()

    return run


_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])
_BLOCKS_DDL = "block long, ids array<long>, held array<boolean>, lens binary, words binary, codes binary"


class _Block:
    """A block's tokens: codes of words and of their contexts, which documents they belong to, which are training's."""

    def __init__(self, ids, held, lens, words, codes):
        self.ids, self.held = ids, np.array(held, dtype=bool)
        self.lens = unpack(lens, np.uint32).astype(np.int64)
        self.words, self.code = np.frombuffer(words, np.uint64), unpack(codes, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.train = ~self.held[self.doc]
        end = np.flatnonzero(self.words == _END_HASH)[0]
        self.context = np.empty_like(self.code)  # a text begins after an end
        self.context[1:] = self.code[:-1]
        self.context[np.cumsum(self.lens) - self.lens] = end

    def bigrams(self):
        """(sorted distinct hashes, training counts, index of each token's bigram, code of context, of word of each)."""
        pair = self.context * len(self.words) + self.code
        codes, uniq = pd.factorize(pair)
        v, w = np.divmod(uniq, len(self.words))
        with np.errstate(over="ignore"):
            h = mix64(self.words[v] * np.uint64(0x9E3779B97F4A7C15) + mix64(self.words[w]))
        order = np.argsort(h)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        index = rank[codes]
        return h[order], np.bincount(index, weights=self.train, minlength=len(h)).astype(np.uint32), index, v[order], w[order]

    def unigrams(self):
        """Sorted hashes, training counts, and the order that sorts the dictionary."""
        order = np.argsort(self.words)
        n = np.bincount(self.code, weights=self.train, minlength=len(self.words)).astype(np.uint32)
        return self.words[order], n[order], order


def _edges(shards: int) -> np.ndarray:
    """Where the shards of the hash range begin, but for the first."""
    return np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)


def _messages(block: int, h: np.ndarray, n: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """One message per shard that any of the sorted hashes falls in: never more than hashes, however many shards there are."""
    of = np.searchsorted(edges, h, side="right")
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    rows = {"shard": [], "block": [], "hashes": [], "counts": []}
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
        for k, x in zip(rows, (int(of[lo]), block, pack(np.diff(h[lo:hi], prepend=np.uint64(0))), pack(n[lo:hi]))):
            rows[k].append(x)
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))


def _ask(kind: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(shards)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                block = _Block(*(r[k] for k in ("ids", "held", "lens", "words", "codes")))
                h, n = block.unigrams()[:2] if kind == "word" else block.bigrams()[:2]
                yield _messages(r["block"], h, n, edges)

    return run


def _answer(kind: str):
    """A shard's messages -> for each block the totals of what it asked for; for words also the shard's own sums."""

    def run(messages: pa.Table) -> pa.Table:
        messages = messages.combine_chunks().sort_by("block")
        hashes = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in messages["hashes"].to_pylist()]
        counts = [unpack(x, np.uint32) for x in messages["counts"].to_pylist()]
        codes, uniq = pd.factorize(np.concatenate(hashes))
        total = np.bincount(codes, weights=np.concatenate(counts).astype(np.float64), minlength=len(uniq)).astype(np.uint64)
        mine = total[codes]
        ends = np.cumsum([len(x) for x in hashes])
        small = np.uint32 if not len(total) or total.max() < 1 << 32 else np.uint64
        out = [b"%d" % np.dtype(small).itemsize + pack(x.astype(small)) for x in np.split(mine, ends[:-1])]
        blocks, shard = messages["block"].to_pylist(), messages["shard"][0].as_py()
        rows = {"kind": [kind] * len(blocks), "block": blocks, "shard": [shard] * len(blocks), "totals": out, "tokens": [0] * len(blocks), "types": [0] * len(blocks)}
        if kind == "word":
            for k, x in zip(rows, ("sum", -1, shard, b"", int(total.sum()), int((total > 0).sum()))):
                rows[k].append(x)
        return pa.Table.from_pydict(rows, schema=_ANSWER)

    return run


_ANSWER = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int64()), ("totals", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
_ANSWER_DDL = "kind string, block long, shard long, totals binary, tokens long, types long"


def _totals(x: bytes) -> np.ndarray:
    return unpack(x[1:], np.uint32 if x[:1] == b"4" else np.uint64).astype(np.int64)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1)


def _met(table: pa.Table):
    """A block with its answers: (block, its bigram index, c(v,w), c(v), c(w), training counts, by distinct bigram; c(w) by code)."""
    rows = table.sort_by([("kind", "ascending"), ("shard", "ascending")]).to_pylist()
    got = {"bigram": [], "word": []}
    for r in rows:
        if r["kind"] in got:
            got[r["kind"]].append(_totals(r["totals"]))
    block = next(_Block(*(r[k] for k in ("ids", "held", "lens", "words", "codes"))) for r in rows if r["kind"] == "block")
    _, _, order = block.unigrams()
    words = np.empty(len(order), np.int64)
    words[order] = np.concatenate(got["word"])
    _, mine, index, v, w = block.bigrams()
    return block, index, np.concatenate(got["bigram"]), words[v], words[w], mine.astype(np.int64), words


def _cells(tokens: int, types: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, cvw, cv, cw, mine, _ = _met(table)
        keep = mine > 0
        cvw, cv, cw, mine = cvw[keep], cv[keep], cw[keep], mine[keep]
        level = lambda p: np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEP), -1).astype(np.int64)
        p2, p1 = (cvw - 1) / np.maximum(cv - 1, 1), (cw - 1) / max(tokens - 1, 1)
        cell = (_bucket(cv - 1) * 4096 + level(p2) + 1) * 4096 + level(p1) + 1
        codes, uniq = pd.factorize(cell)
        return pa.Table.from_pydict({"cell": pa.array(uniq, pa.int64()), "n": pa.array(np.bincount(codes, weights=mine, minlength=len(uniq)))})

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = 40) -> np.ndarray:
    """(BUCKETS, 3) mixture weights of bigram, unigram and uniform estimates, by expectation-maximisation."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    value = lambda q: np.where(q > 0, 2.0 ** (-(q - 1.0) / STEP), 0)
    b, q2, q1 = cells // 4096**2, cells // 4096 % 4096, cells % 4096
    parts = np.stack([value(q2), value(q1), np.full(len(cells), 1 / (types + 1))], axis=1)
    for _ in range(rounds):
        share = parts * weights[b]
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + 1e-6
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _scores(tokens: int, types: int, weights: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        block, index, cvw, cv, cw, _, words = _met(table)
        l2, l1, l0 = weights[_bucket(cv)].T
        p = np.where(cv > 0, l2 * cvw / np.maximum(cv, 1), 0) + l1 * cw / max(tokens, 1) + l0 / (types + 1)
        p = np.where(cv > 0, p, p / np.maximum(1 - l2, 1e-12))  # an unseen context has no bigrams
        c = words[block.code]
        by_doc = lambda x: np.bincount(block.doc, weights=x, minlength=len(block.ids))
        return pa.Table.from_pydict({
            "doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.lens, pa.int64()), "n_known": pa.array(by_doc(c > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(block.ids), tokens, np.int64)), "base_score": pa.array(by_doc(np.log10((c + 1) / (tokens + types + 1)))), "score": pa.array(by_doc(np.log10(p)[index])),
        })

    return run


def score_texts(docs: DataFrame, parts: int = 7, fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one), score."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    blocks = ws.cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks(parts, fold), _BLOCKS_DDL), "blocks")
    n_blocks, n_codes = blocks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    message = "shard long, block long, hashes binary, counts binary"
    tables = []
    for kind, shards in (("word", max(1, n_codes // 8 // 500_000)), ("bigram", max(8, n_codes // 8 // 80_000))):
        asked = blocks.mapInArrow(_ask(kind, int(shards)), message)
        tables.append(ws.cut(asked.groupBy("shard").applyInArrow(_answer(kind), _ANSWER_DDL), kind))
    tokens, types = tables[0].where("kind = 'sum'").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    blank = F.lit(None)
    answers = tables[0].where("kind <> 'sum'").union(tables[1]).select("block", "kind", "shard", "totals", blank.cast("array<long>").alias("ids"), blank.cast("array<boolean>").alias("held"), *[blank.cast("binary").alias(k) for k in ("lens", "words", "codes")])
    whole = blocks.select("block", F.lit("block").alias("kind"), F.lit(0).cast("long").alias("shard"), blank.cast("binary").alias("totals"), "ids", "held", "lens", "words", "codes").union(answers)
    # blocks are many and of one size; their hash spreads them
    met = whole.groupBy("block")
    grid = met.applyInArrow(_cells(tokens, types), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a bounded grid
    grid = grid.sort_values("cell")
    weights = learn_weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(float), types)
    return met.applyInArrow(_scores(tokens, types, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
