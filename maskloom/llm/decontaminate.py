"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of documents of about `CHUNK` characters. Its words are mapped to the benchmark's vocabulary; only runs
of known words that are as long as the shortest window can hold an occurrence, so the index is built over those runs,
with separators between. The index is a Burrows-Wheeler transform in a wavelet matrix; all windows are searched backwards
at once, each step two ranks per window; occurrences are located by walking to sampled suffix positions (run starts and
every `RATE`-th word); overlapping occurrences merge into spans of words to remove.

The benchmark's windows travel with the tasks in blocks of about `BLOCK_WORDS` words. One block is the usual case; a
larger benchmark takes further passes, each over the written result of the one before and adding to the spans found so far.
No shuffle, no join; memory, the driver's too, is bounded by a chunk, the longest text and a block.

Defined results: null and empty texts have no words, no hits and are not contaminated; a benchmark without usable items hits
nothing; items with a null id or no words are ignored; equal items all count; repeated rows are separate rows; other
columns are carried (or ignored by the query) whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, ascii_lower, bounded_batches, chunks

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CHUNK, RATE, BLOCK_WORDS = 1_000_000, 8, 4_000_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(ascii_lower(text)) if text else []


class Windows:
    """Distinct windows of a block of items: rows of word codes (1 up; 0 fills short ones in front), and their items."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int):
        self.vocabulary: dict[str, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        for item, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(codes) - size + 1)):
                k = seen.setdefault(tuple(codes[i : i + size]), len(owners))
                if k == len(owners):
                    owners.append(set())
                owners[k].add(item)
        self.lengths = np.array([len(k) for k in seen], dtype=np.int64)
        self.codes = np.zeros((len(seen), size), dtype=np.int64)
        for i, k in enumerate(seen):
            self.codes[i, size - len(k) :] = k
        self.owners = np.array([x for s in owners for x in sorted(s)], dtype=np.int64)
        self.owned = np.cumsum([0, *map(len, owners)])
        self.shortest = int(self.lengths.min()) if len(owners) else 0


class FMIndex:
    """Over codes with 0 as the separator; the sequence begins and ends with one."""

    def __init__(self, s: np.ndarray, symbols: int):
        n = len(s)
        self.n, self.levels = n, max(1, symbols.bit_length())
        gap = s == 0
        # separators rank first, by position, so that no comparison passes one; then prefix doubling
        rank = np.where(gap, np.cumsum(gap) - 1, s + int(gap.sum()))
        k = 1
        while True:
            second = np.full(n, 0, dtype=np.int64)
            second[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            if rank[order[-1]] == n - 1 or k >= n:
                break
            k *= 2
        self.sa = None
        bwt = s[order - 1]  # of the suffix at 0: the last symbol, a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        sampled = (order % RATE == 0) | gap[order - 1] | gap[order]
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]
        self.ones, self.zeros = [], []
        x = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs in the first i of the transform."""
        start = np.zeros_like(i)
        for d, level in enumerate(range(self.levels - 1, -1, -1)):
            bit, ones, z = (c >> level) & 1, self.ones[d], self.zeros[d]
            start, i = np.where(bit == 1, z + ones[start], start - ones[start]), np.where(bit == 1, z + ones[i], i - ones[i])
        return i - start

    def _step(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one position earlier."""
        at, c = row, np.zeros_like(row)
        for d in range(self.levels):
            ones, z = self.ones[d], self.zeros[d]
            bit = ones[at + 1] - ones[at]
            c = c * 2 + bit
            at = np.where(bit == 1, z + ones[at], at - ones[at])
        return self.first[c] + self.rank(c, row)

    def search(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows of each window."""
        lo, hi = np.zeros(len(w.codes), np.int64), np.full(len(w.codes), self.n, np.int64)
        for j in range(w.codes.shape[1] - 1, -1, -1):
            live = np.flatnonzero((w.codes[:, j] > 0) & (hi > lo))
            if len(live):
                c = w.codes[live, j]
                lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo, at = np.full(len(rows), -1, np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            there = self.sampled[at + 1] > self.sampled[at]
            out[todo[there]] = self.positions[self.sampled[at[there]]] + steps
            todo, at = todo[~there], at[~there]
            if len(todo):
                at = self._step(at)
            steps += 1
        return out


def hits(codes: np.ndarray, lens: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's words end to end (codes, 0: not in the vocabulary; a document ends after each length): which words are
    hit, and pairs (document, item)."""
    total, hit = len(codes), np.zeros(len(codes) + 1, dtype=np.int64)
    none = np.empty(0, np.int64)
    if not total or not len(w.codes):
        return hit[:-1] > 0, none, none
    document = np.repeat(np.arange(len(lens)), lens)
    known = codes > 0
    begins = known & np.concatenate([[True], ~known[:-1] | (document[1:] != document[:-1])])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return hit[:-1] > 0, none, none
    ends = np.flatnonzero(known & np.concatenate([~known[1:] | (document[1:] != document[:-1]), [True]])) + 1
    long = ends - starts >= w.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return hit[:-1] > 0, none, none
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    place = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1), sizes)  # a separator before each run and at the end
    s, where = np.zeros(sizes.sum() + len(sizes) + 1, np.int64), np.full(sizes.sum() + len(sizes) + 1, -1, np.int64)
    s[place], where[place] = codes[at], at
    index = FMIndex(s, len(w.vocabulary))
    lo, hi = index.search(w)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    found = where[index.locate(rows)]
    np.add.at(hit, found, 1)
    np.add.at(hit, found + w.lengths[which], -1)
    pairs = np.unique(np.stack([document[found], which], axis=1), axis=0) if len(found) else np.empty((0, 2), np.int64)
    n = w.owned[pairs[:, 1] + 1] - w.owned[pairs[:, 1]]
    owner = np.repeat(w.owned[pairs[:, 1]] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else none, n) + np.arange(n.sum())
    return np.cumsum(hit[:-1]) > 0, np.repeat(pairs[:, 0], n), w.owners[owner]


def merged_spans(hit: np.ndarray) -> list[int]:
    """start, end, start, end, ... of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


_LEAK = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def _pass(windows: Windows, text: str, leak: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.vocabulary.get
        for b in chunks(batches, CHUNK, text):
            lists = [words_of(t) for t in b.column(text).to_pylist()]
            lens = np.array([len(x) for x in lists], dtype=np.int64)
            codes = np.fromiter((known(x, 0) for ws in lists for x in ws), dtype=np.int64, count=int(lens.sum()))
            hit, docs, items = hits(codes, lens, windows)
            found: dict[int, set[int]] = {}
            for d, i in zip(docs.tolist(), items.tolist()):
                found.setdefault(d, set()).add(i)
            ends, out = np.cumsum(lens), []
            for k, old in enumerate(b.column(leak).to_pylist()):
                own = hit[ends[k] - lens[k] : ends[k]]
                if old and old["spans"]:
                    own = own.copy()
                    for lo, hi in zip(old["spans"][::2], old["spans"][1::2]):
                        own[lo:hi] = True
                before = set(old["items"]) if old else set()
                out.append({"n_words": int(lens[k]), "spans": merged_spans(own), "items": sorted(before | found.get(k, set()))})
            i = b.schema.get_field_index(leak)
            yield b.set_column(i, pa.field(leak, _LEAK), pa.array(out, _LEAK))

    return run


def match_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = 13, leak: str = "_leak") -> DataFrame:
    """The documents, all columns kept, and a struct `leak`: n_words, spans (merged, word offsets: start, end, ...) and
    items (ids with a window in the text)."""
    while leak in docs.columns:
        leak += "_"
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.LongType()))])
    out = docs.withColumn("text", F.col("text").cast("string")).withColumn(leak, F.lit(None).cast(kind))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    bounded_batches(docs.sparkSession)
    ws, step = Workspace(docs.sparkSession, "benchmark"), 0
    for block in _blocks(benchmark):
        if step:  # what is found so far is written, so that the driver and the plan hold one block at a time
            out = ws.cut(out, f"pass{step}")
            ws.drop(f"pass{step - 1}")
        out, step = out.mapInArrow(_pass(Windows(block, size), "text", leak), schema), step + 1
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark, a stated query set, in blocks of about BLOCK_WORDS words; one, if empty, at least."""
    block, held = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").toLocalIterator():
        if words := words_of(text):
            if held > BLOCK_WORDS:
                yield block
                block, held = [], 0
            block.append((item, words))
            held += len(words)
    yield block


def n_hit(leak: Column) -> Column:
    spans = leak["spans"]
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(leak: Column, share: int = 20) -> Column:
    return (n_hit(leak) > 0) & (n_hit(leak) * share >= leak["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and spans as text."""
    found = match_benchmark(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, size)
    leak = F.col("_leak")
    ids = F.array_join(F.array_sort(F.transform(leak["items"], lambda x: x.cast("string"))), ",")
    return found.select("doc_id", leak["n_words"].alias("n_words"), n_hit(leak).alias("n_hit"), F.size(leak["items"]).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated(leak).alias("contaminated"), F.array_join(leak["spans"].cast("array<string>"), ",").alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int | None = 20) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were. share: one hit word in so many words
    makes a document contaminated; None: any hit does."""
    leak = "_leak"
    while leak in docs.columns:
        leak += "_"
    found = match_benchmark(docs, benchmark, size, leak)
    bad = is_contaminated(F.col(leak), share) if share else n_hit(F.col(leak)) > 0
    return found.where(~bad).select(*[F.col(f"`{c}`") for c in docs.columns])
