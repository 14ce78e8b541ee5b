"""Quality by importance resampling: a target and a raw model of hashed byte n-grams, the logarithm of their ratio as a
document's weight, and Gumbel top-k, which draws k documents without replacement in proportion to the weights.

The raw model counts all documents, one Arrow pass with sums by bucket before the shuffle. The target model counts a bounded
sample of documents labelled good (at most `per_class`, those with the smallest hash of doc_id). The k-th largest key is
found by narrowing a histogram, so selection is a row-local comparison: no global sort, no shuffle of texts.

k is the number of documents whose weight is at least the threshold that separates the labelled sample best, unless
the caller names k. Equal keys stand or fall together (they belong to repeated rows).

Defined results: null and empty texts have weight 0 (no n-gram speaks for or against them); a null doc_id draws its noise
from a fixed hash; without labels of both kinds the threshold is below every weight and all documents are selected; other
columns are carried by `select_quality`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, chunks, cut_of_largest

CHUNK, BITS, WINDOW, LENGTH = 500_000, 15, 16, 1000
STRETCH, NEXT = 32, 8
BUCKETS = (1 << BITS) + 2  # two more: windows of WINDOW bytes that are new in their text, and repeated ones


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, start + 1, ... end - 1 of each range, end to end."""
    n = np.maximum(ends - starts, 0)
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _inside(starts: np.ndarray, end: int, h: np.ndarray) -> np.ndarray:
    """Positions chosen by content in stretches that no start interrupts: from each STRETCH bytes after a start on, the
    first smallest hash of every NEXT neighbours. Repeated content has the same ones wherever it stands."""
    ends = np.append(starts[1:], end)
    far = ends - starts >= STRETCH + NEXT
    if not far.any():
        return starts[:0]
    p = _ranges(starts[far] + STRETCH, ends[far] - NEXT + 1)
    least, at = h[p], np.zeros(len(p), np.int64)
    for k in range(1, NEXT):
        x = h[p + k]
        less = x < least
        least[less], at[less] = x[less], k
    return np.unique(p + at)


class _Events:
    """What the models count in a slice of texts: buckets of the n-grams that start at each byte, by order, and for each
    window of WINDOW bytes its document and whether it repeats an earlier one of its text. Windows start at words, and
    in long stretches without spaces or line feeds (tabs, scripts without spaces) where their content says."""

    def __init__(self, b: pa.RecordBatch):
        col = b.column(b.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.at = offsets - offsets[0]
        r = np.concatenate([raw, np.zeros(WINDOW, np.uint8)]).astype(np.uint32)  # every byte starts a gram; ends are cut off below
        two = (r[:-1] << 8) | r[1:]
        three, four = (two[:-1] << 8) | r[2:], (two[:-2] << 16) | two[2:]
        with np.errstate(over="ignore"):
            self.grams = {3: ((three * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)) >> np.uint32(32 - BITS)).astype(np.intp), 4: ((four * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.intp)}
            starts = np.unique(np.concatenate([np.flatnonzero((raw == 32) | (raw == 10)) + 1, self.at[:-1]]))
            starts = np.union1d(starts, _inside(starts, len(raw), self.grams[4]))
            self.document = np.searchsorted(self.at, starts, "right") - 1
            fits = (starts + WINDOW <= self.at[np.minimum(self.document + 1, len(col))]) & (self.document < len(col))
            starts, self.document = starts[fits], self.document[fits]
            eight = lambda p: (four[p].astype(np.uint64) << np.uint64(32)) | four[p + 4]
            code = (eight(starts) * np.uint64(0x9E3779B97F4A7C15)) ^ (eight(starts + 8) + self.document.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        self.repeated = np.ones(len(code), bool)
        self.repeated[np.unique(code, return_index=True)[1]] = False

    def counts(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for n, h in self.grams.items():
            out[: 1 << BITS] += np.bincount(h[: self.at[-1]], minlength=1 << BITS)
            crossing = _ranges(np.maximum(self.at[1:] - n + 1, self.at[:-1]), self.at[1:])  # those that leave their text
            out[: 1 << BITS] -= np.bincount(h[crossing], minlength=1 << BITS)
        again = int(self.repeated.sum())
        out[1 << BITS :] += (len(self.repeated) - again, again)
        return out

    def sums(self, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By document: the sum of the events' ratios, and how many events it has."""
        rows = len(self.at) - 1
        total = np.bincount(self.document, weights=ratio[(1 << BITS) + self.repeated.astype(np.intp)], minlength=rows)
        events = np.bincount(self.document, minlength=rows)
        for n, h in self.grams.items():
            running = np.concatenate([[0.0], np.cumsum(ratio[h[: self.at[-1]]], dtype=np.float64)])
            ends = np.maximum(self.at[1:] - n + 1, self.at[:-1])
            total = total + running[ends] - running[self.at[:-1]]
            events = events + ends - self.at[:-1]
        return total, events


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in chunks(batches, CHUNK):
        total += _Events(b).counts()
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts by bucket, all that the driver ever holds of a corpus."""
    got = texts.select(F.col("text").cast("string")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Of the n-grams' model, and of the model of repetition."""
    out = np.empty(len(target))
    for part in (slice(0, 1 << BITS), slice(1 << BITS, None)):
        t, r = target[part] + smooth, raw[part] + smooth
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def with_weight(docs: DataFrame, ratio: np.ndarray, name: str) -> DataFrame:
    """docs and a column `name`: the sum of the log ratios of a text's n-grams, of LENGTH average ones where it has
    more: else a slightly uneven sample of languages would decide over long texts."""
    ratio = ratio.astype(np.float32)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK):
            w, n = _Events(b).sums(ratio)
            w *= np.minimum(1, LENGTH / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], schema=b.schema.append(pa.field(name, pa.float64())))

    return docs.mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of (seed, doc_id)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    parts = [known.where(F.col("quality") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    picked = parts[0].union(parts[1])  # at most 2 * per_class rows of 12 bytes: a proven bound
    ws = Workspace(docs.sparkSession, "quality")
    sample = ws.cut(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(F.broadcast(picked), "id").select("text", "quality"), "sample")
    ratio = log_ratio(gram_counts(sample.where("quality = 1")), gram_counts(docs))
    seen = with_weight(sample, ratio, "w").select("quality", "w").toPandas()  # the bounded sample's weights
    good, bad = np.sort(seen.w[seen.quality == 1].to_numpy()), np.sort(seen.w[seen.quality == 0].to_numpy())
    ws.drop("sample")
    if not len(good) or not len(bad):
        return Model(ratio if len(good) else np.zeros_like(ratio), -np.inf)
    cuts = np.concatenate([good, bad])
    lost, passed = np.searchsorted(good, cuts) / len(good), 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.lexsort((-cuts, np.round(lost + passed, 6)))[0]  # rejecting a good document is as bad as keeping a bad one
    below = cuts[cuts < cuts[best]]
    return Model(ratio, float((cuts[best] + below.max()) / 2 if len(below) else cuts[best]))


def _keyed(docs: DataFrame, model: Model, seed: int, weight: str, key: str) -> DataFrame:
    return with_weight(docs, model.ratio, weight).withColumn(key, F.col(weight) + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17, per_class: int = 5000) -> tuple[DataFrame, Model, float]:
    """(doc_id, log_weight, gumbel_key of all documents; the model; the least key selected)."""
    model = fit(docs, labels, per_class)
    ws = Workspace(docs.sparkSession, "resample")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = ws.cut(_keyed(rows, model, seed, "log_weight", "gumbel_key").select("doc_id", "log_weight", "gumbel_key"), "keys")
    if k is None:
        k = keys.where(F.col("log_weight") >= model.threshold).count()
    cut = cut_of_largest(keys, "gumbel_key", k)
    return keys, model, -np.inf if cut is None else cut[0] if cut[1] else np.inf


def quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17, per_class: int = 5000) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, selected."""
    keys, _, cut = resample(docs, labels, k, seed, per_class)
    return keys.withColumn("selected", F.col("gumbel_key") >= F.lit(float(cut)))


def select_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17, per_class: int = 5000) -> DataFrame:
    """The selected documents, with their columns as they were: scored again and compared in place, without a shuffle."""
    _, model, cut = resample(docs, labels, k, seed, per_class)
    w, g = "_weight", "_key"
    while w in docs.columns or g in docs.columns:
        w, g = w + "_", g + "_"
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return _keyed(typed, model, seed, w, g).where(F.col(g) >= F.lit(float(cut))).select(*[F.col(f"`{c}`") for c in docs.columns])
