"""Toxicity by multiple-instance learning: a document is a bag of sentences, a sentence's log-odds are b + the sum of the
weights of its distinct words, and documents follow by noisy-or with a leak, 1 - (1 - leak) * prod(1 - p(sentence)), where
p is what the sentence has beyond one without any weighted word: 1 - p = (1 - sigmoid(s)) / (1 - sigmoid(b)). So plain
sentences add nothing, however many a text has. Only documents carry labels; the noisy-or sends the blame for a toxic
document to the sentences that explain it, and the same sentence scores locate the offending ones.

Fitting uses a bounded sample of labelled rows: at most `per_class` documents of each label, those with the smallest hash
of doc_id. Their hashed words come to the driver (about 2 KB a document), where the few thousand weights that matter are
fitted by full-batch gradient steps. Scoring is one row-local Arrow pass over all documents, without a shuffle.

Defined results: null and empty texts are one sentence without words; rows without a doc_id are scored and never learnt
from; labels that are null are ignored, contradictory ones count as toxic; without labels of both kinds every score is that
of the untrained leak; repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, hash64, word_codes

TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
CHUNK, BUCKETS = 2_000_000, 1 << 18


def fold_of(doc_id: Column, parts: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, sentence) of each distinct word of each sentence, and the document of each sentence."""
    codes, lens, uniq = word_codes([".", *(TOKENS.findall(t.lower()) if t else ())] for t in texts)  # a stop in front begins the first sentence
    stop = np.array([w in STOPS for w in uniq], dtype=bool)
    buckets = (hash64(uniq, 7) % np.uint64(BUCKETS)).astype(np.int64)
    is_stop = stop[codes]
    sentence = np.cumsum(is_stop) - 1
    document = np.repeat(np.arange(len(lens)), lens)[is_stop]
    word = ~is_stop
    pairs = np.unique(sentence[word] * BUCKETS + buckets[codes[word]])
    return pairs % BUCKETS, pairs // BUCKETS, document


def _sample_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, CHUNK):
        bucket, sentence, document = _bags(b.column("text").to_pylist())
        rows = {"toxic": b.column("toxic").to_pylist(), "buckets": [], "sentences": [], "n": []}
        per_doc = np.bincount(document, minlength=b.num_rows)
        first = np.cumsum(per_doc) - per_doc
        cut = np.searchsorted(sentence, np.append(first, len(document)))
        for k in range(b.num_rows):
            lo, hi = cut[k], cut[k + 1]
            rows["buckets"].append(bucket[lo:hi].astype(np.int32).tobytes())
            rows["sentences"].append((sentence[lo:hi] - first[k]).astype(np.int32).tobytes())
            rows["n"].append(int(per_doc[k]))
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("toxic", pa.int32()), ("buckets", pa.binary()), ("sentences", pa.binary()), ("n", pa.int64())]))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, allowed: Column) -> DataFrame:
    """toxic, text of at most `per_class` documents of each label, by the smallest hashes of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(allowed).groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # at most 2 * per_class rows of 12 bytes: a proven bound
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(F.broadcast(picked), "id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")  # copies count once


def fit(toxic: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, least: int = 4, surprise: float = 4.0) -> tuple[np.ndarray, float, float]:
    """(weight of each bucket, bias of a sentence, log-odds of the leak). Only words in `least` sampled documents or more, and toxic ones
    by `surprise` standard errors more often than by chance, have a weight."""
    weights, bias, leak = np.zeros(BUCKETS), -5.0, -5.0
    if not len(toxic) or toxic.min() == toxic.max():
        return weights, bias, leak
    n = np.array([x[2] for x in bags])
    first = np.cumsum(n) - n
    document = np.repeat(np.arange(len(n)), n)
    bucket = np.concatenate([x[0] for x in bags])
    sentence = np.concatenate([x[1] + np.int32(f) for x, f in zip(bags, first)])
    of_doc = np.unique(document[sentence] * BUCKETS + bucket)
    df = np.bincount(of_doc % BUCKETS, minlength=BUCKETS)
    df1 = np.bincount(of_doc % BUCKETS, weights=toxic[of_doc // BUCKETS], minlength=BUCKETS)
    # words that are in more toxic documents than chance explains; the many rare others would only be learnt by heart
    rate = toxic.mean()
    sure = (df >= least) & (df1 - df * rate > surprise * np.sqrt(df * rate * (1 - rate)))
    keep = sure[bucket]
    bucket, sentence = bucket[keep], sentence[keep]
    used, index = np.unique(bucket, return_inverse=True)
    if not len(used):
        return weights, bias, leak
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    w = np.clip(np.log((df1[used] + 0.5) / (n1 + 1)) - np.log((df[used] - df1[used] + 0.5) / (n0 + 1)), 0, 4)
    b, c, y = bias, leak, toxic.astype(bool)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for t in range(1, rounds + 1):
        s = b + np.bincount(sentence, weights=w[index], minlength=len(document))
        p = sigmoid(s)
        q = np.exp(np.bincount(document, weights=np.logaddexp(0, b) - np.logaddexp(0, s), minlength=len(n)) - np.logaddexp(0, c))  # nothing is toxic
        scale = np.where(y, -q / np.maximum(1 - q, 1e-9), 1.0) / len(n)
        gs = p * scale[document]
        g = np.concatenate([np.bincount(index, weights=gs[sentence], minlength=len(w)), [((p - sigmoid(b)) * scale[document]).sum(), scale.sum() * sigmoid(c)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b, c = w - step[:-2], min(b - step[-2], -2.0), c - step[-1]
        w = np.maximum(w - 0.01, 0)  # a word that the others explain ends at nothing
    weights[used] = w
    return weights, float(b), float(c)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, parts: int = 3, fold: int = 1) -> tuple[np.ndarray, float, float]:
    """Learns from rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, per_class, fold_of(F.col("id"), parts) != fold)
    rows = sample.mapInArrow(_sample_bags, "toxic int, buckets binary, sentences binary, n long").collect()
    rows = sorted((r["toxic"], bytes(r["buckets"]), bytes(r["sentences"]), r["n"]) for r in rows)
    toxic = np.array([r[0] for r in rows])
    return fit(toxic, [(np.frombuffer(b, np.int32), np.frombuffer(s, np.int32), n) for _, b, s, n in rows])


def sentence_scores(texts: list[str | None], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each sentence, and its document."""
    bucket, sentence, document = _bags(texts)
    return bias + np.bincount(sentence, weights=weights[bucket], minlength=len(document)), document


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Code points of the sentences as they are scored."""
    stops = [m.start() for m in re.finditer(r"[.!?\n]", text)]
    return list(zip([0, *[x + 1 for x in stops]], [*[x + 1 for x in stops], len(text)]))


def _score(weights: np.ndarray, bias: float, leak: float, threshold: float):
    nonzero = np.flatnonzero(weights)
    values = weights[nonzero].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS)
        full[nonzero] = values
        for b in chunks(batches, CHUNK):
            texts = b.column("text").to_pylist()
            s, document = sentence_scores(texts, full, bias)
            none = np.bincount(document, weights=np.logaddexp(0, bias) - np.logaddexp(0, s), minlength=b.num_rows)
            score = np.clip(-np.expm1(none - np.logaddexp(0, leak)), 0, 1)
            first = np.searchsorted(document, np.arange(b.num_rows))
            found = []
            for k, t in enumerate(texts):
                if score[k] >= threshold and t:
                    own = s[first[k] : first[k + 1] if k + 1 < b.num_rows else len(s)]
                    at = sentence_bounds(t)
                    found.append(",".join(f"{at[i][0]}:{at[i][1]}" for i in np.flatnonzero(own >= min(0, own.max())) if i < len(at)))
                else:
                    found.append("")
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": score, "sentences": found}, schema=pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.string())]))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 3000, parts: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: held_out, score, predicted, and the offending sentences (start:end, code points) of those
    predicted toxic."""
    bounded_batches(docs.sparkSession)
    weights, bias, leak = train(docs, labels, per_class, parts, fold)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_score(weights, bias, leak, threshold), "doc_id long, score double, sentences string")
    return scored.select("doc_id", (F.coalesce(fold_of(F.col("doc_id"), parts), F.lit(-1)) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
