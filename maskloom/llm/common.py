"""What several operators of this subpackage share: a workspace in the cluster's shared folder, chunking of
Arrow batches by characters, word hashing, and exact distributed selection of the k largest keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import BATCH_BYTES, bounded_batches  # noqa: F401

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
#: Rows that a task writes at least, where the size of a table is known.
TASK_ROWS = 2048
_own_dir: dict[str, str] = {}


def ascii_lower(text: str) -> str:
    """A-Z to a-z and nothing else (str.lower() would also fold, and sometimes lengthen, other letters)."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def few_tasks(df: DataFrame, rows: int | None) -> DataFrame:
    """df, of `rows` rows at most, by no more tasks than have TASK_ROWS each."""
    return df if rows is None else df.coalesce(rows // TASK_ROWS + 1)


class Workspace:
    """Tables written to cut lineage, in the shared folder that spark.checkpoint.dir names.

    Where that is unset and Spark runs in this one process (tests, a laptop) a temporary folder is made once per application;
    on a cluster, where executors would not see it, that is an error. Executors only ever reach these tables through
    Spark's readers and writers, so any Hadoop file system will do.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext._jsc.sc().isLocal():
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            app = spark.sparkContext.applicationId
            base = _own_dir.setdefault(app, tempfile.mkdtemp(prefix="maskloom-"))
        self.spark, self.root = spark, f"{base.rstrip('/')}/maskloom-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: how many there are at most, where that is known: a small table is written by few tasks, not by one a partition."""
        df = few_tasks(df, rows)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)


def chunks(batches: Iterable[pa.RecordBatch], chars: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about `chars` bytes of text each, so that a worker's memory is bounded by
    that and the longest single text, whatever the number of rows in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        n = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(n) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


class Codes(dict):
    """Numbers words as they come; only distinct ones stay in memory."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def word_codes(token_lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes of all tokens end to end, length of each list, distinct tokens). Lists may come one by one."""
    known = Codes()
    parts = [np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)) for ws in token_lists]
    lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), lens, list(known)


def hash64(words: Iterable[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words), dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cut_of_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> tuple[float, int] | None:
    """(c, t): the k rows with the largest double `key` are those with key > c and t of those with key == c.

    Each round counts rows in `bins` ranges of the interval that holds the k-th largest and narrows it to one range, so
    the driver sees `bins` numbers a round, whatever the number of rows. None: every row is among the k. Keys must be
    finite; null keys are left out.
    """
    df = df.where(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("k"))
    n, lo, hi = df.agg(F.count("*"), F.min("k"), F.max("k")).first()
    if k >= n:
        return None
    if k <= 0:
        return hi, 0
    above = 0  # rows beyond hi
    while True:
        step = (hi - lo) / bins
        if step == 0 or lo + step == lo or hi - step == hi:  # neighbouring doubles: each value is a bin
            counts = df.where(F.col("k").between(lo, hi)).groupBy("k").count().orderBy(F.desc("k")).limit(bins).collect()
            for v, c in counts:
                if above + c >= k:
                    return v, k - above
                above += c
            hi = counts[-1][0]
            continue
        b = F.least(F.lit(bins - 1), F.floor((F.col("k") - lo) / step).cast("int"))
        got = {r[0]: (r[1], r[2], r[3]) for r in df.where(F.col("k").between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*"), F.min("k"), F.max("k")).collect()}
        for i in sorted(got, reverse=True):
            c, least, most = got[i]
            if above + c >= k:
                if least == most:
                    return least, k - above
                lo, hi = least, most
                break
            above += c
