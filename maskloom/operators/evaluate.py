"""Evaluation: gold against predicted spans, in plain windows and aggregations.

gold: corpus, doc_id, start, end, type. pred: engine, corpus, doc_id, start, end, type, score. Half-open spans; documents that
only one side has are left out by `scored`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = ("doc_id", "start", "end", "type")
#: Bytes of input, as it is stored, for each of the partitions that spans are dealt to: a task's memory follows this, not the
#: input. A row of a few bytes in a file takes a hundred in a sort or a hash table.
STORED_BYTES = 4 << 20
#: The same where that makes more partitions than Spark's writers deal out without a sort of their own (200): such a sort holds
#: all rows of a map task, so partitions grow first.
MOST_STORED_BYTES = 64 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in partitions by keys, as many as its sources ask for."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    stored = sum(n for n in sizes if n < 1 << 60)  # above: Spark doesn't know
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    n = max(least, min(-(-stored // STORED_BYTES), max(unsorted, -(-stored // MOST_STORED_BYTES))))
    return df.repartition(n, *keys)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def normalize_labels(spans: DataFrame, label_map: DataFrame, side: str | None = None) -> DataFrame:
    """Types mapped to canonical ones. label_map: label, canonical (null: drop), maybe side. Unmapped labels become OTHER."""
    m = label_map if side is None else label_map.where(F.col("side") == side)
    m = m.select(F.col("label").alias("type"), "canonical", F.lit(True).alias("known"))  # Spark broadcasts it if its size allows
    x = spans.join(m, "type", "left")
    return x.where(F.col("known").isNull() | F.col("canonical").isNotNull()).withColumn("type", F.coalesce("canonical", F.lit("OTHER"))).drop("canonical", "known")


def parity_fold(type_: Column) -> Column:
    return F.when(type_.isin("STREET_ADDRESS", "POSTAL_CODE"), "LOCATION").otherwise(type_)


def scored(gold: DataFrame, pred_docs: DataFrame) -> DataFrame:
    return gold.join(pred_docs.select("doc_id").distinct(), "doc_id", "left_semi")


def overlapped(spans: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """spans with `met`: one of the others with equal keys overlaps. It does if the latest end of those that start before the
    span's end lies behind the span's start: one shuffle, one sort and a running maximum, also where many overlap."""
    a = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("end").alias("_at"), F.lit(0).alias("_other"), F.lit(None).cast("long").alias("_end"), F.struct(*spans.columns).alias("_row"))
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in (*keys, "start")])
    b = others.where(known).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_at"), F.lit(1).alias("_other"), F.col("end").alias("_end"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    by = [f"_{k}" for k in keys]
    w = Window.partitionBy(*by).orderBy("_at", "_other").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = dealt(a.unionByName(b), *by).withColumn("_last", F.max("_end").over(w)).where("_other = 0")
    return x.select("_row.*", F.coalesce(F.col("_last") > F.col("_row.start"), F.lit(False)).alias("met"))


def leaked(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold with `leaked`: no prediction overlaps."""
    return overlapped(gold, pred, "doc_id").withColumn("leaked", ~F.col("met")).drop("met")


def leak_rate(leaks: DataFrame, *by: str) -> DataFrame:
    return leaks.groupBy(*by).agg(F.count("*").alias("gold"), F.sum(F.col("leaked").cast("long")).alias("leaked")).withColumn("leak_rate", ratio(F.col("leaked").cast("double"), F.col("gold")))


def weighted_leak(leaks: DataFrame, severity: DataFrame, *by: str) -> DataFrame:
    """severity: type, weight. A missing weight is 1, one of 0 or less drops the span."""
    x = leaks.join(severity.select("type", "weight"), "type", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).where("weight > 0")
    return x.groupBy(*by).agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("leaked"), F.col("weight")).otherwise(0.0)).alias("leaked_weight")).withColumn("weighted_leak", ratio(F.col("leaked_weight"), F.col("weight")))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp.cast("double"), tp + fp), ratio(tp.cast("double"), tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def _sides(gold: DataFrame, pred: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of both, with `g` and `p`: on which side they are. Keys of both sides meet in one aggregation, dealt
    out before it, since rows that are mostly distinct gain nothing from a first one before the shuffle."""
    one = lambda df, g: df.select(*keys, F.lit(g).alias("g"), F.lit(not g).alias("p"))
    return dealt(one(gold, True).unionByName(one(pred, False)), *keys).groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))


def _counted(sides: DataFrame, *by: str) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g, p = F.col("g"), F.col("p")
    return sides.groupBy(*by).agg(n(g & p).alias("a"), n(~g).alias("b"), n(~p).alias("c")).select(*by, *_scores(F.col("a"), F.col("b"), F.col("c")))


def strict(gold: DataFrame, pred: DataFrame, *by: str) -> DataFrame:
    """Equal document, span and type, over the distinct sets."""
    return _counted(_sides(gold, pred, *SPAN), *by)


def partial(gold: DataFrame, pred: DataFrame, typed: bool = True) -> DataFrame:
    """Any overlap counts (with equal types, if typed): recall over gold, precision over predictions."""
    sides, keys = _sides(gold, pred, *SPAN), ("doc_id", "type") if typed else ("doc_id",)
    g, p = sides.where("g").select(*SPAN), sides.where("p").select(*SPAN)
    n = lambda a, b, size, met: overlapped(a, b, *keys).agg(F.count("*").alias(size), F.coalesce(F.sum(F.col("met").cast("long")), F.lit(0)).alias(met))
    x = n(g, p, "gold", "found").join(n(p, g, "pred", "right"))  # two single rows
    pr, rc = ratio(F.col("right").cast("double"), F.col("pred")), ratio(F.col("found").cast("double"), F.col("gold"))
    return x.select("gold", "pred", "found", "right", pr.alias("precision"), rc.alias("recall"), f1(pr, rc).alias("f1"))


def type_only(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Documents and types alone: which kinds a document holds."""
    return _counted(_sides(gold, pred, "doc_id", "type"))


def rollup(leaks: DataFrame, corpora: DataFrame) -> DataFrame:
    """Pooled leak by all, domain, language, and both: grouping sets over the sums of corpora. corpora: corpus, domain,
    language."""
    x = leaks.groupBy("corpus").agg(F.count("*").alias("n"), F.sum(F.col("leaked").cast("long")).alias("n_leaked")).join(corpora, "corpus")
    g = x.groupingSets([[], ["domain"], ["language"], ["domain", "language"]], "domain", "language").agg(F.grouping_id().alias("level"), F.sum("n").alias("gold"), F.sum("n_leaked").alias("leaked"))
    return g.withColumn("leak_rate", ratio(F.col("leaked").cast("double"), F.col("gold")))


def latency(runs: DataFrame, *by: str, value: str = "duration_ms") -> DataFrame:
    """Nearest-rank percentiles, mean and median."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return runs.groupBy(*by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def merge_findings(*engines: DataFrame) -> DataFrame:
    """Union of engines' findings; of equal document, span and type the best score."""
    x = engines[0]
    for e in engines[1:]:
        x = x.unionByName(e)
    return x.groupBy(*SPAN).agg(F.max("score").alias("score"))


def precision_with_gold(per_type: DataFrame) -> DataFrame:
    """per_type: corpus, type, tp, fp, fn. Pairs without gold are left out before pooling."""
    x = per_type.where("tp + fn > 0").groupBy("type").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return x.withColumn("precision", ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))


def verdicts(cells: DataFrame) -> DataFrame:
    """cells: domain, language, engine, leak_rate -> each cell's best engine, ties included."""
    from pyspark.sql import Window

    w = Window.partitionBy("domain", "language")
    return cells.withColumn("best", F.min("leak_rate").over(w)).withColumn("rank", F.rank().over(w.orderBy("leak_rate")))


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts by upper edge; beyond the last: null."""
    bucket = F.lit(None).cast("double")
    for e in reversed(edges):
        bucket = F.when(F.col(column) <= e, F.lit(float(e))).otherwise(bucket)
    return values.groupBy(bucket.alias("le")).count()
