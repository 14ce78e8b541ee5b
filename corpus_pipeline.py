"""The corpus pipeline: quality classifier, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result as Parquet to the cluster's
shared folder and reads it back for the next, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.common import Workspace
from maskloom.llm.decontaminate import decontaminate
from maskloom.llm.mixing import mix, source_domain
from maskloom.llm.neardup import near_duplicates
from maskloom.llm.quality import select_quality
from maskloom.llm.sharding import shard_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; k follows from the labels."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard index of 5-word shingles 0.8 or more): the smallest doc_id.

    Repeated rows of the document that stays are one document: one of them stays."""
    gone = near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))  # ids alone
    if again.isEmpty():
        return left
    once = left.join(again, left["doc_id"] == again["_again"], "left_anti")
    return once.union(left.join(again, left["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs: training must not see a leaked passage, however long its text."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), share=None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared out by tokens to the power 0.7 down the tree, each document once at most."""
    mixed = mix(docs, source_domain(F.col("source")), fraction=0.9, epochs=1, copies="_copies", tokens="_tokens")
    return mixed.where("_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shard (0 to 7) and slot."""
    return shard_documents(docs, 8)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier, the sketches' components or the k-d tree; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.cut(stage(spark, docs, sf_dir), name)
        if i:
            ws.drop(STAGES[i - 1][0])
    return docs
