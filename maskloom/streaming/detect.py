"""The same transforms over streams. Detection is stateless and row-local, so batch and stream share one function; counts by
window and entity are ours, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analyze import AnalysisConfig, analyze


def read_lines(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Log or NDJSON files as they arrive: one row per line. per_trigger bounds the files of a batch (back-pressure)."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def read_parquet(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def detect(stream: DataFrame, text: str = "value", language: str | None = None, config: AnalysisConfig | None = None) -> DataFrame:
    return analyze(stream, text=text, language=language, config=config)


def counts_by_window(stream: DataFrame, ts: str = "ts", findings: str = "findings", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings by entity and window; rows later than the watermark are dropped."""
    x = stream.withWatermark(ts, late).select(ts, F.explode(findings).alias("f"))
    return x.groupBy(F.window(ts, window).alias("w"), F.col("f.entity").alias("entity")).count().select(F.col("w.start").alias("window_start"), "entity", "count")


def write_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there, then stops; a restart continues after what is committed."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
