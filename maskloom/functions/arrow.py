"""What every Arrow pass shares: a bound on the bytes of a batch."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: Spark's own bound is 64 MB, which JVM and Python both hold, more than once, for each task.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES: memory for a task then follows neither the
    number of rows in a batch nor their mean length. A lower bound that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
