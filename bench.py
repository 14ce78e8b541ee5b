"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query is run once to warm up and
then timed (best of two), its result consumed by an aggregate over all columns so that nothing is pruned."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

HEADLINE = ["anonymize_email", "analyze_email_ip", "analyze_all_entities", "resolve_conflicts", "tokens_mint", "tokens_reveal_identity", "lang_detect", "eval_leak", "eval_strict", "eval_rollup", "spans_ipv4", "check_us_npi"]


def main() -> None:
    from pyspark.sql import SparkSession

    from maskloom.queries import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):
            t = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        times[name] = round(best, 3)
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": d.rsplit("sf", 1)[-1], "documents": n, "analyze_ms_per_document_core": round(1000 * times["analyze_all_entities"] * int(cpus) / max(n, 1), 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
