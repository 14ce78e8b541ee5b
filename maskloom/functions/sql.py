"""The library from SQL: a table function for findings and scalar functions for texts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.registry import Registry
from ..plans.analyze import AnalysisConfig, Engine


def register(spark: SparkSession, config: AnalysisConfig | None = None, registry: Registry | None = None) -> None:
    """pii_spans(text, lang) as a table function; pii_redact(text, lang) as a vectorised scalar one."""
    config, recognizers = config or AnalysisConfig(), (registry or Registry()).snapshot()

    @F.udtf(returnType="start bigint, end bigint, score double, entity string, recognizer string")
    class Spans:
        def __init__(self):
            self.engine = Engine(recognizers, config)

        def eval(self, text: str, lang: str):
            yield from self.engine.analyze(text, lang)

    @F.pandas_udf("string")
    def redact(text, lang):
        engine = Engine(recognizers, config)

        def one(t, la):
            if t is None:
                return None
            for s, e, _, entity, _ in reversed(engine.analyze(t, la)):
                t = f"{t[:s]}<{entity}>{t[e:]}"
            return t

        import pandas as pd

        return pd.Series([one(t, la) for t, la in zip(text, lang)])

    spark.udtf.register("pii_spans", Spans)
    spark.udf.register("pii_redact", redact)
