"""Content formats: plain text, JSON, NDJSON, mixed logs. JSON trees are walked in Arrow passes; keys, numbers, booleans and
nulls stay as they are, string leaves are transformed; output has sorted keys, no spaces and no escapes for non-ASCII."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import bounded_batches

# Fixed value: control sequences, operating system commands and two-character escapes.
ESCAPES = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[@-Z\\-_]"
ALIASES = {"": "text", "text": "text", "json": "json", "pdf": "pdf", "auto": "auto", "ndjson": "ndjson", "jsonl": "ndjson", "json-lines": "ndjson", "logs": "logs", "log": "logs"}


def normalize_format(name: Column) -> Column:
    """The canonical name; unknown ones become empty."""
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(F.coalesce(name, F.lit(""))))), F.lit(""))


def strip_ansi_col(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, ESCAPES, "")).otherwise(text)


def sanitize_utf8(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def is_json(text: Column) -> Column:
    """One JSON value and nothing after it (the parser alone stops at the first value)."""
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(), F.lit(False))


def resolve_auto(text: Column) -> Column:
    """json, else ndjson (two or more lines that are not blank, each valid), else text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: is_json(F.trim(x)))
    return F.when(is_json(text), "json").when((F.size(lines) >= 2) & each, "ndjson").otherwise("text")


def dumps(tree) -> str:
    return json.dumps(tree, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def leaves(tree, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, text) of string leaves, keys in order."""
    if isinstance(tree, str):
        yield path, tree
    elif isinstance(tree, dict):
        for k in sorted(tree):
            yield from leaves(tree[k], f"{path}.{k}")
    elif isinstance(tree, list):
        for i, x in enumerate(tree):
            yield from leaves(x, f"{path}[{i}]")


def mapped(tree, f: Callable[[str, str], str], path: str = "$"):
    if isinstance(tree, str):
        return f(path, tree)
    if isinstance(tree, dict):
        return {k: mapped(tree[k], f, f"{path}.{k}") for k in sorted(tree)}
    if isinstance(tree, list):
        return [mapped(x, f, f"{path}[{i}]") for i, x in enumerate(tree)]
    return tree


def segments_of(content: str | None, kind: str) -> list[tuple[str, str]]:
    """(segment, text): the whole text, JSON leaves, or by line (leaves where the line is JSON). NDJSON must be valid."""
    if content is None:
        return []
    if kind == "json":
        return list(leaves(json.loads(content)))
    if kind in ("ndjson", "logs"):
        out = []
        for i, line in enumerate(content.split("\n")):
            if not line.strip():
                continue
            try:
                out += [(f"{i}:{p}", t) for p, t in leaves(json.loads(line))]
            except ValueError:
                if kind == "ndjson":
                    raise ValueError(f"line {i + 1} is not JSON") from None
                out.append((f"{i}:", line))
        return out
    return [("", content)]


def rebuilt(content: str | None, kind: str, new: dict[str, str]) -> str | None:
    """The content with segments replaced."""
    if content is None:
        return None
    if kind == "json":
        return dumps(mapped(json.loads(content), lambda p, t: new.get(p, t)))
    if kind in ("ndjson", "logs"):
        out = []
        for i, line in enumerate(content.split("\n")):
            try:
                out.append(dumps(mapped(json.loads(line), lambda p, t, i=i: new.get(f"{i}:{p}", t))) if line.strip() else line)
            except ValueError:
                out.append(new.get(f"{i}:", line))
        return "\n".join(out)
    return new.get("", content)


def segments(df: DataFrame, keys: list[str], content: str, kind: Column) -> DataFrame:
    """keys, segment, text: a row per piece to analyse."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("array<struct<segment:string,text:string>>")
    def split(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([[{"segment": s, "text": t} for s, t in segments_of(x, y)] for x, y in zip(c, k)])

    return df.select(*keys, F.explode(split(F.col(content), kind)).alias("s")).select(*keys, "s.segment", "s.text")


def rebuild(df: DataFrame, content: str, kind: Column, new: str, out: str = "content") -> DataFrame:
    """df with `out`: `content` with the segments of the map column `new` replaced."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def join(c: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(x, y, dict(z) if z is not None else {}) for x, y, z in zip(c, k, n)])

    return df.withColumn(out, join(F.col(content), kind, F.col(new)))


def read_gold(spark, path: str) -> DataFrame:
    """Gold documents, one JSON object a line."""
    return spark.read.schema("id string, text string, entities array<struct<start:bigint,end:bigint,type:string>>").json(path)


def read_predictions(spark, path: str) -> DataFrame:
    return spark.read.schema("id string, engine string, findings array<struct<start:bigint,end:bigint,type:string,score:double>>, duration_ms double").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("id", "engine", "findings", "duration_ms").write.mode("overwrite").json(path)
