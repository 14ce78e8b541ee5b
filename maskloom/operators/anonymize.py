"""Rewriting: findings to a new text and the list of what was replaced.

The rewrite is an expression: findings are resolved, neighbours of one entity merge if asked for, and a fold splices replacements into
the text. Operators are expressions over (surface, entity), so replace, redact, mask, hash, encrypt and keep never leave the
JVM. Synthetic values are a lookup by hash (see synthesize.py). Items carry the original start, and start + length of the
replacement as their end. A finding outside the text is an error. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import resolve_col

Operator = Callable[[Column, Column], Column]


def replace(value: str | None = None) -> Operator:
    return lambda s, e: F.concat(F.lit("<"), e, F.lit(">")) if value is None or value == "" else F.lit(value)


def redact() -> Operator:
    return lambda s, e: F.lit("")


def mask(char: str = "*", n: int = 0, from_end: bool = False) -> Operator:
    """n code points from the start or the end; 0, or as many as there are, masks all. Only the first code point of `char`."""
    c = (char or "*")[0]

    def run(s: Column, e: Column) -> Column:
        size = F.length(s)
        k = F.when((F.lit(n) <= 0) | (F.lit(n) >= size), size).otherwise(F.lit(n))
        stars = F.repeat(F.lit(c), k)
        return F.concat(F.left(s, size - k), stars) if from_end else F.concat(stars, F.right(s, size - k))

    return run


def hash_(algorithm: str = "sha256") -> Operator:
    if algorithm not in ("sha256", "sha512", ""):
        raise ValueError(f"unknown hash {algorithm!r}")
    return lambda s, e: F.sha2(s, 512 if algorithm == "sha512" else 256)


def encrypt(key: bytes) -> Operator:
    """AES-GCM with a random nonce in front, base64. The key has 16, 24 or 32 bytes."""
    if len(key) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return lambda s, e: F.base64(F.aes_encrypt(s.cast("binary"), F.unhex(F.lit(key.hex())), F.lit("GCM")))


def decrypt(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string")


def keep() -> Operator:
    return lambda s, e: s


def tokens(mapping: Column) -> Operator:
    """Tokens from a map column keyed by entity and surface (joined by a zero character); an unmapped surface is an error."""
    return lambda s, e: F.coalesce(F.element_at(mapping, F.concat(e, F.lit("\0"), s)), F.raise_error(F.concat(F.lit("no token for a value of "), e)).cast("string"))


@dataclass
class AnonymizerConfig:
    """operators: by entity; "*" for the others; replace without either. detect_only: entities left as they are. allow:
    surfaces left as they are (trimmed, any case). merge: neighbours of one entity with nothing but white space between are
    one value (the parts of a name); without it each finding is a value of its own (two addresses side by side)."""

    operators: dict[str, Operator] = field(default_factory=dict)
    detect_only: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    merge: bool = True

    def names(self) -> dict[str, str]:
        return {k: getattr(v, "__qualname__", "operator").split(".")[0].rstrip("_") for k, v in self.operators.items()}


def merge_adjacent_col(findings: Column, text: Column) -> Column:
    empty = F.filter(findings, lambda _: F.lit(False))

    def step(acc: Column, f: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.substring(text, (last["end"] + 1).cast("int"), (f["start"] - last["end"]).cast("int"))
        joins = (F.size(acc) > 0) & (last["entity"] == f["entity"]) & (f["start"] > last["end"]) & ~gap.rlike("[^ \\t\\n\\r]")
        merged = F.struct(last["start"].alias("start"), f["end"].alias("end"), F.greatest(last["score"], f["score"]).alias("score"), last["entity"].alias("entity"), last["recognizer"].alias("recognizer"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(f)))

    return F.aggregate(F.array_sort(findings), empty, step)


def anonymize(df: DataFrame, config: AnonymizerConfig | None = None, text: str = "text", findings: str = "findings", out: str = "anonymized", items: str = "items") -> DataFrame:
    """df with `out` and `items` (array of start, end, entity, operator, text). One fold per row, no shuffle."""
    config = config or AnonymizerConfig()
    names = config.names()

    def applied(s: Column, e: Column) -> tuple[Column, Column]:
        default = config.operators.get("*", replace())
        value, name = default(s, e), F.lit(names.get("*", "replace"))
        for entity, op in config.operators.items():
            if entity != "*":
                value, name = F.when(e == entity, op(s, e)).otherwise(value), F.when(e == entity, F.lit(names[entity])).otherwise(name)
        return value, name

    t = F.col(text)
    size = F.length(t)
    bad = F.exists(F.col(findings), lambda f: (f["start"] < 0) | (f["start"] > f["end"]) | (f["end"] > size))
    checked = F.when(bad, F.raise_error(F.lit("a finding lies outside the text")).cast(df.schema[findings].dataType)).otherwise(F.col(findings))
    resolved = resolve_col(checked)
    x = df.withColumn("_resolved", merge_adjacent_col(resolved, t) if config.merge else resolved)

    def made(f: Column) -> Column:
        s = F.substring(t, (f["start"] + 1).cast("int"), (f["end"] - f["start"]).cast("int"))
        value, name = applied(s, f["entity"])
        verbatim = f["entity"].isin(*config.detect_only) if config.detect_only else F.lit(False)
        if config.allow:
            verbatim = verbatim | F.lower(F.trim(s)).isin(*[a.strip().lower() for a in config.allow])
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["entity"].alias("entity"), name.alias("operator"), F.when(verbatim, s).otherwise(value).alias("text"), verbatim.alias("verbatim"))

    x = x.withColumn("_made", F.transform("_resolved", made))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, m: F.struct(F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int")), m["text"]).alias("out"), m["end"].alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (size - a["at"]).cast("int")))
    new = F.when(F.size("_made") == 0, t).otherwise(F.aggregate("_made", zero, step, rest))
    listed = F.transform(F.filter("_made", lambda m: ~m["verbatim"]), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), m["entity"].alias("entity"), m["operator"].alias("operator"), m["text"].alias("text")))
    return x.withColumn(out, new).withColumn(items, listed).drop("_resolved", "_made")
