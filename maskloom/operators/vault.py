"""The token vault: reversible anonymisation as joins over tables.

Tokens look like <ENTITY_TENANT_000001>. A token belongs to (tenant, document); equal values of one entity share one within a
document. Numbers are dense ranks by first appearance inside the document, and the document is part of the vault's key, so
a later run never overwrites an earlier mapping. Tables: vault(tenant_id, id, token, entity_type, cleartext, expires_at) and
records(tenant_id, id, content_format, anonymized_content, tokens).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("tenant_id", "id")


def build_token(entity: Column, tenant: Column, number: Column) -> Column:
    return F.concat(F.lit("<"), entity, F.lit("_"), F.upper(F.replace(tenant, F.lit("-"), F.lit("_"))), F.lit("_"), F.lpad(number.cast("string"), 6, "0"), F.lit(">"))


def mint(findings: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """findings: tenant_id, id, segment (any), start, entity, surface -> the vault's rows. One shuffle, by document."""
    first = findings.groupBy(*KEY, "entity", "surface").agg(F.min(F.struct("segment", "start")).alias("at"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("at", "entity", "surface"))
    expires = F.lit(None).cast("timestamp") if ttl_seconds is None else F.current_timestamp() + F.make_interval(secs=F.lit(ttl_seconds))
    return first.select(*KEY, build_token(F.col("entity"), F.col("tenant_id"), number).alias("token"), F.col("entity").alias("entity_type"), F.col("surface").alias("cleartext"), expires.alias("expires_at"))


def numbered(findings: DataFrame) -> DataFrame:
    """findings (see mint) with the token of each: mint's numbers as windows over one shuffle by document, so that a finding
    needs no join to meet its token."""
    first = F.min(F.struct("segment", "start")).over(Window.partitionBy(*KEY, "entity", "surface"))
    number = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("_first", "entity", "surface"))
    return findings.repartition(*KEY).withColumn("_first", first).withColumn("token", build_token(F.col("entity"), F.col("tenant_id"), number)).drop("_first")


def ingest(docs: DataFrame, registry=None, config=None, content: str = "content", format_column: str | None = None, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """docs: tenant_id, id, content, maybe a format and language -> (records, vault). The content's pieces are analysed, values
    get tokens, pieces are rewritten and the content is put together again. Offsets of tokens are within their piece. merge:
    neighbours of one entity are one value (see AnonymizerConfig)."""
    from ..functions.language import detect_language
    from ..plans.analyze import analyze
    from ..sources.formats import rebuild, resolve_auto, segments, strip_ansi_col
    from .anonymize import merge_adjacent_col
    from .resolve import resolve_col

    clean = strip_ansi_col(F.col(content))
    kind = F.col(format_column) if format_column else resolve_auto(F.col(content))
    base = docs.withColumn(content, clean).withColumn("_kind", kind)
    pieces = segments(base, [*KEY], content, F.col("_kind")).withColumn("lang", F.coalesce(F.nullif(detect_language(F.col("text")), F.lit("")), F.lit("en")))
    found = analyze(pieces, language="lang", config=config, registry=registry)
    resolved = resolve_col(F.col("findings"))
    found = found.withColumn("findings", merge_adjacent_col(resolved, F.col("text")) if merge else resolved)
    rows = found.select(*KEY, "segment", F.explode("findings").alias("f"), "text").select(*KEY, "segment", "f.start", "f.end", "f.entity", F.substring("text", (F.col("f.start") + 1).cast("int"), (F.col("f.end") - F.col("f.start")).cast("int")).alias("surface"))
    refs = numbered(rows)
    vault = refs.select(*KEY, "token", F.col("entity").alias("entity_type"), F.col("surface").alias("cleartext"), F.lit(None).cast("timestamp").alias("expires_at")).distinct()
    by_piece = refs.groupBy(*KEY, "segment").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token", "entity"))).alias("refs"))
    t = F.col("text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, m: F.struct(F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int")), m["token"]).alias("out"), m["end"].alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (F.length(t) - a["at"]).cast("int")))
    new = pieces.join(by_piece, [*KEY, "segment"]).select(*KEY, "segment", F.aggregate("refs", zero, step, rest).alias("new"), "refs")
    docs_new = new.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("segment", "new"))).alias("_new"), F.flatten(F.collect_list("refs")).alias("tokens"))
    whole = rebuild(base.join(docs_new, [*KEY], "left"), content, F.col("_kind"), "_new", "anonymized_content")
    records = whole.select(*KEY, F.col("_kind").alias("content_format"), "anonymized_content", F.coalesce("tokens", F.array().cast("array<struct<start:bigint,end:bigint,token:string,entity:string>>")).alias("tokens"))
    return records, vault


def alive(vault: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return vault.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def linked(records: DataFrame) -> DataFrame:
    """(tenant_id, id, token): which tokens a record may resolve."""
    return records.select(*KEY, F.explode("tokens.token").alias("token")).distinct()


def unlinked(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requested tokens (tenant_id, id, token) that do not belong to the record: must be none."""
    return requests.join(linked(records), [*KEY, "token"], "left_anti")


def detokenize(requests: DataFrame, records: DataFrame, vault: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """requests: tenant_id, id, token, actor, purpose -> cleartext. Only linked, unexpired tokens; with `policy` (actor,
    purpose) only for those it lists."""
    asked = requests if policy is None else requests.join(policy.select("actor", "purpose").distinct(), ["actor", "purpose"], "left_semi")
    return asked.join(linked(records), [*KEY, "token"], "left_semi").join(alive(vault).select(*KEY, "token", "entity_type", "cleartext"), [*KEY, "token"])


def reveal(records: DataFrame, vault: DataFrame, out: str = "content") -> DataFrame:
    """records with `out`: tokens replaced by what they stand for, in one pass, longest first. Records without tokens are
    returned as they are; expired tokens stay. Replacement in JSON is inside string leaves, so values are escaped anew."""
    from ..functions.arrow import bounded_batches
    from ..sources.formats import dumps, mapped

    bounded_batches(records.sparkSession)
    maps = alive(vault).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("token", "cleartext"))).alias("_map"))

    @F.pandas_udf("string")
    def run(content: pd.Series, kind: pd.Series, by: pd.Series) -> pd.Series:
        import json

        def one(c, k, m):
            if c is None or m is None or not len(m):
                return c
            m = dict(m)
            p = re.compile("|".join(re.escape(t) for t in sorted(m, key=lambda t: (-len(t), t))))
            plain = lambda s: p.sub(lambda x: m[x[0]], s)
            tree = lambda s: dumps(mapped(json.loads(s), lambda _, t: plain(t)))
            if k == "json":
                return tree(c)
            if k in ("ndjson", "logs"):
                lines = []
                for line in c.split("\n"):
                    try:
                        lines.append(tree(line) if line.strip() else line)
                    except ValueError:
                        lines.append(plain(line))
                return "\n".join(lines)
            return plain(c)

        return pd.Series([one(*x) for x in zip(content, kind, by)])

    return records.join(maps, [*KEY], "left").withColumn(out, run("anonymized_content", "content_format", "_map")).drop("_map")


def delete(vault: DataFrame, records: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vault, records, counts) without the documents of `gone` (tenant_id, id). Deleting twice changes nothing."""
    keys = gone.select(*KEY).distinct()
    counts = vault.join(keys, [*KEY], "left_semi").groupBy(*KEY).agg(F.countDistinct("token").alias("tokens_deleted"))
    return vault.join(keys, [*KEY], "left_anti"), records.join(keys, [*KEY], "left_anti"), counts


def shared_tokens(conversations: DataFrame, findings: DataFrame) -> DataFrame:
    """One token map for all turns of a conversation: mint with the conversation as the document."""
    return mint(findings.select(F.lit("chat").alias("tenant_id"), F.col("conv_id").cast("string").alias("id"), F.lpad(F.col("turn").cast("string"), 10, "0").alias("segment"), "start", "entity", "surface"))


def encrypted(vault: DataFrame, key: bytes) -> DataFrame:
    """The vault with cleartext encrypted at rest."""
    return vault.withColumn("cleartext", F.base64(F.aes_encrypt(F.col("cleartext").cast("binary"), F.unhex(F.lit(key.hex())), F.lit("GCM"))))


def decrypted(vault: DataFrame, key: bytes) -> DataFrame:
    return vault.withColumn("cleartext", F.aes_decrypt(F.unbase64("cleartext"), F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string"))


def write_table(df: DataFrame, path: str) -> None:
    """Partitioned by tenant: reads of one tenant touch its files alone."""
    df.repartition("tenant_id").write.mode("overwrite").partitionBy("tenant_id").parquet(path)
