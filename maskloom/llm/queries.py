"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(_table(spark, d, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, d, "documents"))


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    from .simhash import edited_fingerprints

    return edited_fingerprints(_table(spark, d, "documents"))


def op4_lm_score(spark: SparkSession, d: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(_table(spark, d, "documents"))


def op5_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic tables have no domain: sources fall in four by their number."""
    from .mixing import mix, source_domain

    mixed = mix(_table(spark, d, "documents").select("doc_id", "text", "lang", "source"), source_domain(F.col("source")), fraction=0.6, epochs=2)
    return mixed.select("doc_id", "lang", "source", "n_tokens", "copies")


def op6_quality_resampling(spark: SparkSession, d: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op7_warc_transactions(spark: SparkSession, d: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, d, "pages"))


def op8_kd_sharding(spark: SparkSession, d: str) -> DataFrame:
    from .sharding import shard_plan

    return shard_plan(_table(spark, d, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_minhash_near_dedup, op3_simhash, op4_lm_score, op5_source_mixing, op6_quality_resampling, op7_warc_transactions, op8_kd_sharding, op9_benchmark_decontamination, op10_toxicity)
}
_BASE32 = " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT), 32), 8, '0')" for i in range(4))

#: Window of 13 words, or the whole item where it has fewer.
_WORDS_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op7_warc_transactions": f"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             g AS (SELECT h AS k, min(page_id) AS lead FROM p GROUP BY h)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to,
               regexp_replace(url, '[\\r\\n]', '', 'g') AS url,
               'GET ' || regexp_replace(url, '[\\r\\n]', '', 'g') || ' HTTP/1.1' AS request_line,
               CASE WHEN page_id = lead THEN true END AS intact
        FROM p JOIN g ON p.h = g.k""",
    "op9_benchmark_decontamination": f"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_RE}') AS w FROM documents),
             iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_RE}') AS w FROM benchmark),
             win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
                     FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT n FROM win),
             pos AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
             hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, s)),
             cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit, list(DISTINCT k ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
             items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
             span AS (SELECT doc_id, string_agg(CAST(lo - 1 AS VARCHAR) || ',' || CAST(hi AS VARCHAR), ',' ORDER BY lo) AS spans
                      FROM (SELECT doc_id, min(k) AS lo, max(k) AS hi FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (SELECT doc_id, unnest(ks) AS k FROM cover)) GROUP BY doc_id, run) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
        FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN span USING (doc_id)""",
}
