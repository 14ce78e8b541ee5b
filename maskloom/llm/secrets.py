"""Secret scan: an Aho-Corasick pass finds keywords, anchored regular expressions run only where one was found, and
formats that embed a checksum (or a decodable header) are validated before they count.

The scan is row-local: one Arrow pass, no shuffle, memory bounded by `CHUNK` characters and the longest text.

Defined results: null and empty texts have no secrets; repeated rows give repeated results; a null doc_id is carried;
any other column of the input is ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks

CHUNK = 1_000_000
#: Kinds in the order that breaks ties between spans with the same start.
KINDS = ("assign", "access", "hex", "crc_token", "jwt", "pem", "prefixed")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs [0-9a-f]+ of 16 or more
_CRC = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+")
_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
_PREFIXED = re.compile(r"(?:sk_live_|rk_live_)[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35}")
#: Keywords, lower-cased, and the kinds whose expression may start there.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"), "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "crc_token"), "eyj": "jwt", "-----begin ": "pem",
    **dict.fromkeys(("sk_live_", "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "aiza"), "prefixed"),
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: str) -> str:
    """The six digits that tokens with an embedded checksum end in."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0")


def _is_jwt(header: str) -> bool:
    try:
        return isinstance(h := json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4))), dict) and "alg" in h
    except ValueError:
        return False


#: kind -> (anchored expression, whether a match counts)
_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "crc_token": (_CRC, lambda m: base62_crc32(m[2]) == m[3]),
    "jwt": (_JWT, lambda m: _is_jwt(m[1])),
    "pem": (_PEM, lambda m: True),
    "prefixed": (_PREFIXED, lambda m: True),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find_spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every secret, in code points, sorted; leftmost and non-overlapping by kind."""
    if not text:
        return []
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    low = text.lower()
    if len(low) != len(text):  # some letters lengthen; then fold ASCII alone
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    hits: dict[str, list[int]] = {}
    for last, (kind, n) in automaton.iter(low):
        hits.setdefault(kind, []).append(last - n + 1)
    for kind, starts in hits.items():
        rule, counts = _RULES[kind]
        end = dead = 0
        for s in sorted(starts):
            if s < end or s < dead:
                continue
            if m := rule.match(text, s):
                end = m.end()
                if counts(m):
                    found.append((s, KINDS.index(kind), end))
            elif kind == "jwt" and (run := _RUN.match(text, s)):
                dead = run.end()  # nor does a token begin later in a run of which none began here: what follows it is the same
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for b in chunks(batches, CHUNK):
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_validated")}
        for text in b.column("text").to_pylist():
            spans = find_spans(text, automaton)
            base = [x for x in spans if x[1] < 3]
            for k in range(3):
                out[("n_assign", "n_access", "n_hex")[k]].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_validated"].append(len(spans) - len(base))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **out}, schema=_ARROW)


_ARROW = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_validated", pa.int64())])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, the digest of the base spans, all spans, and how many of the added
    kinds (validated by checksum, header or fixed prefix) were found."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_validated long"
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns kept, with every span (overlapping ones merged) replaced by `mark`."""
    names, schema = docs.columns, docs.schema
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in chunks(batches, CHUNK):
            out = []
            for text in b.column("text").to_pylist():
                merged: list[list[int]] = []
                for s, _, e in find_spans(text, automaton):
                    if merged and s < merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                for s, e in reversed(merged):
                    text = text[:s] + mark + text[e:]
                out.append(text)
            i = names.index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    return docs.mapInArrow(run, schema)


def spans_column(spans: Column) -> Column:
    """The joined spans as an array of structs (kind, start, end)."""
    one = lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"))
    return F.transform(F.filter(F.split(spans, ","), lambda x: x != ""), one)
