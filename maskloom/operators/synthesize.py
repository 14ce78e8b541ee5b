"""Synthetic values: same kind, same shape, other content.

Consistent mode derives everything from sha256(entity, zero byte, surface), so equal values have equal stand-ins everywhere;
with a scope (a document's id) only within it; random mode draws anew. Card numbers keep their separators and pass Luhn,
IBANs keep country and grouping and pass MOD 97, addresses keep their class (private or public, version), hardware
addresses are locally administered and keep separators and case; digits elsewhere become other digits in place.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as C

# What stand-ins are put together from: our own syllables and words, so that no stand-in is anybody's by design. Domains are
# those that are reserved for examples: no stand-in is a mailbox or site of someone's.
FIRST = tuple(a + b for a in ("Bel", "Cor", "Dar", "El", "Fen", "Jor", "Lin", "Mar", "Nor", "Sel", "Tam", "Ver") for b in ("a", "en", "ia", "is", "o", "wyn"))
LAST = tuple(a + b for a in ("Ash", "Birch", "Cold", "Dun", "Elm", "Gray", "Hol", "Marsh", "Oak", "Stan", "Thorn", "Wil") for b in ("brook", "by", "ford", "ley", "man", "well"))
CITIES = tuple(a + b for a in ("Alder", "Bracken", "Clay", "East", "Fox", "High", "Lake", "Mill", "North", "Stone") for b in ("bridge", "bury", "field", "haven", "mouth", "ton"))
COMPANIES = tuple(f"{a} {b}" for a in ("Bluefin", "Copperline", "Dovetail", "Emberly", "Foxglove", "Glasswing", "Hazelnut", "Ivorydale", "Larkfield", "Mistral") for b in ("Freight", "Instruments", "Mills", "Optics", "Works"))
DOMAINS = ("example.com", "example.net", "example.org")


def seeded(entity: str, surface: str, scope: str | None = None) -> random.Random:
    key = f"{entity}\0{surface}" + (f"\0{scope}" if scope is not None else "")
    return random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little"))


def _digits(rng: random.Random, s: str) -> str:
    """Other digits in the same places."""
    return "".join(str(rng.randrange(10)) if c.isascii() and c.isdigit() else c for c in s)


def _card(rng: random.Random, s: str) -> str:
    new = _digits(rng, s)
    body = [c for c in new if c.isdigit()]
    if not body:
        return new
    last = next(str(d) for d in range(10) if C.luhn("".join(body[:-1]) + str(d)))
    at = max(i for i, c in enumerate(new) if c.isdigit())
    return new[:at] + last + new[at + 1 :]


def _iban(rng: random.Random, s: str) -> str:
    flat = s.replace(" ", "").upper()
    country, body = flat[:2], "".join(str(rng.randrange(10)) if c.isdigit() else rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isalpha() else c for c in flat[4:])
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    new = iter(f"{country}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _ip(rng: random.Random, s: str) -> str:
    try:
        ip = ipaddress.ip_address(s)
    except ValueError:
        return _digits(rng, s)
    if ip.version == 6:
        return "2001:db8:" + ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(6))
    if ip.is_private:
        first = s.split(".")[0]
        head = {"10": ["10", str(rng.randrange(256))], "172": ["172", str(rng.randrange(16, 32))]}.get(first, ["192", "168"])
    else:
        head = ["203", "0"]
        return f"203.0.113.{rng.randrange(1, 255)}"
    return ".".join([*head, str(rng.randrange(256)), str(rng.randrange(1, 255))])


def _mac(rng: random.Random, s: str) -> str:
    sep = "-" if "-" in s else ":"
    new = sep.join(f"{(rng.randrange(256) | 2) & 0xFE if i == 0 else rng.randrange(256):02x}" for i in range(6))
    return new.upper() if any(c in "ABCDEF" for c in s) else new


def _ssn(rng: random.Random, s: str) -> str:
    sep = next((c for c in s if not c.isdigit()), "-")
    area = rng.choice([x for x in (rng.randrange(1, 900),) if x != 666] or [123])
    return f"{area:03d}{sep}{rng.randrange(1, 100):02d}{sep}{rng.randrange(1, 10000):04d}"


def _itin(rng: random.Random, s: str) -> str:
    sep = next((c for c in s if not c.isdigit()), "-")
    return f"9{rng.randrange(100):02d}{sep}{rng.choice([*range(70, 89), 90, 91, 92, *range(94, 100)]):02d}{sep}{rng.randrange(10000):04d}"


def _crypto(rng: random.Random, s: str) -> str:
    if s.startswith("0x"):
        return "0x" + "".join(rng.choice("0123456789abcdef") for _ in s[2:])
    keep = 3 if s.startswith("bc1") else 1
    return s[:keep] + "".join(rng.choice("023456789acdefghjklmnpqrstuvwxyz" if keep == 3 else C.BASE58) for _ in s[keep:])


def _letters(rng: random.Random, s: str) -> str:
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.islower() else c for c in _digits(rng, s))


def synthetic(surface: str, entity: str, rng: random.Random) -> str:
    pick = rng.choice
    makers = {
        "PERSON": lambda: f"{pick(FIRST)} {pick(LAST)}",
        "EMAIL_ADDRESS": lambda: f"{pick(FIRST).lower()}.{pick(LAST).lower()}{rng.randrange(100)}@{pick(DOMAINS)}",
        "CREDIT_CARD": lambda: _card(rng, surface), "US_SSN": lambda: _ssn(rng, surface), "US_ITIN": lambda: _itin(rng, surface), "IBAN_CODE": lambda: _iban(rng, surface),
        "IP_ADDRESS": lambda: _ip(rng, surface), "MAC_ADDRESS": lambda: _mac(rng, surface), "CRYPTO": lambda: _crypto(rng, surface), "US_PASSPORT": lambda: _letters(rng, surface),
        "URL": lambda: ("https://" if not re.match("(?i)http:", surface) else "http://") + pick(COMPANIES).split()[0].lower() + "." + pick(DOMAINS), "LOCATION": lambda: pick(CITIES), "ORGANIZATION": lambda: pick(COMPANIES),
    }
    make = makers.get(entity)
    return make() if make else _digits(rng, surface)


def synthesize(consistent: bool = True, scope: Column | None = None):
    """An operator for AnonymizerConfig.operators. Synthetic values are computed in batches; scope: values agree only where it
    is equal."""

    @F.pandas_udf("string")
    def run(surface: pd.Series, entity: pd.Series, within: pd.Series) -> pd.Series:
        rngs = (seeded(e, s, w) if consistent else random.Random(os.urandom(16)) for s, e, w in zip(surface, entity, within))
        return pd.Series([None if s is None else synthetic(s, e, r) for s, e, r in zip(surface, entity, rngs)])

    def synthesize_(s: Column, e: Column) -> Column:
        return run(s, e, scope.cast("string") if scope is not None else F.lit(None).cast("string"))

    return synthesize_


def synthesize_texts(df, text: str = "text", findings: str = "findings", out: str = "anonymized", consistent: bool = True, scope: str | None = None):
    """df with `out`: all findings replaced by synthetic values, in one Arrow pass (user-defined functions can't run inside
    higher-order functions, so the splice is done there too)."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T

    from ..functions.arrow import bounded_batches
    from .resolve import merge_adjacent, resolve

    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n)).to_pylist()
            within = col(scope) if scope else [None] * b.num_rows
            new = []
            for t, found, w in zip(col(text), col(findings), within):
                spans = merge_adjacent(resolve([(f["start"], f["end"], f["score"], f["entity"], f["recognizer"]) for f in found or []]), t or "")
                for s, e, _, entity, _ in reversed(spans):
                    rng = seeded(entity, t[s:e], None if w is None else str(w)) if consistent else random.Random(os.urandom(16))
                    t = t[:s] + synthetic(t[s:e], entity, rng) + t[e:]
                new.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
