"""Surfaces that are identifiers of machines rather than names of people."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import java, python

# Anchored shapes.
SHAPES = {
    "uuid": r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$",
    "hex": r"^[0-9a-fA-F]{16,}$",
    "capitals_underscore": r"^[A-Z0-9]+(_[A-Z0-9]+)+$",
    "dotted_path": r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+){2,}$",
    "model": r"^[a-z][a-z0-9]*(-[a-z0-9]+)*-?\d+[a-z0-9.]*$",
    "locale": r"^[a-z]{2,3}([-_][A-Za-z]{2,4}){1,3}$",
    "version": r"^[vV]?\d+(\.\d+){1,3}([-+][0-9A-Za-z.]+)?$",
}
BASE64, BASE64_SIGN = r"^[A-Za-z0-9+/_=-]{24,}$", r"[0-9+/_=]"
MODEL_LOOSE, DIGIT = r"^[a-z][a-z0-9.]*(-[a-z0-9.]+)+$", r"[0-9]"
NO_LETTERS = r"^[\d\p{P}\p{S}\s]+$"  # ages are numbers, so it holds for the other entities
SNAKE, SNAKE_NAME = r"^[A-Za-z0-9]+(_[A-Za-z0-9]+)+$", r"^[A-Z][a-z]+(_[A-Z][a-z]+)+\d{0,4}$"
MONEY_SHAPE = r"^\s*(?:(?:EUR|USD|GBP|CHF|€|\$|£)\s*\d[\d.,]*|\d[\d.,]*\s*(?:EUR|USD|GBP|CHF|€|\$|£))\s*$"
LEGAL = r"§|\b(?:ZPO|BGB|StGB|StPO|HGB|GG|InsO|FamFG|GVG|AktG|GmbHG|EGBGB|RVG|GKG|VwGO|SGB|AO)\b"
LEGAL_EXHIBIT = r"^(?:Anlage\s+)?[A-Z]\d{1,3}$"
CLINICAL = r"(?i)^\s*(?:servicio|servei|unidad|unitat|[áa]rea|secci[oó]n|departamento|dpto\.?)\s+de\s+[a-záéíóúñü]+(?:\s+[a-záéíóúñü]+){0,2}\.?\s*$"
CLINICAL_CENTRE = r"(?i)^\s*centro(?:\s+de\s+salud)?\s*$"
FUZZY = ("PERSON", "ORGANIZATION", "LOCATION", "NRP", "PROFESSION", "AGE")
NOT_NAMES = frozenset("i you we he she it they sie wir er es please kindly hello hi thanks regards dear use check contact note attention all child children student students parent parents client clients customer customers user users member members caller applicant guest tenant subscriber vendor male female".split())
#: What tokens are made of, and (for Java) the tokens of a text that can have a shape: all but words of up to 15 letters,
#: maybe with a full stop, which are nearly all and have none.
TOKEN = "A-Za-z0-9_.@+/=-"
TOKENS = rf"(?<![{TOKEN}])(?![A-Za-z]{{1,15}}+\.?(?![{TOKEN}]))[{TOKEN}]++"
#: (shape, and also, and not)
_RULES = [*((s, None, None) for s in SHAPES.values()), (BASE64, BASE64_SIGN, None), (MODEL_LOOSE, DIGIT, None), (SNAKE, None, SNAKE_NAME)]


@lru_cache(maxsize=1 << 16)
def is_structural(surface: str) -> bool:
    s = surface.strip()
    return bool(s) and any(python(shape).search(s) and (also is None or python(also).search(s)) and (no is None or not python(no).search(s)) for shape, also, no in _RULES)


def is_structural_col(surface: Column) -> Column:
    s = F.trim(surface)
    has = lambda p: s.rlike(java(p))
    one = lambda shape, also, no: has(shape) & (has(also) if also else F.lit(True)) & (~has(no) if no else F.lit(True))
    return reduce(lambda a, b: a | b, [one(*r) for r in _RULES])


def rejected(entity: Column, surface: Column, shapes: bool = True, money: bool = True, legal: bool = False, clinical: bool = False, stop: tuple[str, ...] = ()) -> Column:
    """What the filter behind model-backed recognizers drops: amounts posing as ids, pronouns and roles posing as names,
    and, where asked for, machine shapes, stop words, statutes and department names."""
    has = lambda p: surface.rlike(java(p))
    fuzzy = entity.isin(*FUZZY)
    low = F.lower(F.trim(surface))
    out = F.lit(False)
    if money:
        out = out | (entity.isin("ID", "POSTAL_CODE") & has(MONEY_SHAPE))
    out = out | (fuzzy & low.isin(*sorted(NOT_NAMES)))
    if shapes:
        out = out | (fuzzy & (is_structural_col(surface) | ((entity != "AGE") & has(NO_LETTERS))))
    if stop:
        out = out | (fuzzy & low.isin(*stop))
    if legal:
        out = out | (entity.isin("ORGANIZATION", "LOCATION", "ID") & (has(LEGAL) | has(LEGAL_EXHIBIT)))
    if clinical:
        out = out | (entity.isin("ORGANIZATION", "LOCATION") & (has(CLINICAL) | has(CLINICAL_CENTRE)))
    return out
