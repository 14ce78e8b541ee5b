"""Order and conflicts of findings.

Findings are sorted by start, then score (high first), length (long first), rank of the recognizer, entity: a total order.
A left fold compares each with the last one kept, and only with that; so a later, better finding that overlaps takes the
place of the earlier one and the head of the loser is left uncovered. `cover` unites overlapping spans instead, where
leaving nothing uncovered matters more.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Finding

# Names and entities that conflicts are decided by.
MODELS = frozenset(("GLiNERRecognizer", "GLiNERFlatNERRecognizer", "GLiNERPool", "GLiNERFlatPool"))
PREFERRED = frozenset(("PERSON", "ORGANIZATION", "LOCATION", "AGE", "PROFESSION", "NRP"))
ADDRESSES = frozenset(("POSTAL_CODE", "STREET_ADDRESS", "ADDRESS"))
VALIDATED = frozenset(
    f"{n}Recognizer"
    for n in "AUTFN AUABN AUACN AUMedicare INAadhaar INPAN ESNIF ESNIE ITFiscalCode ITVATCode PLPESEL FIPersonalIdentityCode KRRRN SGNRIC UKNHS DESteuerID ISIN USNPI USDEA USMBI".split()
)


def sort_findings(found: list[Finding], rank: Mapping[str, int] | None = None) -> list[Finding]:
    rank = rank or {}
    return sorted(found, key=lambda f: (f[0], -f[2], f[0] - f[1], rank.get(f[4], 1 << 30), f[3], f[4]))


def replaces(kept: Finding, new: Finding) -> bool:
    """Whether `new` takes the place of the overlapping `kept`."""
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    model_kept, model_new = kept[4] in MODELS, new[4] in MODELS
    guard = lambda f, model, entity: (f[4] in VALIDATED and entity in PREFERRED) or (not model and f[3] in ADDRESSES)
    if model_new and inside(new, kept) and guard(kept, model_kept, new[3]):
        return False
    if model_kept and inside(kept, new) and guard(new, model_new, kept[3]):
        return True
    if kept[3] == new[3] and new[3] in PREFERRED and model_kept != model_new:
        return model_new
    return new[2] > kept[2]


def resolve(found: list[Finding], rank: Mapping[str, int] | None = None, on_conflict: Callable[[str, str], None] | None = None) -> list[Finding]:
    out: list[Finding] = []
    kind = lambda f: "ner" if f[4] in MODELS else "pattern"
    for f in sort_findings(found, rank):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
            continue
        won = replaces(out[-1], f)
        if on_conflict:
            on_conflict(kind(f if won else out[-1]), kind(out[-1] if won else f))
        if won:
            out[-1] = f
    return out


def cover(found: list[Finding], rank: Mapping[str, int] | None = None) -> list[Finding]:
    """Unions of overlapping spans, each with the entity of its best finding."""
    out: list[Finding] = []
    for f in sort_findings(found, rank):
        if out and f[0] < out[-1][1]:
            best = f if f[2] > out[-1][2] else out[-1]
            out[-1] = (out[-1][0], max(out[-1][1], f[1]), *best[2:])
        else:
            out.append(f)
    return out


def merge_adjacent(found: list[Finding], text: str) -> list[Finding]:
    """Neighbours of one entity with nothing but white space between become one; the higher score stays."""
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: f[0]):
        if out and f[3] == out[-1][3] and f[0] > out[-1][1] and not text[out[-1][1] : f[0]].strip(" \t\n\r"):
            out[-1] = (out[-1][0], f[1], max(f[2], out[-1][2]), *out[-1][3:])
        else:
            out.append(f)
    return out


# -- The same over array columns -------------------------------------------------------------------------------------


def _isin(c: Column, values: frozenset[str]) -> Column:
    return c.isin(*sorted(values))


def replaces_col(kept: Column, new: Column) -> Column:
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])
    model = lambda f: _isin(f["recognizer"], MODELS)
    guard = lambda f, other: (_isin(f["recognizer"], VALIDATED) & _isin(other["entity"], PREFERRED)) | (~model(f) & _isin(f["entity"], ADDRESSES))
    return (
        F.when(model(new) & inside(new, kept) & guard(kept, new), F.lit(False))
        .when(model(kept) & inside(kept, new) & guard(new, kept), F.lit(True))
        .when((kept["entity"] == new["entity"]) & _isin(new["entity"], PREFERRED) & (model(kept) != model(new)), model(new))
        .otherwise(new["score"] > kept["score"])
    )


def resolve_col(findings: Column) -> Column:
    """The fold as an expression, over array<struct<start,end,score,entity,recognizer>>. Ties beyond start, score and length
    go by entity and recognizer."""
    key = lambda f: F.struct(f["start"], -f["score"], f["start"] - f["end"], f["entity"], f["recognizer"])
    ordered = F.array_sort(findings, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    empty = F.filter(findings, lambda _: F.lit(False))

    def step(acc: Column, f: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (f["start"] >= last["end"]), F.concat(acc, F.array(f))).when(replaces_col(last, f), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(f))).otherwise(acc)

    return F.aggregate(ordered, empty, step)
