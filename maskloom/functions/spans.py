"""Span expressions in Catalyst: find all matches of a pattern, with offsets, inside generated plans.

Spark has no find-all with offsets. Each match is put between two marks, so one run of the regular expression is enough, and
running sums over the pieces between marks are the offsets. Texts that hold a mark go another way: the pieces between
matches (split) and the matches (regexp_extract_all) alternate. No pattern may match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import java


#: What stands before and after a match: code points that are no characters.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
SPANS_DDL = "array<struct<start:bigint,end:bigint,surface:string>>"


def _added(acc: Column, start: Column, hit: Column, at: Column) -> Column:
    """acc with one more span, and `at` as the place it has come to."""
    span = F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("surface"))
    return F.struct(at.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))


def spans(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start bigint, end bigint, surface string>>. `needs` is an expression without which nothing can match: it
    spares most rows the regular expression. Null text: an empty array."""
    p = F.lit(java(pattern))
    none = F.array().cast(SPANS_DDL)
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def piece(acc: Column, x: Column) -> Column:
        """x: a match, its closing mark and what follows, or what stands before the first match."""
        cut = F.instr(x, CLOSE)
        end = acc["at"] + F.length(x)
        return F.when(cut == 0, F.struct(end.alias("at"), acc["out"].alias("out"))).otherwise(_added(acc, acc["at"], F.left(x, cut - 1), end - 1))

    def pair(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return _added(acc, start, x["hit"], start + F.length(x["hit"]))

    marked = F.split(F.regexp_replace(text, p, F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    gaps, hits = F.split(text, java(pattern), -1), F.regexp_extract_all(text, p, F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    out = lambda a: a["out"]
    holds = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    test = text.isNotNull() if needs is None else F.coalesce(text.rlike(needs), F.lit(False))
    return F.when(~test, none).when(holds, F.aggregate(pairs, zero, pair, out)).otherwise(F.aggregate(marked, zero, piece, out))
