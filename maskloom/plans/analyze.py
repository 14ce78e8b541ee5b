"""Analysis: text to findings, one row-local Arrow pass for all recognizers, without a shuffle.

Order: escape sequences are removed (offsets map back at the end), recognizers are selected when the plan is built, their
findings are united, keywords nearby raise scores, the deny-list adds and the allow-list drops, the threshold applies after
the boost, conflicts are resolved, offsets are mapped to the original text. Offsets are code points, half-open.

Null and empty texts have no findings. A recognizer that fails on a text contributes nothing; only if all of them fail does
the row fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import bounded_batches
from ..functions.dialect import python
from ..operators.registry import Finding, Recognizer, Registry, compiled
from ..operators.resolve import resolve, sort_findings
from ..operators.shapes import is_structural

ANSI = re.compile("\x1b\\[[0-9;]*[A-Za-z]")


@dataclass(frozen=True)
class ContextConfig:
    window: int = 80
    boost: float = 0.35


@dataclass(frozen=True)
class AnalysisConfig:
    """language: of texts without a language column (an empty or null language is `en`). entities: select recognizers that
    support one of them. threshold: findings below it go, if it is above 0."""

    language: str = "en"
    entities: tuple[str, ...] = ()
    threshold: float = 0.0
    remove_conflicts: bool = True
    no_models: bool = False
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    context: ContextConfig | None = field(default_factory=ContextConfig)


def strip_ansi(text: str) -> tuple[str, list[int] | None]:
    """The text without colour codes, and for each code point left its place in the original (None: unchanged)."""
    if "\x1b" not in text:
        return text, None
    out, places, at = [], [], 0
    for m in ANSI.finditer(text):
        out.append(text[at : m.start()])
        places += range(at, m.start())
        at = m.end()
    places += range(at, len(text))
    return "".join(out) + text[at:], places


@lru_cache(maxsize=None)
def _any_word(words: tuple[str, ...], edge: str):
    body = "|".join(re.escape(w) for w in sorted({w.strip().lower() for w in words if w.strip()}, key=lambda w: (-len(w), w)))
    return re.compile(f"(?<![{edge}])(?:{body})(?![{edge}])") if body else None


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Engine:
    """What a worker holds: compiled recognizers of one configuration."""

    def __init__(self, recognizers: list[Recognizer], config: AnalysisConfig):
        from ..operators.procedures import PROCEDURES

        self.config, self.rank = config, {r.name: i for i, r in enumerate(recognizers)}
        self.recognizers = [(r, compiled(r), PROCEDURES[r.procedure] if r.procedure else r.fn) for r in recognizers]
        #: The patterns, as one, of recognizers that have nothing else.
        self.own = {id(r): "|".join(f"(?:{p[0]})" for p in r.patterns) for r, patterns, more in self.recognizers if patterns and more is None}
        self._by_language: dict[str, tuple[list, dict[str, tuple[str, ...]]]] = {}
        self.allow = frozenset(a.strip().lower() for a in config.allow)
        self.deny = [re.compile(re.escape(d), re.I) for d in dict.fromkeys(config.deny) if d]

    def speaking(self, language: str):
        """Recognizers of a language, and keywords by entity: one recognizer's raise another's findings."""
        if language not in self._by_language:
            chosen = [x for x in self.recognizers if x[0].speaks(language)]
            words: dict[str, tuple[str, ...]] = {}
            for r, _, _ in chosen:
                for entity, own in r.keywords.items():
                    words[entity] = words.get(entity, ()) + own
            self._by_language[language] = chosen, words
        return self._by_language[language]

    def guards(self, texts: pa.Array, languages: set[str]) -> dict[str | int, list[bool | None]]:
        """Which texts of a batch pass each guard of their languages' recognizers. Guards are RE2 texts, so Arrow's RE2 runs them
        over the whole batch; one that RE2 refuses is left out, and `analyze` searches for it itself. Patterns are RE2 texts
        too: those of a recognizer that has nothing else are run over the texts that pass its guard, so that Python's engine
        meets only texts with matches."""
        found: dict[str | int, pa.Array | None] = {}

        def passed(name: str | int, pattern: str, among: pa.Array | None = None) -> pa.Array | None:
            if name not in found:
                try:
                    hits = pc.match_substring_regex(texts if among is None else texts.filter(among), pattern)
                    found[name] = hits if among is None else pc.replace_with_mask(pa.array([False] * len(texts)), pc.fill_null(among, False), hits)
                except pa.ArrowInvalid:
                    found[name] = None
            return found[name]

        for lang in languages:
            for r, _, _ in self.speaking(lang)[0]:
                first = None if r.needs is None else passed(r.needs, r.needs)
                if id(r) in self.own:
                    passed(id(r), self.own[id(r)], first)
        return {name: hits.to_pylist() for name, hits in found.items() if hits is not None}

    def analyze_batch(self, texts: pa.Array, languages: list[str | None]) -> list[list[Finding]]:
        """Findings of each text of a batch."""
        hits = self.guards(texts, {lang or self.config.language or "en" for lang in languages})
        return [self.analyze(t.as_py(), lang, {g: h[i] for g, h in hits.items()}) for i, (t, lang) in enumerate(zip(texts, languages))]

    def _of(self, r: Recognizer, patterns, more, text: str, low: str) -> list[Finding]:
        found: list[tuple[int, int, float, str]] = list(more(text)) if more else []
        if patterns:
            best: dict[tuple[int, int], tuple[float, str]] = {}
            for p, score, entity in patterns:
                for m in p.finditer(text):
                    s, e = m.span(r.group)
                    if r.unique:
                        if (s, e) not in best or best[s, e][0] < score:
                            best[s, e] = (score, entity)
                    else:
                        found.append((s, e, score, entity))
            found += [(s, e, score, entity) for (s, e), (score, entity) in best.items()]
        out = []
        for s, e, score, entity in found:
            if r.check is not None:
                surface = text[s:e]
                if r.check(r.normalize(surface) if r.normalize else surface):
                    score = score if r.keep_score else 1.0
                elif r.keep_failed is None:
                    continue
                else:
                    score = r.keep_failed
            if r.gate:
                words = _any_word(r.keywords[entity], "a-z0-9_" if r.gate_underscore else "a-z0-9")
                near = (low[max(0, s - r.gate) : s], low[e : e + r.gate]) if r.gate_underscore else (low[max(0, s - r.gate) : e + r.gate],)
                if not any(words.search(w) for w in near):
                    continue
            if r.no_structural and is_structural(text[s:e]):
                continue
            out.append((s, e, score, entity, r.name))
        return out

    def analyze(self, text: str | None, language: str | None = None, guards: dict[str | int, bool | None] | None = None) -> list[Finding]:
        """guards: which guards the text passes, as far as that is known; by a recognizer's id, whether its patterns match."""
        if not text:
            return []
        cfg = self.config
        text, places = strip_ansi(text)
        chosen, words = self.speaking(language or cfg.language or "en")
        low, seen, found, failed = _fold(text), guards if guards and places is None else {}, [], 0
        for r, patterns, more in chosen:
            if r.needs is not None:
                if r.needs not in seen:
                    seen[r.needs] = python(r.needs).search(text) is not None
                if not seen[r.needs]:
                    continue
            if seen.get(id(r)) is False:
                continue
            try:
                found += self._of(r, patterns, more, text, low)
            except Exception:
                failed += 1
        if failed and failed == len(chosen):
            raise ValueError("every recognizer failed on this text")
        if cfg.context is not None:
            found = [self._boosted(f, words, low) for f in found]
        for d in self.deny:
            found += [(m.start(), m.end(), 1.0, "DENY_LIST", "DenyListScanner") for m in d.finditer(text)]
        if self.allow:
            found = [f for f in found if text[f[0] : f[1]].strip().lower() not in self.allow]
        if cfg.threshold > 0:
            found = [f for f in found if f[2] >= cfg.threshold]
        found = resolve(found, self.rank) if cfg.remove_conflicts else sort_findings(found, self.rank)
        if places is not None:
            found = [(places[s], places[e - 1] + 1, *rest) for s, e, *rest in found if 0 <= s < e <= len(places)]
        return found

    def _boosted(self, f: Finding, words: dict[str, tuple[str, ...]], low: str) -> Finding:
        s, e, score, entity, name = f
        own = _any_word(words[entity], "a-zA-Z0-9_") if entity in words else None
        w = self.config.context.window
        if own is not None and (own.search(low[max(0, s - w) : s]) or own.search(low[e : e + w])):
            score = min(score + self.config.context.boost, 1.0)
        return s, e, score, entity, name


FINDING = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("entity", T.StringType()), T.StructField("recognizer", T.StringType())])
FINDINGS_DDL = "array<struct<start:bigint,end:bigint,score:double,entity:string,recognizer:string>>"
ARROW_FINDINGS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("entity", pa.string()), ("recognizer", pa.string())]))


def _columns(findings: list[list[Finding]]) -> pa.Array:
    offsets = [0]
    for f in findings:
        offsets.append(offsets[-1] + len(f))
    flat = [x for f in findings for x in f]
    parts = list(zip(*flat)) if flat else [()] * 5
    struct = pa.StructArray.from_arrays([pa.array(p, t.type) for p, t in zip(parts, ARROW_FINDINGS.value_type)], fields=list(ARROW_FINDINGS.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, type=ARROW_FINDINGS)


def analyze(df: DataFrame, text: str = "text", language: str | None = None, config: AnalysisConfig | None = None, registry: Registry | None = None, findings: str = "findings") -> DataFrame:
    """df, all columns kept, with `findings`. language: the column that holds it, if any."""
    bounded_batches(df.sparkSession)
    config = config or AnalysisConfig()
    recognizers = (registry or Registry()).snapshot()
    wanted = {e.upper() for e in config.entities}
    recognizers = [r for r in recognizers if not (config.no_models and r.model) and (not wanted or wanted & set(r.entities))]
    if language is None:
        recognizers = [r for r in recognizers if r.speaks(config.language or "en")]
    schema = T.StructType([*df.schema.fields, T.StructField(findings, T.ArrayType(FINDING))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(recognizers, config)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            langs = b.column(b.schema.get_field_index(language)).to_pylist() if language else [None] * b.num_rows
            out = engine.analyze_batch(texts, langs)
            yield pa.RecordBatch.from_arrays([*b.columns, _columns(out)], names=[*b.schema.names, findings])

    return df.mapInArrow(run, schema)


def exploded(df: DataFrame, keys: list[str], text: str = "text", findings: str = "findings") -> DataFrame:
    """One row per finding: keys, start, end, score, entity, recognizer, surface."""
    x = df.select(*keys, text, F.explode(findings).alias("f"))
    return x.select(*keys, "f.*", F.substring(F.col(text), (F.col("f.start") + 1).cast("int"), (F.col("f.end") - F.col("f.start")).cast("int")).alias("surface"))


def above(findings: Column, threshold: float) -> Column:
    """The threshold as a higher-order filter, for findings that are already there."""
    return F.filter(findings, lambda f: f["score"] >= threshold) if threshold > 0 else findings
