"""Recognizers and the registry that selects them when a plan is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..functions.dialect import python

#: start, end, score, entity, recognizer
Finding = tuple[int, int, float, str, str]


@dataclass(frozen=True)
class Recognizer:
    """What finds one kind of entity.

    patterns: (RE2 text, score) or (text, score, entity). needs: a cheap expression without which nothing can match.
    check: a predicate over the normalised surface; a pass scores 1.0 (or the pattern's score with keep_score), a failure
    is dropped unless keep_failed names a score. gate: keywords must stand within so many code points. group: the group
    that is the span. unique: one finding per span, of the best pattern. procedure or fn: what patterns can't say.
    """

    name: str
    entities: tuple[str, ...]
    languages: tuple[str, ...] = ("*",)
    patterns: tuple = ()
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    needs: str | None = None
    check: Callable[[str], bool] | None = None
    normalize: Callable[[str], str] | None = None
    keep_failed: float | None = None
    keep_score: bool = False
    gate: int = 0
    gate_underscore: bool = False
    group: int = 0
    unique: bool = False
    no_structural: bool = False
    model: bool = False
    procedure: str | None = None
    fn: Callable[[str], Iterable[tuple[int, int, float, str]]] | None = None

    def speaks(self, language: str) -> bool:
        return "*" in self.languages or language in self.languages


class Registry:
    """Recognizers in the order of registration, which also breaks ties between their findings."""

    def __init__(self, recognizers: Iterable[Recognizer] | None = None):
        if recognizers is None:
            from .patterns import DEFAULT as recognizers
        self._all = list(recognizers)

    def add(self, r: Recognizer) -> Registry:
        self._all.append(r)
        return self

    def remove(self, name: str) -> Registry:
        self._all = [r for r in self._all if r.name != name]
        return self

    def by_entity(self, entity: str) -> list[Recognizer]:
        return [r for r in self._all if entity in r.entities]

    def snapshot(self) -> list[Recognizer]:
        return list(self._all)

    def select(self, language: str, entities: Iterable[str] = (), no_models: bool = False) -> list[Recognizer]:
        """Those that speak the language; with `entities`, those that support one of them. This filters recognizers, not
        findings: a recognizer of two entities still emits both."""
        wanted = {e.upper() for e in entities}
        return [r for r in self._all if r.speaks(language) and not (no_models and r.model) and (not wanted or wanted & set(r.entities))]


def deny_list(terms: Iterable[str], entity: str = "CUSTOM", name: str = "DenyListRecognizer") -> Recognizer:
    """Literal terms, any case; word boundaries only at ends that are word characters; repeated terms count once."""
    import re

    seen, out = set(), []
    for t in (t.strip() for t in terms):
        if t and t.lower() not in seen:
            seen.add(t.lower())
            word = lambda c: c.isascii() and (c.isalnum() or c == "_")
            out.append(((r"\b" if word(t[0]) else "") + re.escape(t) + (r"\b" if word(t[-1]) else ""), 1.0))
    return Recognizer(name, (entity,), ("*",), tuple((f"(?i){p}", s) for p, s in out), unique=True)


def compiled(r: Recognizer) -> list[tuple[object, float, str]]:
    return [(python(p[0]), p[1], p[2] if len(p) > 2 else r.entities[0]) for p in r.patterns]
