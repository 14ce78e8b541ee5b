"""Model-backed recognition without a model: everything around the network.

Texts are cut into overlapping chunks, words are split, a scorer (any callable: the place of an ONNX session, made once per
worker) gives logits, spans are decoded, and findings of chunks are joined. No weights ship with this library.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import regex

from .registry import Recognizer

# Limits and thresholds.
CHUNK, OVERLAP, MOST_CHUNKS = 1200, 200, 64
THRESHOLD, THRESHOLDS = 0.40, {"PERSON": 0.22, "ORGANIZATION": 0.30, "AGE": 0.20, "ID": 0.30}
STRICT = {"PERSON": 0.50, "ORGANIZATION": 0.55, "LOCATION": 0.55, "NRP": 0.55}
TITLES = frozenset("mr mr. mrs mrs. ms ms. miss dr dr. prof prof. herr frau sir madam lord lady".split())
WORD = regex.compile(r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|\S")
#: label -> entity, by domain.
LABELS = {
    "chat": {"person": "PERSON", "organization": "ORGANIZATION", "location": "LOCATION", "address": "STREET_ADDRESS", "email": "EMAIL_ADDRESS", "phone number": "PHONE_NUMBER", "age": "AGE", "nationality": "NRP", "profession": "PROFESSION", "date": "DATE_TIME"},
    "clinical": {"patient": "PERSON", "doctor": "PERSON", "hospital": "ORGANIZATION", "city": "LOCATION", "age": "AGE", "profession": "PROFESSION", "date": "DATE_TIME", "medical record number": "ID"},
    "finance": {"person": "PERSON", "company": "ORGANIZATION", "bank": "ORGANIZATION", "location": "LOCATION", "account number": "ID"},
    "legal": {"person": "PERSON", "court": "ORGANIZATION", "law firm": "ORGANIZATION", "location": "LOCATION", "case number": "ID"},
}


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP, most: int | None = None) -> Iterator[tuple[int, str]]:
    """(start, piece): cut at the last line end within the piece, else the last blank; the whole text, or `most` pieces of it
    (MOST_CHUNKS where results must match engines with that limit)."""
    at, left = 0, most
    while left is None or left > 0:
        left = left and left - 1
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind("\n", at + overlap + 1, end), -1)
            if cut < 0:
                cut = text.rfind(" ", at + overlap + 1, end)
            end = cut if cut > at else end
        yield at, text[at:end]
        if end >= len(text):
            return
        at = max(at + 1, end - overlap)


def words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


@dataclass(frozen=True)
class Decoder:
    """Which spans of scores count."""

    labels: dict[str, str] = field(default_factory=lambda: LABELS["chat"])
    threshold: float = THRESHOLD
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))

    def least(self, entity: str) -> float:
        return self.thresholds.get(entity, self.threshold)


def decode_spans(logits: dict[tuple[int, int, str], float], spans: list[tuple[int, int]], d: Decoder) -> list[tuple[int, int, float, str]]:
    """Spans of words (first, last, label) with logits: those at their threshold, greedily by score, none overlapping; of
    persons with about the same score the wider one."""
    found = [(i, j, sigmoid(x), d.labels[label]) for (i, j, label), x in logits.items() if label in d.labels and sigmoid(x) >= d.least(d.labels[label])]
    found.sort(key=lambda c: (-(round(c[2], 2) if c[3] == "PERSON" else c[2]), -(c[1] - c[0]) if c[3] == "PERSON" else 0, c[0], c[1], c[3]))
    out: list[tuple[int, int, float, str]] = []
    for c in found:
        if all(c[1] < k[0] or c[0] > k[1] for k in out):
            out.append(c)
    return sorted((spans[i][0], spans[j][1], s, e) for i, j, s, e in out)


def decode_flat(tags: list[dict[str, tuple[float, float, float]]], spans: list[tuple[int, int]], text: str, d: Decoder) -> list[tuple[int, int, float, str]]:
    """Words with (start, end, inside) logits by label: a span opens where start passes, closes where end passes, and every
    word in it passes inside; its score is the least of them. Leading titles are trimmed from persons."""
    out = []
    for label, entity in d.labels.items():
        least = d.least(entity)
        for i in range(len(tags)):
            if sigmoid(tags[i].get(label, (-99,) * 3)[0]) < least:
                continue
            score = 1.0
            for j in range(i, len(tags)):
                s, e, inside = map(sigmoid, tags[j].get(label, (-99.0,) * 3))
                if inside < least:
                    break
                score = min(score, inside)
                if e >= least:
                    out.append((spans[i][0], spans[j][1], min(score, sigmoid(tags[i][label][0]), e), entity))
    best = dedupe(out)
    return [(trim_title(text, s, e), e, score, entity) if entity == "PERSON" else (s, e, score, entity) for s, e, score, entity in best]


def dedupe(found: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """Per entity: by score, none overlapping."""
    out: list[tuple[int, int, float, str]] = []
    for c in sorted(found, key=lambda c: (-c[2], c[0] - c[1], c[0])):
        if all(c[3] != k[3] or c[1] <= k[0] or c[0] >= k[1] for k in out):
            out.append(c)
    return sorted(out)


def trim_title(text: str, start: int, end: int) -> int:
    """Where a name begins after a leading title, if what is left looks like a name."""
    first, _, rest = text[start:end].partition(" ")
    rest = rest.lstrip()
    return end - len(rest) if first.lower() in TITLES and rest[:1].isupper() else start


def model_recognizer(name: str, load: Callable[[], Callable[[str], list[tuple[int, int, float, str]]]], entities: tuple[str, ...], languages: tuple[str, ...] = ("*",), most: int | None = None) -> Recognizer:
    """A recognizer over a scorer of one chunk, of which a text has `most` (None: all). `load` runs once per worker."""
    held: list = []

    def run(text: str) -> list[tuple[int, int, float, str]]:
        if not held:
            held.append(load())
        return dedupe([(at + s, at + e, score, entity) for at, piece in chunks(text, most=most) for s, e, score, entity in held[0](piece)])

    return Recognizer(name, entities, languages, fn=run, model=True)


def verify(recognizers: list[Recognizer], probe: str = "Anna Schmidt lives in Berlin.") -> None:
    """Runs each model-backed recognizer once; a backend that fails must stop the plan, not silently find nothing."""
    for r in recognizers:
        if r.model:
            list(r.fn(probe))
