"""One pattern text, three engines.

Patterns are written in the RE2 dialect: ASCII \\b \\d \\w \\s, leftmost-first alternation. `python()` compiles them for Arrow
passes, `java()` rewrites them for Catalyst's regular expressions, and the text itself is what DuckDB (RE2) runs as the
oracle. Offsets everywhere are code points, half-open.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants, _parser

import regex

WORD = "0-9A-Za-z_"
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_SPACE = r"\t\n\f\r "
_CLASSES = {"d": "0-9", "w": WORD, "s": _SPACE}


def explicit(pattern: str, end: str = r"\Z") -> str:
    """The pattern with \\b \\d \\w \\s spelt out and $ as the end of the text, so that no engine reads them its own way."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n in _CLASSES:
                out.append(_CLASSES[n] if inside else f"[{_CLASSES[n]}]")
            elif n == "b" and not inside:
                out.append(_BOUNDARY)
            elif n == "p" and pattern[i + 2] == "{":
                close = pattern.index("}", i)
                out.append(pattern[i : close + 1])
                i = close + 1
                continue
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and pattern[i - 1] != "[":
            inside = False
        out.append(end if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def _key(c: int) -> str:
    """The same for characters that differ in case alone, by any engine's rules."""
    up = chr(c).upper()
    low = (up if len(up) == 1 else chr(c)).lower()
    return "i" if c in (0x130, 0x131) else low if len(low) == 1 else chr(c)


@lru_cache(maxsize=None)
def _alike() -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for c in range(0x10000):
        found.setdefault(_key(c), []).append(c)
    return found


def _first(tokens, fold: bool) -> tuple[set[int], bool, bool] | None:
    """What a sequence of parsed tokens starts with: code points (supersets do), whether \\b always stands before them, and
    whether the sequence may be empty. None: unknown."""
    K, chars, edge, edges = _constants, set(), False, []
    for op, arg in tokens:
        name = str(op)
        if name == "AT":
            if arg is not K.AT_BOUNDARY:
                return None
            edge = True
            continue
        if name == "LITERAL":
            own, empty, sure = {arg}, False, False
        elif name == "IN":
            own, empty, sure = set(), False, False
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    own.add(x)
                elif str(kind) == "RANGE" and x[1] - x[0] < 1024:
                    own.update(range(x[0], x[1] + 1))
                elif kind is K.CATEGORY and x in (K.CATEGORY_DIGIT, K.CATEGORY_WORD, K.CATEGORY_SPACE):
                    own.update(c for c in range(128) if re.match({K.CATEGORY_DIGIT: r"\d", K.CATEGORY_WORD: r"\w", K.CATEGORY_SPACE: r"\s"}[x], chr(c), re.A))
                else:
                    return None
        elif name in ("SUBPATTERN", "MAX_REPEAT", "MIN_REPEAT", "BRANCH"):
            if name == "SUBPATTERN":
                inner = [_first(arg[3], (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)]
            elif name == "BRANCH":
                inner = [_first(x, fold) for x in arg[1]]
            else:
                inner = [_first(arg[2], fold)]
            if None in inner:
                return None
            own, empty = set().union(*(x[0] for x in inner)), any(x[2] for x in inner) or (name.endswith("REPEAT") and arg[0] == 0)
            sure = all(x[1] for x in inner)
        else:
            return None
        if fold:
            own = {c for x in own for c in _alike()[_key(x)]}
        chars |= own
        edges.append(edge or sure)
        if not empty:
            return chars, all(edges), False
    return chars, bool(edges) and all(edges), True


@lru_cache(maxsize=None)
def lead(pattern: str) -> tuple[str, bool, bool] | None:
    """(the class of what every match starts with, whether \\b stands before it, whether it holds word characters alone), or
    None where that can't be told. In front of a pattern, as a look-ahead, it spares engines that backtrack all alternatives
    at most places of a text."""
    try:
        tree = _parser.parse(pattern, re.ASCII)
    except re.error:
        return None
    found = _first(tree, bool(tree.state.flags & re.I))
    if found is None or found[2] or not found[0]:
        return None
    runs: list[list[int]] = []
    for c in sorted(found[0]):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    name = lambda c: chr(c) if c < 128 and chr(c).isalnum() or c > 0xA0 else f"\\x{c:02x}"
    words = {c for c in range(128) if chr(c).isalnum() or c == 0x5F}
    return "[" + "".join(name(a) if a == b else f"{name(a)}-{name(b)}" for a, b in runs) + "]", found[1], found[0] <= words


def _led(pattern: str, body: str, edge: str | None = None) -> str:
    """`body`, a translation of the pattern, behind a look-ahead for what the pattern starts with and its word boundary, if it
    starts with one (`edge`: how the engine writes that)."""
    found = lead(pattern)
    if found is None:
        return body
    flags = re.match(r"(?:\(\?[a-z]+\))?", body)[0]
    edge = edge or (f"(?<![{WORD}])" if found[2] else _BOUNDARY)
    rest = body[len(flags) :]
    return f"{flags}(?={found[0]}){edge if found[1] else ''}" + (f"(?:{rest})" if "|" in pattern else rest)


@lru_cache(maxsize=None)
def python(pattern: str):
    """Compiled for Python. \\p classes need the `regex` module. ASCII mode has fast boundaries, but folds ASCII letters
    alone, so case-insensitive patterns with other letters are spelt out."""
    if r"\p{" in pattern:
        return regex.compile(explicit(pattern), regex.V0)
    if "(?i" in pattern and not pattern.isascii():
        return re.compile(_led(pattern, explicit(pattern)))
    spaces = []
    inside = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            spaces.append((_SPACE if inside else f"[{_SPACE}]") if n == "s" else c + n)
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        spaces.append(r"\Z" if c == "$" and not inside else c)
        i += 1
    return re.compile(_led(pattern, "".join(spaces), r"\b"), re.ASCII)


@lru_cache(maxsize=None)
def java(pattern: str) -> str:
    """For Spark's functions: (?d) keeps other line ends from stopping a dot; folding is Unicode's where letters ask for it."""
    body = explicit(pattern, r"\z")
    if "(?i" in body and not body.isascii():
        body = body.replace("(?i", "(?iu")
    return "(?d)" + _led(pattern, body)
