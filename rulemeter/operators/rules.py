"""The scoring rules over one item: its stem and its options, never its key.

What a text says is worked out once for each distinct text that a task meets, within a bound; rules compare those parts. Texts
are read as rulemeter.functions.text reads them, with the word boundaries of Java's patterns (any letter or digit is in a word)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from math import inf, isnan
from typing import NamedTuple

from ..functions import text as T

#: Distinct texts that a task remembers.
REMEMBERED = 50_000
_NUMBER, _LEADING = re.compile(T.NUMBER_TOKEN, re.ASCII), re.compile(T.LEADING_NUMBER, re.ASCII)
_ABSOLUTE, _HEDGE = re.compile(T.ABSOLUTE, re.ASCII), re.compile(T.HEDGE, re.ASCII)
_WANTS_AN, _WANTS_A = (re.compile(rf"(?i)\b{a}(\s+_+)?\s*$", re.ASCII) for a in ("an", "a"))
_WORD = re.compile("[a-z0-9]+")
_VOWELS, _CONSONANTS = frozenset("aeiouAEIOU"), frozenset(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in "aeiouAEIOU")


class Option(NamedTuple):
    """An option's letter and what its text says: words, leading number, what it can share with others."""

    letter: str | None
    text: str
    tokens: tuple[str, ...]
    value: float | None
    absolute: bool
    hedges: int
    elements: frozenset[str]
    first: str


class Stem(NamedTuple):
    tokens: frozenset[str]
    numbers: tuple[str, ...]
    wants_an: bool
    wants_a: bool


def _plain(text: str) -> str:
    """The text for patterns with word boundaries: other letters and digits, and marks on them, are 0, other signs a control character."""
    if text.isascii():
        return text
    out, word = [], False
    for at, c in enumerate(text):
        if unicodedata.category(c) != "Mn":  # a mark goes with what it stands on
            word = c.isascii() and c.isalnum() or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")
        out.append(c if c.isascii() else "0" if word else "\n" if at == len(text) - 1 and c in "\x85\u2028\u2029" else "\x01")
    return "".join(out)


def _words(text: str, least: int) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if len(w) >= least]


def option_parts(text: str | None) -> tuple:
    text = text or ""
    bare, tokens, plain = text.strip(" "), tuple(_words(text, 2)), _plain(text)
    found = _LEADING.match(bare)
    value = float(found[1]) if found else None
    more = () if value is None else (f"num:{value!r}", "digits:" + re.sub("[^0-9-]", "", bare))
    return text, tokens, value, bool(_ABSOLUTE.search(plain)), len(_HEDGE.findall(plain)), frozenset((*tokens, *more)), bare[:1]


def stem_parts(text: str | None) -> Stem:
    text = text or ""
    bare = _plain(text.strip(" "))
    return Stem(frozenset(_words(text, 4)), tuple(_NUMBER.findall(text)), bool(_WANTS_AN.search(bare)), bool(_WANTS_A.search(bare)))


def remembered(parts: Callable) -> Callable:
    """``parts`` with what it gave for the last texts, up to REMEMBERED of them."""
    told: dict = {}

    def get(text: str | None):
        if (got := told.get(text)) is None:
            if len(told) >= REMEMBERED:
                told.clear()
            got = told[text] = parts(text)
        return got

    return get


def _first_best(o: list[Option], scores: list) -> str | None:
    return o[scores.index(max(scores))].letter if o else None


def _only_best(o: list[Option], scores: list[int]) -> str | None:
    best = max(scores, default=0)
    return o[scores.index(best)].letter if best > 0 and scores.count(best) == 1 else None


def _only(o: list[Option]) -> str | None:
    return o[0].letter if len(o) == 1 else None


def _overlap(s: Stem, o: list[Option]) -> str | None:
    scores = [sum(w in s.tokens for w in x.tokens) for x in o] if s.tokens else []
    return _first_best(o, scores) if max(scores, default=0) > 0 else None


def _repeating(s: Stem, o: list[Option]) -> str | None:
    return next((x.letter for x in o if any(k in x.text for k in s.numbers)), None)


def _absolute(s: Stem, o: list[Option]) -> str | None:
    without = [x for x in o if not x.absolute]
    return _only(without) if len(without) < len(o) else None


def _middle(s: Stem, o: list[Option]) -> str | None:
    held = [x for x in o if x.value is not None]
    if len(held) < 3:
        return None
    middle = sorted(x.value for x in held)[(len(held) - 1) // 2]
    return next(x.letter for x in held if x.value == middle)


def _position(s: Stem, o: list[Option]) -> str | None:
    return None if not o else "C" if any(x.letter == "C" for x in o) else o[(len(o) - 1) // 2].letter


def _convergence(s: Stem, o: list[Option]) -> str | None:
    scores = [0] * len(o)
    for i, x in enumerate(o):
        for j in range(i):
            y = o[j]
            if x.letter is not None and y.letter is not None and x.letter != y.letter:
                n = len(x.elements & y.elements)
                scores[i] += n
                scores[j] += n
    return _only_best(o, scores)


def _grammar(s: Stem, o: list[Option]) -> str | None:
    if len(o) < 2 or not (s.wants_an or s.wants_a):
        return None
    return _only([x for x in o if (s.wants_an and x.first in _VOWELS) or (s.wants_a and x.first in _CONSONANTS)])


def _mean(s: Stem, o: list[Option]) -> str | None:
    held, total = [x for x in o if x.value is not None], 0.0
    if len(held) < 3:
        return None
    for x in held:
        total += x.value
    away = [abs(x.value - (total - x.value) / (len(held) - 1)) for x in held]
    near = [-inf if isnan(d) else d for d in away]  # in Spark's order what is no number is the largest, of -d
    return _only([x for x, d in zip(held, near, strict=True) if d == min(near)])


#: Rules by name: from stem and options to a letter, or None where the rule does not apply.
RULES: dict[str, Callable[[Stem, list[Option]], str | None]] = {
    "longest-option": lambda s, o: _first_best(o, [len(x.text) for x in o]),
    "stem-option-overlap": _overlap,
    "option-repeating-stem-numbers": _repeating,
    "avoid-absolute-terms": _absolute,
    "middle-value-option": _middle,
    "position-c": _position,
    "most-qualified-hedged-option": lambda s, o: _only_best(o, [x.hedges for x in o]),
    "convergence-option": _convergence,
    "grammatical-fit-option": _grammar,
    "mean-of-other-options": _mean,
}
