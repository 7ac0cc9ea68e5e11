"""Back-substitution: which option alone satisfies the stem's equations. A small parser stands in for a computer algebra
system; text is never evaluated as code."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|(sqrt)|([A-Za-z])|(\*\*|[-+*/^()]))")
_SIDE = r"[-+*/^().0-9A-Za-z \t]+?"
_EQUATION = re.compile(rf"({_SIDE})\s*(<=|>=|≤|≥|=|<|>)\s*([-+*/^().0-9A-Za-z ]+)")


class _Parser:
    """sum := product (+- product)*; product := power (*/ power | juxtaposed)*; power := unary ^ power; unary := - unary | atom."""

    def __init__(self, s: str, names: dict[str, float]) -> None:
        self.items, at = [], 0
        s = s.strip()
        while at < len(s):
            m = _TOKEN.match(s, at)
            if not m:
                raise ValueError(s)
            self.items.append(m.groups())
            at = m.end()
        self.at, self.names = 0, names

    def peek(self) -> tuple:
        return self.items[self.at] if self.at < len(self.items) else (None,) * 4

    def take(self, ops: str) -> str | None:
        op = self.peek()[3]
        if op and op in ops.split():
            self.at += 1
            return op
        return None

    def sum(self) -> float:
        v = self.product()
        while op := self.take("+ -"):
            w = self.product()
            v = v + w if op == "+" else v - w
        return v

    def product(self) -> float:
        v = self.power()
        while True:
            op = self.take("* /")
            number, root, name, sign = self.peek()
            if not op and not (number or root or name or sign == "("):
                return v
            w = self.power()
            v = v / w if op == "/" else v * w

    def power(self) -> float:
        if self.take("-"):
            return -self.power()
        v = self.atom()
        if self.take("^ **"):
            e = self.power()
            if abs(e) > 20:
                raise ValueError("exponent")
            v = v**e
        return v

    def atom(self) -> float:
        number, root, name, sign = self.peek()
        self.at += 1
        if number:
            return float(number)
        if root:
            return math.sqrt(self.atom())
        if name:
            return self.names[name]
        if sign == "(":
            v = self.sum()
            if not self.take(")"):
                raise ValueError("bracket")
            return v
        raise ValueError("end")


def value(s: str, names: dict[str, float]) -> float | None:
    """The value of an expression with single-letter names, or null if it is none."""
    try:
        p = _Parser(s, names)
        v = p.sum()
        return float(v) if p.at == len(p.items) and not isinstance(v, complex) and math.isfinite(v) else None
    except (ValueError, KeyError, ZeroDivisionError, OverflowError):
        return None


def equations(stem: str) -> list[tuple[str, str, str, str]]:
    """(left, relation, right, variable) of relations with one letter standing alone and a digit."""
    out = []
    for m in _EQUATION.finditer(stem):
        sides = []
        for side, keep_end in ((m[1], True), (m[3], False)):
            words = re.split(r"\b(?:[A-Za-z]{2,})\b", re.sub(r"\bsqrt\b", "√", side))
            sides.append((words[-1] if keep_end else words[0]).replace("√", "sqrt").strip(" ."))
        letters = set(re.findall(r"(?<![A-Za-z])[A-Za-z](?![A-Za-z])", " ".join(sides)))
        if len(letters) == 1 and all(sides) and re.search(r"\d", "".join(sides)):
            out.append((sides[0], m[2], sides[1], letters.pop()))
    return list(dict.fromkeys(out))


def satisfies(equation: tuple[str, str, str, str], x: float) -> bool | None:
    left, rel, right, name = equation
    a, b = value(left, {name: x}), value(right, {name: x})
    if a is None or b is None:
        return None
    close = abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return {"=": close, "<": a < b and not close, ">": a > b and not close}.get(rel, (a <= b if rel in ("<=", "≤") else a >= b) or close)


def back_substitution(items: DataFrame) -> DataFrame:
    """(id, answer, n_equations): the only option whose number satisfies every equation of the stem; else null."""
    o = F.transform("options", lambda x: F.struct(x["letter"].alias("letter"), T.option_number(F.regexp_replace(x["text"], r"^\s*[A-Za-z]\s*=\s*", "")).alias("v")))

    @F.pandas_udf("answer string, n_equations int")
    def run(stems: pd.Series, options: pd.Series) -> pd.DataFrame:
        out = []
        for stem, opts in zip(stems, options, strict=True):
            found = equations(stem or "")
            hits = [x["letter"] for x in (opts if opts is not None else []) if x["v"] is not None and found and all(satisfies(e, x["v"]) for e in found)]
            out.append((hits[0] if len(hits) == 1 else None, len(found)))
        return pd.DataFrame(out, columns=["answer", "n_equations"])

    return items.select("id", run(F.coalesce("stem", F.lit("")), o).alias("r")).select("id", "r.*")
