"""Linear equations of a stem, put back into the options: one variable or two, as Columns.

Equations are found by one pattern, their sides are cut into terms, and terms are summed to coefficients; an option is a
number or an ordered pair. Sides that are not sums of numbers and multiples of single letters are no equations here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import once

# fixed values: what equations and options look like
MINUS = "−–—‐‑‒­"
RELATION = r"<=|>=|==|!=|≤|≥|≠|<|>|="
STRICT_NUMBER = r"-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+)?"
PAREN_PAIR = rf"^\(\s*({STRICT_NUMBER})\s*,\s*({STRICT_NUMBER})\s*\)$"
XY_PAIR = rf"(?i)^x\s*=\s*({STRICT_NUMBER})\s*,\s*y\s*=\s*({STRICT_NUMBER})$"
# end of fixed values
_TERM = r"(?:[0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+)?(?:\s*\*?\s*[A-Za-z])?|[A-Za-z])(?![A-Za-z0-9^(]|\.[0-9])"
_SIDE = rf"-?\s*{_TERM}(?:\s*[-+]\s*{_TERM})*+"
#: No operator before, none after: otherwise a part of a longer expression would pass for a side.
EQUATION = rf"(?<![-+*/^(]\s{{0,3}})(?<![A-Za-z0-9.,])({_SIDE})\s*({RELATION})\s*({_SIDE})(?!\s*[-+*/^(])"


def _plain(s: Column) -> Column:
    s = F.translate(F.coalesce(s, F.lit("")), MINUS, "-" * len(MINUS))
    return F.replace(F.replace(F.replace(s, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">=")), F.lit("≠"), F.lit("!="))


def _ratio(s: Column) -> Column:
    """A number or a/b; null if it is neither, or b is 0."""
    parts = F.transform(F.split(s, "/"), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def _terms(side: Column, turn: float) -> Column:
    """(variable, coefficient) of each term, the variable empty for a number; ``turn`` is -1 for a right side."""
    whole = F.regexp_extract_all(F.concat(F.lit("+"), F.regexp_replace(side, r"\s+", "")), F.lit(r"[-+]+[^-+]+"), F.lit(0))

    def one(t: Column) -> Column:
        sign = F.when(F.regexp_count(t, F.lit("-")) % 2 == 1, -turn).otherwise(turn)
        size = F.regexp_replace(t, r"[-+*A-Za-z]", "")
        return F.struct(F.lower(F.regexp_extract(t, "[A-Za-z]$", 0)).alias("v"), (sign * F.when(size == "", 1.0).otherwise(_ratio(size))).alias("c"))

    return F.transform(whole, one)


def equations(stem: Column) -> Column:
    """Array of (text, rel, terms), each equation once: the terms' sum stands in the relation to 0. One or two variables each."""
    plain = F.regexp_replace(_plain(stem), r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    texts = F.array_distinct(F.regexp_extract_all(plain, F.lit(EQUATION), F.lit(0)))

    def one(t: Column) -> Column:
        part = lambda g: F.regexp_extract(t, EQUATION, g)
        rel = F.when(part(2) == "==", "=").otherwise(part(2))
        return F.struct(t.alias("text"), rel.alias("rel"), F.concat(_terms(part(1), 1.0), _terms(part(3), -1.0)).alias("terms"))

    named = lambda e: F.array_distinct(F.filter(F.transform(e["terms"], lambda x: x["v"]), lambda v: v != ""))
    whole = F.filter(F.transform(texts, one), lambda e: F.forall(e["terms"], lambda x: x["c"].isNotNull()))
    return F.filter(F.transform(whole, lambda e: e.withField("vars", F.array_sort(named(e)))), lambda e: F.size(e["vars"]).between(1, 2) & e["text"].rlike("[0-9]"))


def strict_option(text: Column) -> Column:
    """(x, y) of an option that is nothing but a number, a letter = number (y null), or an ordered pair; x is null for others."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.replace(_plain(text), F.lit("$"), F.lit("")), r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", ""), r"\s+", " "))
    pair = lambda pattern, g: _ratio(F.nullif(F.regexp_extract(s, pattern, g), F.lit("")))
    alone = F.regexp_replace(s, r"^[A-Za-z]\s*=\s*", "")
    x = F.coalesce(pair(PAREN_PAIR, 1), pair(XY_PAIR, 1), F.when(alone.rlike(rf"^{STRICT_NUMBER}$"), _ratio(alone)))
    return F.struct(x.alias("x"), F.coalesce(pair(PAREN_PAIR, 2), pair(XY_PAIR, 2)).alias("y"))


def _holds(e: Column, names: Column, x: Column, y: Column) -> Column:
    """Whether an equation holds at names = (x, y), within the tolerance of numbers."""
    at = lambda v: F.when(v == "", 1.0).when(v == F.get(names, F.lit(0)), x).when(v == F.get(names, F.lit(1)), y)
    side = lambda on: F.aggregate(F.filter(e["terms"], on), F.lit(0.0), lambda s, t: s + t["c"] * at(t["v"]))
    # variables against numbers: what is near depends on the sizes of the two sides
    left, right = side(lambda t: t["v"] != ""), -side(lambda t: t["v"] == "")
    near, rel = T.near(left, right), e["rel"]
    return F.when(rel == "=", near).when(rel == "!=", ~near).when(rel == "<", (left < right) & ~near).when(rel == ">", (left > right) & ~near).when(rel == "<=", (left < right) | near).when(rel == ">=", (left > right) | near)


def substitution(items: DataFrame) -> DataFrame:
    """(id, answer, kind, n_equations, hits, solution) of items (id, stem, options).

    With equations of one variable and options that are numbers, the first such equation decides; else the system of those of
    two variables (and of one, if these name two together) and options that are pairs. The answer is the only option that
    satisfies what decides; kind is scalar, pair or system, null where nothing could be put in. ``solution`` is (x, y) by
    elimination from the first two equations of a system, where they are equalities with one solution."""
    o = F.transform(F.coalesce("options", F.array().cast("array<struct<letter:string,text:string>>")), lambda x: F.struct(x["letter"].alias("letter"), strict_option(x["text"]).alias("p")))
    t = once(items.select("id", "stem", "options"), eqs=equations(F.col("stem")), o=o).select("id", "eqs", "o")
    one, two = F.filter("eqs", lambda e: F.size(e["vars"]) == 1), F.filter("eqs", lambda e: F.size(e["vars"]) == 2)
    scalars, pairs = F.filter("o", lambda x: x["p"]["x"].isNotNull() & x["p"]["y"].isNull()), F.filter("o", lambda x: x["p"]["y"].isNotNull())
    t = once(t, one=one, two=two, scalars=scalars, pairs=pairs)
    names = lambda es: F.array_sort(F.array_distinct(F.flatten(F.transform(es, lambda e: e["vars"]))))
    system = F.when((F.size("one") >= 2) & (F.size(names(F.col("one"))) == 2), F.concat("one", "two")).otherwise(F.col("two"))
    t = once(t, system=system)
    t = once(t, names=names(F.col("system")), first=F.get("one", F.lit(0)))
    scalar = (F.size("one") > 0) & (F.size("scalars") > 0)
    paired = (F.size("system") > 0) & (F.size("pairs") > 0) & (F.size("names") == 2)
    letters = lambda xs: F.transform(xs, lambda x: x["letter"])
    by_one = letters(F.filter("scalars", lambda x: _holds(F.col("first"), F.col("first")["vars"], x["p"]["x"], F.lit(None).cast("double"))))
    by_all = letters(F.filter("pairs", lambda x: F.forall("system", lambda e: _holds(e, F.col("names"), x["p"]["x"], x["p"]["y"]))))
    kind = F.when(scalar, "scalar").when(paired, F.when(F.size("system") >= 2, "system").otherwise("pair"))
    coefficient = lambda i, v: F.aggregate(F.filter(F.get("system", F.lit(i))["terms"], lambda x: x["v"] == v), F.lit(0.0), lambda s, x: s + x["c"])
    rows = [[coefficient(i, v) for v in (F.get("names", F.lit(0)), F.get("names", F.lit(1)), F.lit(""))] for i in (0, 1)]
    (a, b, c), (d, e, f) = rows
    det = a * e - b * d
    equal = lambda i: F.get("system", F.lit(i))["rel"] == "="
    solved = F.struct(F.try_divide(b * f - c * e, det).alias("x"), F.try_divide(c * d - a * f, det).alias("y"))
    t = once(t, hits=F.when(scalar, by_one).when(paired, by_all), kind=kind, solution=F.when((F.size("system") >= 2) & (F.size("names") == 2) & equal(0) & equal(1) & (F.abs(det) > 1e-12), solved))
    answer = F.when(F.size("hits") == 1, F.get("hits", F.lit(0)))
    return t.select("id", answer.alias("answer"), "kind", F.size("eqs").alias("n_equations"), "hits", "solution")
