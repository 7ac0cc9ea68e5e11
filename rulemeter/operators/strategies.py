"""Option-structure strategies: numeric transforms between options, arithmetic closure of the stem's numbers."""

from __future__ import annotations

import math
import re
from itertools import chain, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import once

#: Values that the closure makes at most, in order of depth; the bound is part of the rule.
MOST_VALUES = 4000
#: Values by which a count of rounded values may be off.
SPARE = 64
# fixed values: words of stems of which pi and halved products belong to the closure
GEOMETRY = re.compile(
    r"\b(triangle|circle|radius|diameter|circumference|rectangle|square|trapezoid|parallelogram|prism|cylinder|sphere|hypotenuse|base|height|width|length|perimeter|area|volume)\b", re.I
)
# end of fixed values


def slips(v: Column, text: Column) -> Column:
    """The fifteen values that a slip makes of a number ``v`` written as ``text``: doubled, halved, a place up or down, one more or
    less, negated, inverted, squared, rooted, two neighbouring digits swapped, a last zero dropped or added, ten percent more or
    less in the decimals it was written with."""
    body = F.regexp_replace(text, "^-", "")
    digits = F.when(body.rlike(r"^[0-9]*\.?[0-9]*$"), F.replace(body, F.lit("."), F.lit("")))
    sign, n = F.when(text.startswith("-"), -1.0).otherwise(1.0), F.length(digits)
    unit, written = F.pow(F.lit(10.0), F.length(F.regexp_extract(body, r"^[0-9]*\.([0-9]*)$", 1))), F.pow(F.lit(10.0), F.length(F.regexp_extract(text, r"\.([0-9]+)", 1)))
    swapped = lambda j: F.concat(F.substring(digits, F.lit(1), j - 1), F.substring(digits, j + 1, F.lit(1)), F.substring(digits, j, F.lit(1)), F.substring(digits, j + 2, n)).try_cast("double")
    swaps = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda j: sign * swapped(j) / unit)).otherwise(F.array().cast("array<double>"))
    shorter = F.when((F.abs(v - F.rint(v)) < 1e-9) & (F.abs(F.rint(v)) >= 10) & (F.rint(v) % 10 == 0), F.rint(v) / 10)
    trimmed = F.when(body.endswith("0") & (F.length(F.regexp_replace(body, "[^0-9]", "")) >= 2), sign * F.regexp_replace(body, r"0$", "").try_cast("double"))
    plain = F.array(v * 2, v / 2, v * 10, v / 10, v + 1, v - 1, -v, F.when(v != 0, 1 / v), v * v, F.when(v >= 0, F.sqrt(v)), shorter, trimmed, F.rint(v * 1.1 * written) / written, F.rint(v * 0.9 * written) / written)
    return F.filter(F.concat(plain, swaps), lambda x: F.abs(x) <= 1e12)


def _numeric_options(items: DataFrame) -> DataFrame:
    """(id, o): the options that are numbers, as (letter, v, reached), the values that slips make of each worked out once."""
    o = F.transform("options", lambda x: F.struct(x["letter"].alias("letter"), T.clean_number(x["text"]).alias("text")))
    o = F.filter(F.transform(o, lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"), T.option_number(x["text"]).alias("v"))), lambda x: x["v"].isNotNull())
    once = items.select("id", F.explode(F.array(F.struct(o.alias("o")))).alias("s")).select("id", F.col("s.o").alias("o"))
    made = F.transform("o", lambda x: F.struct(x["letter"].alias("letter"), x["v"].alias("v"), slips(x["v"], x["text"]).alias("reached")))
    return once.select("id", F.explode(F.array(F.struct(made.alias("o")))).alias("s")).select("id", F.col("s.o").alias("o"))


def _degrees(held: DataFrame) -> DataFrame:
    """(id, o): numeric options as (letter, v, out_degree)."""
    degree = lambda x: F.size(F.filter("o", lambda y: (y["letter"] != x["letter"]) & F.exists(x["reached"], lambda t: T.near(t, y["v"]))))
    e = F.transform("o", lambda x: F.struct(x["letter"].alias("letter"), x["v"].alias("v"), degree(x).alias("out_degree")))
    return held.select("id", F.explode(F.array(F.struct(e.alias("o")))).alias("s")).select("id", F.col("s.o").alias("o"))


def transform_edges(items: DataFrame) -> DataFrame:
    """(id, letter, out_degree): how many other options a slip turns the option into."""
    return _degrees(_numeric_options(items)).select("id", F.explode("o").alias("e")).select("id", "e.letter", "e.out_degree")


def lower_central(options: Column) -> Column:
    """Of (letter, v) options that are all numbers, the first letter that has the lower central value; null if there are none."""
    pairs = F.array_sort(F.transform(options, lambda x: F.struct(x["v"].alias("v"), x["letter"].alias("letter"))))
    # the pairs stand in one lambda's argument, so that they are sorted once
    first = lambda p: F.get(F.filter(p, lambda x: x["v"] == F.get(p, F.floor((F.size(p) - 1) / 2).cast("int"))["v"]), F.lit(0))["letter"]
    return F.get(F.transform(F.array(pairs), first), F.lit(0))


def hub(items: DataFrame, least: int = 3) -> DataFrame:
    """(id, answer, tied) of items with ``least`` numeric options: the option with the most edges, the lower central one by value
    where several have them, null where there is no edge. ``tied`` are those options' letters, in order."""
    t = once(_degrees(_numeric_options(items)).filter(F.size("o") >= least), top=F.array_max(F.transform("o", lambda x: x["out_degree"])))
    t = once(t, best=F.filter("o", lambda x: (x["out_degree"] == F.col("top")) & (F.col("top") > 0)))
    return once(t, answer=lower_central(F.col("best")), tied=F.array_sort(F.transform("best", lambda x: x["letter"]))).select("id", "answer", "tied")


def closure(numbers: list[float], depth: int = 2, most: int = MOST_VALUES, geometry: bool = False) -> dict[float, int]:
    """Values that + - * / make of the numbers, each used as often as one likes, with the least depth, in order of making.

    The first step also takes roots and, with ``geometry``, multiples of pi and halves of products."""
    found = {round(x, 8): 0 for x in numbers}
    for d in range(1, depth + 1):
        have = list(found)
        made = (v for a, b in product(have, have) for v in (a + b, a - b, a * b, a / b if abs(b) > 1e-12 else None))
        if d == 1:
            made = chain(made, (x**0.5 for x in have if x >= 0))
            if geometry:
                made = chain(made, (x * math.pi for x in have), (a * b / 2 for a, b in product(have, have)))
        for v in made:
            if v is not None and abs(v) <= 1e12 and (r := round(v, 8)) not in found:
                if len(found) >= most:
                    return found
                found[r] = d
    return found


def depths(numbers: list[float], asked: list[float], depth: int = 2, most: int = MOST_VALUES, geometry: bool = False) -> dict[float, int]:
    """Of the values ``asked``, rounded to 8 digits, those that closure() holds, with their depth.

    Where its last step can't reach the bound, the order of making doesn't matter: that step is then not made, but looked up
    among all sums, differences, products and quotients, and only values beside an asked one are rounded."""
    if depth < 2:
        have = closure(numbers, depth, most, geometry)
        return {x: have[x] for x in asked if x in have}
    have = closure(numbers, depth - 1, most, geometry)
    v = np.fromiter(have, float, len(have))
    made = np.empty(0)
    if len(have) ** 2 <= most:  # beyond that the differences alone may reach the bound
        with np.errstate(over="ignore", invalid="ignore"):
            made = np.concatenate([np.add.outer(v, v), np.subtract.outer(v, v), np.multiply.outer(v, v), np.divide.outer(v, v[np.abs(v) > 1e-12])], axis=1).ravel()
        made = made[np.abs(made) <= 1e12]
    # doubles from 9e7 on have no ninth digit; SPARE is for what numpy rounds otherwise
    many = len(have) + (len(made) if len(have) + len(made) <= most else len(np.unique(np.where(np.abs(made) < 9e7, np.round(made, 8), made))) + SPARE)
    if len(have) ** 2 > most or many > most:
        have = closure(numbers, depth, most, geometry)
        return {x: have[x] for x in asked if x in have}
    out = {x: have[x] for x in asked if x in have}
    want = np.array(sorted({x for x in asked if x not in have and abs(x) <= 1e12 + 1}))
    if len(want) and len(made):
        after = np.searchsorted(want, made)
        close = np.zeros(len(made), bool)
        for at in (np.maximum(after - 1, 0), np.minimum(after, len(want) - 1)):
            close |= np.abs(made - want[at]) <= 1e-8 + 1e-15 * np.abs(want[at])
        asked_for = set(want.tolist())
        out |= {r: depth for x in made[close].tolist() if (r := round(x, 8)) in asked_for}
    return out


def closure_answers(items: DataFrame, depth: int = 2) -> DataFrame:
    """(id, answer, depth, tied): the option that the closure of all the stem's numbers reaches at the least depth; of several
    (tied, in order) the lower central one by value, the first letter where values are equal.

    The bound on values depends on their order, so this is no join; it runs in Arrow batches, item by item."""
    o = F.transform("options", lambda x: F.struct(x["letter"].alias("letter"), T.option_number(x["text"]).alias("v")))

    @F.pandas_udf("answer string, depth int, tied array<string>")
    def run(stems: pd.Series, numbers: pd.Series, options: pd.Series) -> pd.DataFrame:
        out = []
        for stem, ns, opts in zip(stems, numbers, options, strict=True):
            asked = [(round(x["v"], 8), x["v"], x["letter"]) for x in (opts if opts is not None else []) if x["v"] is not None]
            have = depths([float(x) for x in (ns if ns is not None else []) if x == x], [a[0] for a in asked], depth, geometry=bool(GEOMETRY.search(stem or "")))
            hits = [(have[r], v, letter) for r, v, letter in asked if r in have]
            least = min((h[0] for h in hits), default=None)
            tied = sorted(h[1:] for h in hits if h[0] == least)
            middle = tied[(len(tied) - 1) // 2][0] if tied else None
            out.append((next((letter for v, letter in tied if v == middle), None), least, sorted(letter for _, letter in tied)))
        return pd.DataFrame(out, columns=["answer", "depth", "tied"])

    # not deterministic, so that a filter over the answer doesn't work it out a second time
    return items.select("id", run.asNondeterministic()(F.col("stem"), T.numbers(F.col("stem")), o).alias("r")).select("id", "r.*")


def portfolio(items: DataFrame, branches: list[tuple[str, DataFrame]], fallback: str = "B") -> DataFrame:
    """(id, answer, branch): the first branch that answers; ``fallback`` where none does."""
    out = items.select("id")
    for name, told in branches:
        out = out.join(told.select("id", F.col("answer").alias(name)), "id", "left")
    names = [n for n, _ in branches]
    branch = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names], F.lit("fallback"))
    return out.select("id", F.coalesce(*names, F.lit(fallback)).alias("answer"), branch.alias("branch"))
