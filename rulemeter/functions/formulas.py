"""Rules that compute a number from the stem, and match it to an option, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: words and forms of a stem that a rule goes by
FRACTION = r"(-?[0-9]+)\s*/\s*(-?[0-9]+)"
PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
DOWN = r"\b(decrease|markdown|discount|less|off)\b"
UP = r"\b(increase|markup|tax|tip|interest|more|raise)\b"
COEFFICIENT = r"(-?[0-9]+(?:\.[0-9]+)?)\s*[·*]?\s*[xX]\b"
AREA = r"\b(area|rectangle|square|parallelogram)\b"
SQUARE = r"\bsquare\b"
VOLUME = r"\b(volume|cubic|box|prism)\b"
MEAN = r"\b(mean|average)\b"
# end of fixed values


def _num(stem: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(stem, pattern, group), F.lit("")).try_cast("double")


def values(stem: Column) -> dict[str, Column]:
    """The value of each formula rule as an array of candidates in order, or null where the rule doesn't apply."""
    s, low = F.coalesce(stem, F.lit("")), F.lower(F.coalesce(stem, F.lit("")))
    n = T.numbers(s)
    at = lambda a, i: F.get(a, F.lit(i))
    tops, bottoms = (F.transform(F.regexp_extract_all(s, F.lit(FRACTION), F.lit(g)), lambda x: x.try_cast("double")) for g in (1, 2))
    p = _num(s, PERCENT)
    other = at(F.filter(n, lambda x: x != p), 0)
    down, up = low.rlike(DOWN), low.rlike(UP)
    whole = F.filter(n, lambda x: x != 0)
    listed = F.filter(n, lambda x: x <= 1000)
    k = F.try_divide(at(n, 1), at(n, 0))
    one = lambda v: F.when(v.isNotNull(), F.array(v))
    return {
        "invert-and-multiply": one(F.when((F.size(tops) >= 2) & (at(tops, 1) != 0), F.try_divide(at(tops, 0), at(bottoms, 0)) * F.try_divide(at(bottoms, 1), at(tops, 1)))),
        "coefficient-adjacent-to-x": one(_num(s, COEFFICIENT)),
        "percent-of": one(p / 100 * other),
        "percent-change": one(F.when(down, other * (1 - p / 100)).when(up, other * (1 + p / 100))),
        "unit-rate": F.when(F.size(whole) >= 2, F.array(F.try_divide(at(whole, 0), at(whole, 1)), F.try_divide(at(whole, 1), at(whole, 0)))),
        "y-equals-kx": one(F.when(F.size(n) >= 3, k * at(n, 2)).otherwise(k)),
        "area-lw": one(F.when(low.rlike(AREA), F.when(low.rlike(SQUARE), at(n, 0) * at(n, 0)).otherwise(at(n, 0) * at(n, 1)))),
        "volume-lwh": one(F.when(low.rlike(VOLUME), at(n, 0) * at(n, 1) * at(n, 2))),
        "mean-of-listed-numbers": one(F.when(low.rlike(MEAN) & (F.size(listed) >= 2), F.aggregate(listed, F.lit(0.0), lambda a, x: a + x) / F.size(listed))),
    }


def matched(candidates: Column, options: Column) -> Column:
    """Letter of the first option that a candidate is near to, candidates in their order; null if there is none."""
    number = lambda t: F.coalesce(T.leading_number(t), T.fraction(t))
    hits = F.transform(candidates, lambda v: F.get(F.filter(options, lambda o: T.near(number(o["text"]), v)), F.lit(0))["letter"])
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))


def answers(stem: Column, options: Column) -> dict[str, Column]:
    return {name: matched(v, options) for name, v in values(stem).items()}
