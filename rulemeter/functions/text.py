"""Text and number functions as Columns. Patterns are ASCII, as in the scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists of the scoring rules
ABSOLUTE_WORDS = "always never all none only every impossible certainly".split()
HEDGE_WORDS = (
    "sometimes often usually generally typically seldom rarely occasionally frequently ordinarily perhaps possibly probably maybe approximately nearly roughly about around relatively somewhat "
    "mostly likely tends tend may might could few many some most"
).split()
NUMBER_TOKEN = r"-?[0-9]+(?:[.,][0-9]+)?"
LEADING_NUMBER = r"^[^0-9-]*(-?[0-9]+(?:\.[0-9]+)?)"
# end of fixed values

ABSOLUTE = r"(?i)\b(" + "|".join(ABSOLUTE_WORDS) + r")\b"
HEDGE = r"(?i)\b(" + "|".join(HEDGE_WORDS) + r")\b"


def tokens(s: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters and digits of at least ``least`` characters; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def number_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(NUMBER_TOKEN), F.lit(0))


def numbers(s: Column) -> Column:
    """Numbers of a text; a comma is dropped, so "1,5" is 15."""
    return F.transform(number_tokens(s), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def leading_number(s: Column) -> Column:
    """The first number if nothing but non-digits comes before it; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(s), LEADING_NUMBER, 1), F.lit("")).try_cast("double")


def clean_number(s: Column) -> Column:
    """A trimmed text with one kind of minus sign and no commas between digits; null is empty."""
    return F.regexp_replace(F.translate(F.trim(F.coalesce(s, F.lit(""))), "\u2212\u2013\u2014", "---"), r"(?<=[0-9]),(?=[0-9])", "")


def distinct_near(values: Column, most: int = 12) -> Column:
    """The first ``most`` numbers of an array of which none is near() an earlier one, in order."""
    fresh = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda y: near(x, y))
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.array().cast("array<double>"), lambda kept, x: F.when(fresh(kept, x), F.array_append(kept, x)).otherwise(kept))


def stem_numbers(s: Column) -> Column:
    """The numbers of a stem, its fractions first, each kept unless it is near an earlier one; at most twelve."""
    s = F.coalesce(s, F.lit(""))
    parts = F.transform(F.regexp_extract_all(s, F.lit(r"-?[0-9]+\s*/\s*-?[0-9]+"), F.lit(0)), lambda t: F.transform(F.split(t, "/"), lambda x: F.trim(x).try_cast("double")))
    plain = F.transform(F.regexp_extract_all(s, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda t: t.try_cast("double"))
    return distinct_near(F.concat(F.transform(parts, lambda p: F.try_divide(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), plain))


def fraction(s: Column) -> Column:
    """a/b as a double; null if the text is no fraction or b is zero."""
    part = lambda g: F.nullif(F.regexp_extract(F.trim(s), r"^(-?[0-9]+)\s*/\s*(-?[0-9]+)$", g), F.lit("")).try_cast("double")
    return F.try_divide(part(1), part(2))


def option_number(s: Column) -> Column:
    """A fraction first, then the leading number: "3/4" is 0.75 here and 3 in leading_number."""
    return F.coalesce(fraction(s), leading_number(s))


def answers_match(expected: Column, got: Column) -> Column:
    """Equal but for case; or numbers within 1e-6 relative or 0.005; or fractions within 1e-6."""
    a, b = F.trim(expected), F.trim(got)
    whole = lambda s: F.when(s == "", F.lit(0.0)).otherwise(F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    na, nb, fa, fb = whole(a), whole(b), fraction(a), fraction(b)
    close = (F.abs(na - nb) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(na))) | (F.abs(na - nb) < 0.005)
    return F.when(F.lower(a) == F.lower(b), True).when(na.isNotNull() & nb.isNotNull(), close).otherwise(F.coalesce(F.abs(fa - fb) < 1e-6, F.lit(False)))


def near(a: Column, b: Column) -> Column:
    """Within 1e-4 of the larger one (of 1 if less), or 0.01."""
    return (F.abs(a - b) <= 1e-4 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))) | (F.abs(a - b) < 0.01)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def year_bucket(year: Column) -> Column:
    return F.when(year <= 1995, "to 1995").when(year <= 1998, "1996-1998").when(year <= 2000, "1999-2000").otherwise("after")


def mask_quantities(s: Column) -> Column:
    """Amounts, percentages, fractions, times, codes and bare numbers become a mask, in this order."""
    for pattern in (r"[$€£]\s*[0-9][0-9,]*(?:\.[0-9]+)?", r"[0-9]+(?:\.[0-9]+)?\s*%", r"[0-9]+\s*/\s*[0-9]+", r"[0-9]{1,2}:[0-9]{2}", r"-?[0-9]+(?:[.,][0-9]+)*"):
        s = F.regexp_replace(s, pattern, "[Q]")
    return s


def character_error_rate(expected: Column, got: Column) -> Column:
    return F.levenshtein(expected, got) / F.greatest(F.length(expected), F.lit(1))


# fixed values: the steps between the numbers of an axis, the fewest that make one, and what counts as a number there
RUN_STEPS, RUN_LEAST = (1, 2, 5, 10, 15), 4
INTEGER_TOKEN = r"(?<![0-9.])([0-9]+)(?![0-9.])"
# end of fixed values


def run_places(values: Column) -> Column:
    """Of an array of numbers, 1 at the first and 2 at the others of each run of equally spaced ones that is taken out, else 0.

    Runs are taken greedily from the left: from each number the longest that one of the steps makes, if it has enough."""
    state = lambda out, n, last, d: F.struct(out.alias("out"), n.alias("n"), last.alias("last"), d.alias("d"))
    none = F.lit(None).cast("long")
    told = lambda s: F.concat(s["out"], F.when(s["n"] >= RUN_LEAST, F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(2), s["n"] - 1))).otherwise(F.array_repeat(F.lit(0), s["n"])))

    def step(s: Column, x: Column) -> Column:
        gap = x - s["last"]
        fits = F.coalesce(gap.isin(*RUN_STEPS), F.lit(False))
        grown = state(s["out"], s["n"] + 1, x, gap)
        short = F.concat(s["out"], F.array_repeat(F.lit(0), s["n"] - 1))
        return (
            F.when((s["n"] >= 2) & F.coalesce(gap == s["d"], F.lit(False)), grown).when((s["n"] == 1) & fits, grown)
            .when((s["n"] == 0) | (s["n"] >= RUN_LEAST), state(told(s), F.lit(1), x, none))
            .when(fits, state(short, F.lit(2), x, gap)).otherwise(state(told(s), F.lit(1), x, none))
        )

    return F.aggregate(values, state(F.array().cast("array<int>"), F.lit(0), none, none), step, told)


def drop_arithmetic_runs(s: Column) -> Column:
    """A text in which each run of four or more equally spaced whole numbers, with what stands between them, is one space."""
    tokens = F.regexp_extract_all(s, F.lit(INTEGER_TOKEN), F.lit(1))
    parts, places = F.split(s, INTEGER_TOKEN), run_places(F.transform(tokens, lambda t: t.try_cast("long")))
    piece = lambda p, i: F.when(F.get(places, i) == 0, F.concat(p, F.get(tokens, i))).when(F.get(places, i) == 1, F.concat(p, F.lit(" "))).when(F.get(places, i) == 2, F.lit("")).otherwise(p)
    return F.array_join(F.transform(parts, piece), "")
