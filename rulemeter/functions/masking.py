"""Stems with their given quantities hidden: ordered substitutions, a sweep for leaks, and what is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import once

# fixed values: words and forms of quantities
PLACEHOLDER = "[N]"
CARDINALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
TAILS = (
    "half halves third thirds fourth fourths fifth fifths sixth sixths seventh sevenths eighth eighths ninth ninths tenth tenths eleventh elevenths twelfth twelfths hundredth hundredths thousandth thousandths quarter quarters"
).split()
VULGAR = "[½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞⅑⅒]"
SMALL_DIGIT = "[⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]"
CARDINAL = rf"\b(?:{'|'.join(sorted(CARDINALS, key=len, reverse=True))})\b"
HYPHEN_FRACTION = rf"\b(?:{'|'.join(sorted(CARDINALS, key=len, reverse=True))})\s*-\s*(?:{'|'.join(TAILS)})\b"
SPACED_FRACTION = rf"\b(?:{'|'.join(sorted(CARDINALS, key=len, reverse=True))})\s+(?:{'|'.join(TAILS)})\b"
SPLIT_FRACTION = r"\bt\s+hirds?\b|\bf\s+ourths?\b|\bf\s+ifths?\b|\bt\s+enths?\b"
CURRENCY = r"\$\s*[-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
PERCENT = r"[-−]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?(?=\s*%|\s*percent\b)"
DECIMAL = r"(?<![\d.])[-−]?(?:\d{1,3}(?:,\d{3})*|\d+)?\.\d+"
COMMA_INTEGER = r"(?<![\d.])[-−]?\d{1,3}(?:,\d{3})+\b"
INTEGER = r"(?<![\d.])[-−]?\d+(?!\.\d)"
SCALE_WORD = r"\b(?:twice|thrice)\b"
FRACTION_WORD = r"\b(?:half|halves|quarter|quarters)\b"
PLACEHOLDER_FRACTION = rf"\[N\]\s+(?:{'|'.join(TAILS)})\b"
ALGEBRA = r"\b\d+\s*[a-zA-Z]\b|\b\d+\s*[+\-−]\s*\d+\s*[a-zA-Z]|\(\s*[-−]?\d+(?:\.\d+)?\s*,\s*[-−]?\d+"
FIGURE = (
    r"\b(?:isosceles|equilateral|scalene)\b"
    r"|\bregular\s+(?:right\s+)?(?:triangle|quadrilateral|polygon|pentagon|hexagon|heptagon|octagon|nonagon|decagon|n-gon)s?\b"
    r"|\bright\s+triangles?\b"
    r"|\b(?:triangle|parallelogram|rhombus|rhombi|rectangle|square|trapezoid|trapezium|kite|pentagon|hexagon|heptagon|octagon|decagon|quadrilateral|cube|cuboid|prism|pyramid|cylinder|cone|sphere|hemisphere|circle)s?\b"
)
ASSIGNMENTS = [
    r"(\b(?:let|given(?:\s+that)?)\s+[a-zA-Z]\s*\(\s*[a-zA-Z]\s*\)\s*(?:=|equals|equal to|5)\s*)([^.?!,;]+)",
    r"(\b(?:let|given(?:\s+that)?)\s+[a-zA-Z]\s*\(\s*[a-zA-Z]\s*\)\s*\[N\]\s*)([^.?!,;]+)",
    r"(\blet\s+[a-zA-Z](?:\s*\(\s*[a-zA-Z]\s*\))?\s*(?:=|equals|equal to|be)\s*)([^.?!,;]+)",
    r"(\b[a-zA-Z]\s*=\s*)([-−\[].{0,80}?)(?=(?:,|;|\.|\?|which\b|what\b|$))",
]
COEFFICIENT = r"(?<!\[N\])(?<!\d)\d+(?:\.\d+)?(?=[a-zA-Z(])"
#: What is hidden, in this order; a currency sign stays.
PASS = [
    (VULGAR, PLACEHOLDER), (SMALL_DIGIT, PLACEHOLDER), (HYPHEN_FRACTION, PLACEHOLDER), (SPACED_FRACTION, PLACEHOLDER), (SPLIT_FRACTION, PLACEHOLDER), (CURRENCY, "$" + PLACEHOLDER), (PERCENT, PLACEHOLDER), (DECIMAL, PLACEHOLDER),
    (COMMA_INTEGER, PLACEHOLDER), (INTEGER, PLACEHOLDER), (SCALE_WORD, PLACEHOLDER), (FRACTION_WORD, PLACEHOLDER), (CARDINAL, PLACEHOLDER), (PLACEHOLDER_FRACTION, PLACEHOLDER), (r"[ \t]{2,}", " "),
]
#: What must not be left, by its flag.
LEAKS = {
    "remaining_digit": rf"\d|{SMALL_DIGIT}", "remaining_vulgar_fraction": VULGAR, "remaining_cardinal": CARDINAL, "remaining_hyphen_fraction": HYPHEN_FRACTION, "remaining_scale_word": SCALE_WORD, "remaining_fraction_word": FRACTION_WORD, "remaining_algebra_or_coordinate": ALGEBRA,
}
SWEEP = [(r"\d", PLACEHOLDER), (VULGAR, PLACEHOLDER), (SMALL_DIGIT, PLACEHOLDER), (CARDINAL, PLACEHOLDER), (SCALE_WORD, PLACEHOLDER), (FRACTION_WORD, PLACEHOLDER)]
# end of fixed values
_FLAGS = "(?iU)"  # letters and word bounds of all scripts, either case


#: What folds to these letters beside their upper case.
_FOLDS = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _start(words: str) -> str:
    """Looks for letters in either case that, place by place, are among the first three of the words."""
    places = ["".join(sorted({x for c in at for x in (c, c.upper(), *_FOLDS.get(c, ""))})) for at in zip(*(w[:3] for w in words.split()), strict=True)]
    return "(?-i:(?=" + "".join(f"[{x}]" for x in places) + "))"


_CARDINAL_START = _start(" ".join(CARDINALS))
_FIGURES = (
    "isosceles equilateral scalene regular right triangle parallelogram rhombus rhombi rectangle square trapezoid trapezium kite pentagon hexagon heptagon octagon decagon quadrilateral cube cuboid prism pyramid cylinder cone sphere "
    "hemisphere circle"
)
#: What a match of a pattern begins with at least. A look ahead costs less than a word bound or a look behind at every place.
_AHEAD = {
    CARDINAL: _CARDINAL_START, HYPHEN_FRACTION: _CARDINAL_START, SPACED_FRACTION: _CARDINAL_START, SPLIT_FRACTION: r"(?=[tf]\s)", SCALE_WORD: _start("twice thrice"), FRACTION_WORD: _start("half quarter"), FIGURE: _start(_FIGURES),
    PERCENT: r"(?=[-−\d])", DECIMAL: r"(?=[-−\d.])", COMMA_INTEGER: r"(?=[-−\d])", INTEGER: r"(?=[-−\d])", ALGEBRA: r"(?=[\d(])", COEFFICIENT: r"(?=\d)",
    ASSIGNMENTS[0]: _start("let given"), ASSIGNMENTS[1]: _start("let given"), ASSIGNMENTS[2]: _start("let"), ASSIGNMENTS[3]: r"(?=[a-zA-Z]\s*=)",
}
#: The same signs as ranges without a case, which is compared sign by sign otherwise.
_RANGES = {VULGAR: "(?-i:[\u00bc-\u00be\u2150-\u215e])", SMALL_DIGIT: "(?-i:[\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089])"}


def _quick(pattern: str) -> str:
    """A pattern with the matches of ``pattern`` that rules places out sooner."""
    told = f"{_AHEAD[pattern]}(?:{pattern})" if pattern in _AHEAD else pattern
    for signs, ranges in _RANGES.items():
        told = told.replace(signs, ranges)
    return _FLAGS + told


def _rewritten(s: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        s = F.regexp_replace(s, _quick(pattern), to.replace("$[", r"\$["))
    return s


def leak_flags(masked: Column) -> Column:
    return F.array_compact(F.array(*(F.when(masked.rlike(_quick(p)), F.lit(name)) for name, p in LEAKS.items())))


def masked_share(original: Column, masked: Column) -> Column:
    """Share of the original's characters that are not left outside of placeholders, 0 to 1; 0 for an empty one."""
    left = F.length(F.replace(masked, F.lit(PLACEHOLDER), F.lit("")))
    return F.when(F.length(original) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length(original) - left) / F.length(original)))).otherwise(0.0)


def _measured(t: DataFrame, least: int) -> DataFrame:
    """``t`` with what is told of its column masked; _o is the original."""
    t = once(t, flags=leak_flags(F.col("masked")))
    n = F.regexp_count("masked", F.lit(r"\[N\]"))
    status = F.when(F.size("flags") > 0, "dropped").when(F.col("n_placeholders") < least, "below_min").otherwise("kept")
    return t.withColumn("n_placeholders", n).withColumn("share", masked_share(F.col("_o"), F.col("masked"))).withColumn("status", status).drop("_o")


def _first_version(items: DataFrame, stem: str) -> DataFrame:
    """``items`` with _o, masked and second_sweep."""
    t = items.withColumn("_o", F.coalesce(F.col(stem), F.lit("")))
    t = once(t, masked=_rewritten(F.col("_o"), PASS))
    t = once(t, flags=leak_flags(F.col("masked")))
    t = t.withColumn("second_sweep", F.size("flags") > 0)
    return once(t, masked=F.when(F.col("second_sweep"), _rewritten(F.col("masked"), PASS + SWEEP)).otherwise(F.col("masked")))


def _hidden_further(masked: Column) -> Column:
    """What version 2 hides beyond version 1, before the first pass is taken again."""
    for pattern, to in [(FIGURE, PLACEHOLDER), *((p, "$1" + PLACEHOLDER) for p in ASSIGNMENTS), (COEFFICIENT, PLACEHOLDER), (r"[ \t]{2,}", " ")]:
        masked = F.regexp_replace(masked, _quick(pattern), to)
    return masked


def masked_stems(items: DataFrame, version: int = 1, least: int = 0, stem: str = "stem") -> DataFrame:
    """``items`` with masked, n_placeholders, flags, second_sweep, share and status of their stem (null: empty).

    Where the first pass leaves something, a second one and a sweep of single digits and words follow. Version 2 hides names of
    figures, right sides of assignments and coefficients as well. Status is dropped if a flag is left, below_min with fewer
    than ``least`` placeholders, else kept."""

    t = _first_version(items, stem)
    if version == 2:
        t = once(once(t, masked=_hidden_further(F.col("masked"))), masked=_rewritten(F.col("masked"), PASS))
    return _measured(t, least)


def both_versions(items: DataFrame, least: int = 0, stem: str = "stem") -> DataFrame:
    """masked_stems() of versions 1 and 2, a row each with the column version; version 2 goes on from the text of version 1."""
    t = _first_version(items, stem).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    for fn in (_hidden_further, lambda masked: _rewritten(masked, PASS)):
        t = once(t, masked=F.when(F.col("version") == 2, fn(F.col("masked"))).otherwise(F.col("masked")))
    return _measured(t, least)
