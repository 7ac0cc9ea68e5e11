import random
import re

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import masking as K


def sub(steps, s):
    for pattern, to in steps:
        s = re.sub(pattern, to.replace("$1", r"\1"), s, flags=re.I)
    return s


def flags_of(s):
    return [name for name, p in K.LEAKS.items() if re.search(p, s, re.I)]


def masked(s, version):
    """The rule written out."""
    t = sub(K.PASS, s)
    second = bool(flags_of(t))
    if second:
        t = sub(K.PASS + K.SWEEP, t)
    if version == 2:
        t = sub([(K.FIGURE, K.PLACEHOLDER), *((p, "$1" + K.PLACEHOLDER) for p in K.ASSIGNMENTS), (K.COEFFICIENT, K.PLACEHOLDER), (r"[ \t]{2,}", " ")], t)
        t = sub(K.PASS, t)
    return t, second, flags_of(t)


CASES = [
    "", "Nothing to hide", "She paid $1,250.50 for 3/4 of 12 rings", "½ of x² is 20 percent, or 15%", "twenty-five and one-half", "one third and three fourths of a t hird", "a .5 and -3.25, −7", "1,200 and 1.2.3", "twice half a quarter",
    "Let f(x) = 3x + 2. What is f(4)?", "given that g ( y ) equals y, find it", "let n be even; then k = -2x, which", "An isosceles triangle and a regular hexagon", "(2, -3) on 4x", "3x + 5 = 11", "version2b and x1", "Zero   gravity\t\tone", "٣ rings and naïve ７",
    "Hundred thousandths", "[N] halves", "A = [N]x for the cube",
]


@pytest.mark.parametrize("version", [1, 2])
def test_masks_equal_the_rule_written_out(spark, version):
    r, words = random.Random(3), "let f(x) = 3x 4.5 $7 1,000 half one - third twice % percent cube which ? , . -2 ½ x² é n be".split()
    texts = CASES + [" ".join(r.choices(words, k=r.randint(1, 14))) for _ in range(800)]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, stem string")
    for row in K.masked_stems(t, version, 1).collect():
        s = texts[row.i]
        want, second, flags = masked(s, version)
        assert (row.masked, row.second_sweep, row.flags) == (want, second, flags), s
        n = want.count(K.PLACEHOLDER)
        assert row.n_placeholders == n and row.status == ("dropped" if flags else "below_min" if n < 1 else "kept")
        left = len(want.replace(K.PLACEHOLDER, ""))
        assert row.share == pytest.approx(min(1, max(0, (len(s) - left) / len(s))) if s else 0)


def test_null_stems_and_other_columns(spark):
    t = spark.createDataFrame([(1, None, "x")], "i int, stem string, _o2 string")
    r = K.masked_stems(t, 2).first()
    assert (r.masked, r.n_placeholders, r.share, r.status, r.i, r._o2) == ("", 0, 0.0, "kept", 1, "x")
    assert K.masked_stems(t.filter("false")).count() == 0


def test_share(spark):
    r = spark.range(1).select(K.masked_share(F.lit("ab12"), F.lit("ab[N]")).alias("a"), K.masked_share(F.lit("1"), F.lit("longer than it")).alias("b")).first()
    assert (r.a, r.b) == (0.5, 0.0)
