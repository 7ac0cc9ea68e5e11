import pytest
from pyspark.sql import functions as F

from rulemeter.operators import systems as Y

SCHEMA = "id long, stem string, options array<struct<letter:string,text:string>>"


def o(*texts):
    return list(zip("ABCDE", texts, strict=False))


CASES = [  # stem, options, answer, kind, equations, hits
    ("If 2x + 3y = 12 and x - y = 1, find (x, y).", o("(3, 2)", "(2, 3)", "x = 0, y = 4", "5"), "A", "system", 2, "A"),
    ("Solve 3x + 4 = 19.", o("5", "x = 5", "-5", "five"), None, "scalar", 1, "AB"),
    ("Solve 3x + 4 = 19.", o("x = 5", "-5", "5 or 6"), "A", "scalar", 1, "A"),
    ("x/2 = 3 is no sum here", o("6", "1"), None, None, 0, None),
    ("Solve 1/2x − 4 = 1", o("10", "5/2", "20/2.0"), "A", "scalar", 1, "A"),
    ("Which satisfies y ≥ 2x + 1?", o("(1, 3)", "(1, 2)", "(5, 3)"), "A", "pair", 1, "A"),
    ("Which satisfies y < x and y > 0.5?", o("(1, 0.5)", "(2, 1)"), None, None, 1, None),
    ("y = 2(x + 3) has factors", o("(0, 6)"), None, None, 0, None),
    ("y = 2x^2", o("(1, 2)"), None, None, 0, None),
    ("a + b = 10 and a - b = 2", o("(6, 4)", "(4, 6)"), "A", "system", 2, "A"),
    ("x = 3 and y = 4 name two", o("(3, 4)", "(4, 3)"), "A", "system", 2, "A"),
    ("x + y = 3, x + y = 3", o("(1, 2)", "(2, 1)"), None, "pair", 1, "AB"),
    ("x + y + z = 3", o("(1, 2)"), None, None, 0, None),
    ("x != 3", o("3", "4"), "B", "scalar", 1, "B"),
    ("What is 2 + 2?", o("4"), None, None, 0, None),
    ("x = 1,200 is", o("1,200", "12"), "A", "scalar", 1, "A"),
    (None, o("1"), None, None, 0, None),
    ("x = 1", None, None, None, 1, None),
    ("x = 1", [], None, None, 1, None),
]


def test_substitution(spark):
    t = spark.createDataFrame([(i, s, x) for i, (s, x, *_) in enumerate(CASES)], SCHEMA)
    got = {r.id: r for r in Y.substitution(t).collect()}
    for i, (_, _, answer, kind, n, hits) in enumerate(CASES):
        r = got[i]
        assert (r.answer, r.kind, r.n_equations, None if r.hits is None else "".join(r.hits)) == (answer, kind, n, hits), CASES[i]
    assert tuple(got[0].solution) == pytest.approx((3, 2)) and tuple(got[9].solution) == pytest.approx((6, 4)) and got[11].solution is None


@pytest.mark.parametrize(("text", "want"), [("5", (5, None)), ("-3/4", (-0.75, None)), ("x = 2.5", (2.5, None)), ("(1, -2)", (1, -2)), ("( 1/2 ,3 )", (0.5, 3)), ("X = 1, y = 2/4", (1, 0.5)), ("5 cm", (None, None)), ("$1,250", (1250, None)), ("1/0", (None, None)), (None, (None, None)), ("(1, 2, 3)", (None, None))])
def test_strict_options(spark, text, want):
    assert tuple(spark.range(1).select(Y.strict_option(F.lit(text).cast("string")).alias("p")).first().p) == want
