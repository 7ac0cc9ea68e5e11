import pytest
from pyspark.sql import functions as F

from rulemeter.functions import rng
from rulemeter.operators import equations as E
from rulemeter.operators import fidelity as Fi
from rulemeter.operators import power as P
from rulemeter.sources import exams as X


def test_numpy_draws_equal_columns(spark):
    got = [r.x for r in spark.range(5, 205).select(rng.mulberry32(F.lit(99), F.col("id")).alias("x")).collect()]
    assert P.draws(99, 5, 200).tolist() == got


def test_power_equals_published_values(spark):
    assert P.min_observable(21, 0.25) == pytest.approx(0.476, abs=5e-4)
    assert P.min_observable(53, 0.25) == pytest.approx(0.396, abs=5e-4)
    assert P.min_detectable(21, 0.25) == pytest.approx(0.571, abs=5e-4)
    cells = spark.createDataFrame([("a", 21, 0.25), ("b", 21, 0.25), ("c", 9, 0.25)], "c string, n int, chance double")
    assert {r.c: r.min_observable for r in P.cell_power(cells).collect()} == {"a": 10 / 21, "b": 10 / 21, "c": None}


def test_fidelity(spark):
    rows = [("1", "a b b c", "a b c d", {"A": "x", "B": "1/2"}, {"A": "x", "B": "1 2"}, True), ("2", "", "", None, None, True), ("3", "same words", "same words", {"A": "x"}, {}, False)]
    df = spark.createDataFrame(rows, "id string, stem string, stem_read string, options map<string,string>, options_read map<string,string>, judged boolean")
    got = {r.id: r for r in Fi.verdicts(df).collect()}
    assert got["1"].stem_f1 == pytest.approx(0.75) and got["1"].option_score == 1.0 and got["1"].verdict == "stem differs"
    assert got["2"].verdict == "faithful" and got["3"].verdict == "options differ"
    assert Fi.calibrate(df, [0.7, 0.9]).first().agreement == 1.0
    r = df.select("id", Fi.character_ratio("stem", "stem_read").alias("r")).collect()
    assert {x.id: round(x.r, 3) for x in r} == {"1": 0.75, "2": 1.0, "3": 1.0}


def test_questions_join_their_keys(spark):
    text = "Header\n1. What is 2 + 2?\nA 3\nB 4\nC 5\nPage 3\n2. Pick one.\nF. red\n  dark\nG. blue\n3. Inline (1) one (2) two (3) three\n4. No choices here\n"
    pages = spark.createDataFrame([("d", text), ("e", None)], "doc string, text string")
    keys = spark.createDataFrame([("d", 1, "B"), ("d", 2, "A"), ("d", 3, "D")], "doc string, number int, key string")
    got = {r.number: r for r in X.with_keys(X.questions(pages), keys).collect()}
    assert got[1].choices == {"A": "3", "B": "4", "C": "5"} and got[1].reject is None
    assert got[2].choices == {"A": "red dark", "B": "blue"} and got[3].choices == {"A": "one", "B": "two", "C": "three"}
    assert (got[3].reject, got[4].reject) == ("key not in choices", "too few choices")


def test_responses(spark):
    lines = ["# note", "start 10:00", "a", "R guess", "", "B two words", "x", "end 11:00"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file string, line_no int, line string")
    assert [(r.position, r.letter, r.note) for r in X.responses(df).orderBy("position").collect()] == [(1, "A", None), (2, "R", "guess"), (3, None, None), (4, None, None)]


@pytest.mark.parametrize(("s", "want"), [("2x+1", 7.0), ("2(x-1)^2", 8.0), ("-x^2", -9.0), ("x/0", None), ("x +", None), ("sqrt(12x)", 6.0), ("9^99", None), ("import", None)])
def test_expressions(s, want):
    assert E.value(s, {"x": 3.0}) == want


def test_back_substitution(spark):
    o = [("A", "2"), ("B", "x = 3"), ("C", "7/2"), ("D", "none")]
    items = spark.createDataFrame([("1", "Solve 2x + 1 = 7 for the value.", o), ("2", "What is 4?", o), ("3", "If 3y - 1 > 6 and y is whole", o), ("4", None, [])], "id string, stem string, options array<struct<letter:string,text:string>>")
    got = {r.id: (r.answer, r.n_equations) for r in E.back_substitution(items).collect()}
    assert got["1"] == ("B", 1) and got["2"] == (None, 0) and got["4"] == (None, 0)


def test_tails_of_large_counts_are_right_to_twelve_digits():
    import numpy as np

    from rulemeter.operators import stats

    for n, k in ((4284, 2142), (257040, 128393), (257040, 128520), (1542000, 771000), (1542000, 771434)):
        up = np.arange(n // 2, n, dtype=np.longdouble)
        half = np.concatenate(([np.longdouble(0)], np.cumsum(np.log((n - up) / (up + 1)))))  # of n // 2, n // 2 + 1, ..; n is even
        terms = np.exp(half)
        below = terms[1 : n // 2 - k + 1].sum() if k < n // 2 else np.longdouble(0)
        want = (below + terms[max(0, k - n // 2) :].sum()) / (2 * terms.sum() - 1)
        assert abs(stats.upper_tail(k, n, 0.5) - float(want)) < 1e-12
