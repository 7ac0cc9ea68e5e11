import math

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import text as T
from rulemeter.operators import channels as C
from rulemeter.operators import strategies as S

SCHEMA = "id long, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>"


def options(*texts):
    return list(zip("ABCDEFG", texts, strict=False))


CASES = [  # stem, options, survivors, constraints, answer
    ("How many rings are there?", options("3", "-3", "2.5", "red"), "AD", 1, "A"),
    ("What is the probability?", options("1.2", "3/4", "0", "1"), "BCD", 1, "B"),
    ("What percentage, and how many?", options("50", "101", "12.5"), "A", 2, "A"),
    ("The height is", options("0", "-1", "1,200", "7"), "CD", 1, "D"),
    ("In a triangle the angle is", options("180", "179", "−30", "0"), "B", 1, "B"),
    ("An angle in degrees", options("200", "360", "90"), "AC", 1, "C"),
    ("The mean of 3, 9 and 12 is", options("2", "8", "12", "13"), "BC", 1, "B"),
    ("The mean of 2019 is", options("2", "8"), "AB", 0, "A"),
    ("Nothing asked", options("a", "b"), "AB", 0, "A"),
    ("What is the probability of 5?", options("5", "6"), "", 1, None),
    (None, [], "", 0, None),
    ("How many?", None, "", 1, None),
]


def test_elimination(spark):
    items = spark.createDataFrame([(i, "a", "c", s, "A", o) for i, (s, o, *_) in enumerate(CASES)], SCHEMA)
    got = {r.id: r for r in C.elimination(items).collect()}
    for i, (_, o, left, n, answer) in enumerate(CASES):
        r = got[i]
        assert ("".join(r.letters), r.n_constraints, r.answer, r.n_options) == (left, n, answer, len(o or [])), CASES[i]
        assert r.chance == (1 / len(left) if left else None)


def test_stem_numbers(spark):
    rows = [("3/4 of 12, 12.005 and 0.75 or -2", [0.75, 3.0, 4.0, 12.0, -2.0]), (None, []), ("1/0 x", [1.0, 0.0]), (" ".join(map(str, range(1, 30))), [float(x) for x in range(1, 13)])]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").select("i", T.stem_numbers(F.col("s")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: n for i, (_, n) in enumerate(rows)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12", [24, 6, 120, 1.2, 13, 11, -12, 1 / 12, 144, 12**0.5, 13, 11, 21]),
        ("1.50", [3, 0.75, 15, 0.15, 2.5, 0.5, -1.5, 1 / 1.5, 2.25, 1.5**0.5, 1.5, 1.65, 1.35, 5.1, 1.05]),
        ("-120", [-240, -60, -1200, -12, -119, -121, 120, -1 / 120, 14400, -12, -12, -132, -108, -210, -102]),
        ("0", [0, 0, 0, 0, 1, -1, 0, 0, 0, 0, 0]),
        ("12 cm", [24, 6, 120, 1.2, 13, 11, -12, 1 / 12, 144, 12**0.5, 13, 11]),
        ("1,000", [2000, 500, 10000, 100, 1001, 999, -1000, 0.001, 10**6, 1000**0.5, 100, 100, 1100, 900, 100, 1000, 1000]),
    ],
)
def test_slips(spark, text, want):
    t = T.clean_number(F.lit(text))
    got = spark.range(1).select(S.slips(T.option_number(t), t).alias("s")).first().s
    assert sorted(got) == pytest.approx(sorted(map(float, want)))


def test_hub_takes_the_lower_central_of_ties(spark):
    items = spark.createDataFrame([(1, "a", "c", "", "A", options("4", "8", "16", "5")), (2, "a", "c", "", "A", options("900", "30", "11.5")), (3, "a", "c", "", "A", options("1", "2")), (4, "a", "c", "", "A", options("x", "y", "z"))], SCHEMA)
    got = {r.id: (r.answer, r.tied) for r in S.hub(items).collect()}
    # 4: 8, 16, 5; 8: 4, 16 is 2 x 8; 16: 8, 4; 5: 4
    assert got[1] == ("A", ["A"]) and set(got) == {1, 2}
    assert got[2][1] == ["A", "B"] and got[2][0] == "B"


def test_cells_are_zero_filled_and_families_corrected(spark):
    items = spark.createDataFrame([(i, "a", f"c{i // 20}", "", "A", options("1", "2")) for i in range(65)], SCHEMA)
    x = items.select("id", F.when(F.col("id") < 20, "A").when(F.col("id") < 40, F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("answer"), F.lit(0.5).alias("chance"))
    y = items.select("id", F.when(F.col("id") < 15, "a ").alias("answer"), F.lit(0.25).alias("chance"))
    rows = C.channel_rows({"x": x, "y": y}, items).collect()
    got = {(r.channel, r.claim): r for r in rows}
    assert set(got) == {(k, c) for k in "xy" for c in ("c0", "c1", "c2")}  # c3 has five items
    r = got["x", "c0"]
    assert (r.n_items, r.n_scored, r.n_correct, r.clears, r.in_family, r.holm) == (20, 20, 20, True, True, True) and r.p == pytest.approx(0.5**20)
    r = got["x", "c1"]
    assert (r.n_correct, r.clears, r.holm, r.bonferroni) == (10, False, False, False)
    assert r.p == pytest.approx(sum(math.comb(20, k) for k in range(10, 21)) / 2**20)
    r = got["x", "c2"]
    assert (r.n_scored, r.rate, r.chance, r.lo, r.p, r.in_family, r.holm) == (0, 0, 0, 0, 1, False, False)
    r = got["y", "c0"]
    assert (r.n_scored, r.n_correct, r.coverage, r.pooled_holm) == (15, 15, 0.75, True)


def test_shares(spark):
    items = spark.createDataFrame([(i, "a", "c", s, "A", o) for i, (s, o, *_) in enumerate(CASES)], SCHEMA)
    r = C.elimination_shares(C.elimination(items), items).first()
    n = len(CASES)
    assert (r.n_items, r.mean_left, r.one_left) == (n, pytest.approx(sum(len(c[2]) for c in CASES) / n), pytest.approx(2 / n))
    assert r.key_left == pytest.approx(sum("A" in c[2] for c in CASES) / n) and r.constrained == pytest.approx(sum(c[3] > 0 for c in CASES) / n)


def test_tie_null(spark):
    rows = [(i, "A", "A", ["A"]) for i in range(5)] + [(10 + i, "B", "A", ["A", "B"]) for i in range(40)] + [(90, "C", None, [])] + [(91, None, "B", ["B"])]
    t = spark.createDataFrame(rows, "number long, key string, answer string, tied array<string>")
    r = C.tie_null(t, 7).first()
    assert (r.n, r.n_tied, r.rule_rate, r.expected_rate) == (46, 40, pytest.approx(5 / 46), pytest.approx(25 / 46))
    assert 5 / 46 < r.lo < 25 / 46 < r.hi < 1 and abs((r.lo + r.hi) / 2 - 25 / 46) < 0.03
    assert C.tie_null(t.repartition(7), 7).first() == r and C.tie_null(t.filter("false"), 7).count() == 0
