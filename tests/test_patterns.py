"""Items that programs cannot tell apart are one row with their number, and count as the items do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rulemeter.operators import items as I
from rulemeter.operators import programs as P

SCHEMA = "id long, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>"
ROWS = [
    ("Pick 12 of an", " a ", [("A", "12 red ring"), ("B", "apple 3.5"), ("C", None), (None, "red red gear")]),
    (None, None, [("C", "always 007"), ("C", "7 NEVER"), ("D", "-7 ring")]),
    ("the red ring or a ", "A", []),
    ("x", "A", None),
    ("one bolt", "d", [("D", "bolt")]),
    ("red bolts", "B", [("A", "red gear 4"), ("B", "red bolts 5"), ("C", "blue gear 6")]),
]


@pytest.fixture
def items(spark):
    rows = [(i, "OF"[i % 2], None if i % 5 == 0 else "c", *ROWS[i % len(ROWS)]) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_patterns_are_few_and_hold_all_items(items):
    t = I.patterns(items, ["red"], ["authority"]).collect()
    assert len(t) == len({(r.authority, tuple(r.hits), tuple(r.x)) for r in t}) <= 8
    assert sum(r["items"] for r in t) == items.filter("size(options) > 0").count()
    assert all(len(r.x) == len(I.FEATURES) * len(r.hits) for r in t)
    assert {tuple(r.hits) for r in t} == {(True, False, False, False), (False, False, False), (True,), (False, True, False)}


def test_programs_count_patterns_as_they_count_items(items):
    features = list(I.FEATURES)
    programs = P.enumerate_programs(features) + P.random_programs(features, 3)
    rows = lambda t: {(r.authority, r.claim, r.program): (r.n, r.ok, round(r.chance, 9)) for r in t.collect()}
    six = F.transform("features", lambda x: x.withField("distinctive", F.round(x["distinctive"], 6)).withField("specificity", F.round(x["specificity"], 6)))
    arrays = I.feature_arrays(items, ["red"], ["authority", "claim", "key"]).withColumn("features", six)
    want, got = (rows(P.tally(t, programs, ["authority", "claim"])) for t in (arrays, I.patterns(items, ["red"], ["authority", "claim"])))
    assert want == got and len(want) > 1000


def test_six_digits_are_rounded_as_spark_rounds(spark):
    import numpy as np

    values = [0.0078125, 0.1234565, 1 - 1 / 3, 0.0000005, 2.0000015, 1.3, 0.0, -0.0078125]
    t = spark.createDataFrame([(v,) for v in values], "v double").select(F.rint(F.round("v", 6) * 1e6).cast("long").alias("m"))
    assert I._millionths(np.array(values)).tolist() == [r.m for r in t.collect()]


def test_sums_beyond_single_floats_stay_exact():
    import numpy as np

    x = np.array([[[20_000_001, 0]], [[20_000_000, 1]]])  # two options of one item; the sums differ by 1, or are equal
    answered, right = P._judge(x, np.array([[True], [False]]), np.array([[1.0, 1.0], [0.0, 1.0]]), [], np.array([], int))
    assert answered.tolist() == [[1, 0]] and right.tolist() == [[1, 0]]


def test_eligibility_makes_the_items_once_and_reads_patterns(spark, monkeypatch):
    from rulemeter.plans import programs

    made, read = [], []
    items, tally = programs.order_items, P.tally
    monkeypatch.setattr(programs, "order_items", lambda *a: made.append(1) or items(*a))
    monkeypatch.setattr(P, "tally", lambda arrays, *a: read.append(arrays.columns) or tally(arrays, *a))
    programs.rule_eligibility(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    assert len(read) == 4 and all(c == ["authority", "claim", "hits", "x", "items"] for c in read)
