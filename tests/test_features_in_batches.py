"""Option features over Arrow batches: no array expressions for each option, and odd items as they were."""

from __future__ import annotations

import pytest

from rulemeter.operators import items as I

SCHEMA = "id long, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>"
ROWS = [
    (1, "O", None, "Pick 12 of an", "b", [("A", "12 red ring"), ("B", "apple 3.5"), ("C", None), (None, "red red gear")]),
    (2, "F", None, None, None, [("C", "always 007"), ("C", "7 NEVER"), ("D", "-7 ring")]),
    (3, "F", None, "the red ring or a ", "A", []),
    (4, "O", None, "x", "A", None),
    (1, "F", None, "Pick 12 of an", "A", [("A", "12 red ring"), ("B", "İt ſo 1,5")]),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_features_of_odd_items(items):
    got = {(r.id, r.key): r.features for r in I.feature_arrays(items, ["red"], ["key"]).collect()}
    a, b, c, d = got[1, "b"]
    assert tuple(a) == ("A", 0, 0, 0, 1, 1, 0, 0, 1, 1.3, 0, 1.0)
    assert tuple(b)[:9] == ("B", 0, 0, 0, 0, 1, 1, 0, 0) and b.grammar_agree == 1
    assert (c.letter, c.longest, c.position_c, c.specificity, c.distinctive) == ("C", 0, 1, 0.0, 1.0)
    assert (d.letter, d.longest, d.distinctive) == (None, 1, 1.0)
    x, y, z = got[2, None]
    assert (x.position_c, x.no_absolute, x.numeric_max, z.numeric_min, y.no_absolute) == (1, 0, 0, 1, 0)  # 7 stands twice
    assert got[3, "A"] == [] and got[4, "A"] is None


def test_features_are_made_in_batches(items):
    plan = I.feature_arrays(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan
