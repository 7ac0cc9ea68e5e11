"""Both versions of masked stems from one first pass, and look-aheads that leave every match as it was."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import masking as K
from rulemeter.plans import transcripts

PATTERNS = [p for p, _ in K.PASS + K.SWEEP] + list(K.LEAKS.values()) + [K.FIGURE, *K.ASSIGNMENTS, K.COEFFICIENT]
PIECES = (
    "ſix ſeven SIX Ten one- third two-thirds three  halves t hirds f ifths twice THRICE half Quarter quarters $ 1,234.50 $-3 12.5% 7 percent -.5 −12 1,000 3.14. 2x ( -3 , 4 ) 3 + 4y 0 ٣ ½ ⅔ ⅒ x² y₃ ¹ ı İsosceles "
    "ISOSCELES triangle Kite Kite regular right triangles square ſquare let f(x) = 3x+2, given that g ( t ) equals t; let y be 4. a = -b? z=[N] K = 5$ bone tend often weight hundredths é1 1é [N] thirds sphere s ix"
).split(" ")


def _texts(n: int = 150) -> list[str]:
    rng = random.Random(8)
    return ["".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", "\n", ", ", "", "  "]) for _ in range(rng.randrange(0, 40))) for _ in range(n)] + [" ".join(PIECES)]


def test_look_aheads_leave_all_matches(spark):
    t = spark.createDataFrame([(x,) for x in _texts()], "t string")
    plain = F.array(*(F.regexp_replace("t", "(?iU)" + p, "~$0~") for p in PATTERNS))
    quick = F.array(*(F.regexp_replace("t", K._quick(p), "~$0~") for p in PATTERNS))
    for row in t.select("t", plain.alias("a"), quick.alias("b")).collect():
        assert row.a == row.b, row.t


def test_both_versions_are_the_versions(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate([*_texts(), None, ""])], "id long, stem string")
    cols = ["id", "masked", "n_placeholders", "flags", "second_sweep", "share", "status"]
    both = K.both_versions(t, 1).collect()
    for version in (1, 2):
        want = {r.id: r for r in K.masked_stems(t, version, 1).select(cols).collect()}
        got = {r.id: r for r in both if r.version == version}
        assert got.keys() == want.keys()
        assert all(got[i][c] == want[i][c] for i in want for c in cols)


@pytest.fixture
def plan(spark):
    df = transcripts.masked_stems(spark, "/root/testdata/sf0.001")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_and_masked_once(plan):
    assert plan.count("Relation [") == 1
