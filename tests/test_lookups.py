from pyspark.sql import functions as F

from rulemeter.operators import agreement as A
from rulemeter.operators import relational as R


def test_prioritised_lookups(spark):
    index = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 1, "z"), ("", 9, "never"), (None, 9, "never")], "k string, n int, s string")
    rows = spark.createDataFrame([(1, "a", "b"), (2, "q", "b"), (3, None, "a"), (4, "", None), (5, "q", "r")], "id int, first string, second string")
    got = {r.id: (r.rank, r.n, r.s) for r in R.prioritised(rows, "id", [F.col("first"), F.col("second")], index, "k").collect()}
    assert got == {1: (0, 1, "x"), 2: (1, 1, "z"), 3: (1, 1, "x"), 4: (None, None, None), 5: (None, None, None)}
    assert R.prioritised(rows, "id", [F.col("first")], index.filter("false"), "k").count() == 5


def test_best_match(spark):
    left = spark.createDataFrame([(1, "g3", 2018), (2, "g3", 2019), (3, None, 2018)], "id int, grade string, year int")
    right = spark.createDataFrame([("g3", 2018, "z-key", 8), ("g3", 2018, "a-key", 8), ("g3", 2018, "a-sampler", -20), ("g4", 2018, "k", 9), (None, 2018, "n", 1)], "grade string, year int, name string, points int")
    got = {r.id: r.name for r in R.best_match(left, right, ["grade", "year"], F.col("points"), "name").collect()}
    assert got == {1: "a-key", 2: None, 3: None}


def test_blinded_agreement(spark):
    m = {"A": "C", "B": "A", "C": "B"}
    packets = spark.createDataFrame([(i, f"o{i}", m if i != 4 else {"A": "Z"}, "C", "claim") for i in range(6)], "id int, opaqueId string, letterMap map<string,string>, shuffledKey string, claim string")
    predictions = spark.createDataFrame([("o0", " c) "), ("o1", "A"), ("o2", ""), ("o4", "C"), ("o4", "B"), ("o9", "A")], "opaqueId string, predicted string")
    scored = A.blinded_scores(packets, predictions)
    assert {r.id: (r.predicted, r.correct) for r in scored.collect()} == {0: ("C", True), 1: ("A", False), 2: (None, None), 3: (None, None), 4: ("C", True), 5: (None, None)}
    assert tuple(A.score_summary(scored, ["claim"]).first()) == ("claim", 6, 3, 3, 2, 2 / 3)
    local = spark.createDataFrame([(0, "A", True), (1, "A", True), (4, "a", None), (5, "B", True)], "id int, answer string, correct boolean")
    r = A.agreement(local, scored, packets).first()
    # 0: both right, own letter A; 1: theirs is B; 4: no own letter
    assert (r.n_overlap, r.correctness_agreement, r.n_letters, r.n_unmapped, r.letter_agreement, r.both_correct) == (3, 1 / 3, 2, 1, 0.5, 1 / 3)
    none = A.agreement(local.filter("false"), scored, packets).first()
    assert (none.n_overlap, none.letter_agreement, none.our_rate) == (0, None, None)
