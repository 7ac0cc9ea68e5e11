from pyspark.sql import functions as F

from rulemeter.operators import census, rollups as R
from rulemeter.operators import items as I

TRIALS = "id long, authority string, claim string, program string, answer string, skipped boolean, key string, chance double, correct boolean"


def trials(spark):
    row = lambda i, p, a, k, c: (i, "X", "c", p, a, a is None, k, 0.25, c)
    return spark.createDataFrame([row(1, "p", "A", "A", True), row(2, "p", "B", "A", False), row(3, "p", None, "C", None), row(1, "q", "B", "A", False), row(2, "q", "A", "A", True), row(3, "q", None, "C", None)], TRIALS)


def test_abstentions_count_as_chance_only_where_asked(spark):
    t = {r.program: r for r in R.channel_summary(trials(spark), ["program"], 3).collect()}
    assert (t["p"].n, t["p"].n_scored, t["p"].rate, t["p"].with_chance) == (3, 2, 0.5, (1 + 0 + 0.25) / 3)
    assert R.channel_summary(trials(spark), ["program"], 4).count() == 0


def test_modal_letters_residual_and_pairs(spark):
    t = trials(spark)
    keys = t.select("id", "authority", "key").distinct()
    m = R.modal_letters(keys, ["authority"]).first()
    assert (m.letter, m.n) == ("A", 2) and abs(m.share - 2 / 3) < 1e-12
    assert [r.id for r in R.residual(t, ["p", "q"]).collect()] == [3]
    x = R.paired(t, "p", "q").first()
    assert (x.n, x.difference, x.n11, x.n10, x.n01, x.n00) == (2, 0.0, 0, 1, 1, 0)
    assert R.paired(t.limit(0), "p", "q").first().n == 0


def test_runs_of_equal_steps(spark):
    rows = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, 4, 9, 14, 19, 24, 100)] + [(2, 7), (None, 1)], "g int, v int")
    got = {(r.g, r.start, r.step, r.n) for r in R.arithmetic_runs(rows, "g", "v").collect()}
    assert got == {(1, 1, 1, 4), (1, 4, 5, 5)}
    got = {(r.g, r.start, r.step, r.n) for r in R.arithmetic_runs(rows.limit(0), "g", "v").collect()}
    assert got == set()


def test_last_by_id_and_applicability(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "c")], "id int, at int, v string")
    assert {(r.id, r.v) for r in R.last_by_id(rows, "id", "at").collect()} == {(1, None), (2, "c")}
    t = spark.createDataFrame([("p", "selected"), ("p", "numeric"), ("q", "numeric")], "program string, response_type string")
    rules = spark.createDataFrame([("p", ["selected"]), ("q", ["numeric"])], "program string, applies_to array<string>")
    assert {tuple(r) for r in R.applicable(t, rules).collect()} == {("p", "selected"), ("q", "numeric")}


def test_items_of_unknown_claims_stay_and_repeated_claims_count_once(spark):
    items = spark.createDataFrame([(1, "X", "c"), (2, "X", "none")], "id int, authority string, claim string")
    claims = spark.createDataFrame([("X", "c", ["bind"]), ("X", "c", ["execute", "bind"])], "authority string, code string, operations array<string>")
    assert {(r.id, r.operation) for r in census.item_operations(items, claims).collect()} == {(1, "bind"), (2, None)}


def test_convergence_counts_numbers_and_digits(spark):
    opts = [{"letter": "A", "text": "5 apples"}, {"letter": "B", "text": "5.0 pears"}, {"letter": "C", "text": "7 plums"}]
    items = spark.createDataFrame([(1, "X", "c", "How many?", "A", opts), (2, "X", "c", "How many?", "A", opts[1:])], "id int, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>")
    got = {r.id: r.e for r in I.prepared(items, "id").select("id", F.transform("p.o", lambda x: x["e"]).alias("e")).collect()}
    assert "num:5.0" in got[1][0] and "num:5.0" in got[1][1] and "digits:50" in got[1][1]
