import math
import random

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import rng
from rulemeter.functions import text as T
from rulemeter.operators import items as I
from rulemeter.operators import relational as R
from rulemeter.operators import stats as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("s", "want"), [("About 3.5 cm", 3.5), ("3/4", 3.0), ("none", None), ("-7 x", -7.0), ("", None), ("x -2", -2.0)])
def test_leading_number(spark, s, want):
    assert one(spark, T.leading_number(F.col("s")), s=s) == want


def test_numbers_drop_commas_and_fractions_guard_zero(spark):
    assert one(spark, T.numbers(F.col("s")), s="1,5 and -2.5 then 30%") == [15.0, -2.5, 30.0]
    assert one(spark, T.fraction(F.col("s")), s="3 / 4") == 0.75
    assert one(spark, T.fraction(F.col("s")), s="3/0") is None
    assert one(spark, T.option_number(F.col("s")), s="3/4") == 0.75


@pytest.mark.parametrize(("a", "b", "want"), [("A", " a ", True), ("1,000", "1000", True), ("0.5", "0.504", True), ("0.5", "0.51", False), ("1/2", "2/4", True), ("1/2", "x", False), ("", "0", True)])
def test_answers_match(spark, a, b, want):
    assert one(spark, T.answers_match(F.col("a"), F.col("b")), a=a, b=b) is want


def mulberry(seed, k):
    m = 0xFFFFFFFF
    a = (seed + k * 0x6D2B79F5) & m
    t = ((a ^ a >> 15) * (a | 1)) & m
    t ^= (t + ((t ^ t >> 7) * (t | 61) & m)) & m
    return (t ^ t >> 14) / 4294967296


def test_mulberry32_draws(spark):
    got = spark.range(1, 2000).select(rng.mulberry32(F.lit(42), F.col("id")).alias("x")).collect()
    assert [r.x for r in got] == [mulberry(42, k) for k in range(1, 2000)]


def test_bootstrap_equals_a_loop_and_ignores_partitions(spark):
    r = random.Random(3)
    data = [("g", i, float(r.random() < 0.3)) for i in range(57)] + [("h", i, 1.0) for i in range(9)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    for parts in (1, 5):
        got = {x.k: (x.n, round(x.lo, 9), round(x.hi, 9)) for x in S.bootstrap_ci(df.repartition(parts), ["k"], "v", ["i"], 100, 5).collect()}
        for k in "gh":
            vs = [v for g, _, v in data if g == k]
            n = len(vs)
            ms = sorted(sum(vs[math.floor(mulberry(5, b * n + i + 1) * n)] for i in range(n)) / n for b in range(100))
            assert got[k] == (n, round(ms[2], 9), round(ms[97], 9))


ITEM = "id string, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>"


def test_rules_over_items(spark):
    opts = lambda *t: [("ABCDE"[i], x) for i, x in enumerate(t)]
    items = spark.createDataFrame(
        [("1", "t", "k", "What is an", "A", opts("apple", "pear", "plum always", "fig")), ("2", "t", "k", "Take 84 zeds", "C", opts("4", "76", "84", "85")), ("3", "t", "k", None, "A", []), ("4", "t", "k", "s", "A", opts(None, "xx", "xx"))], ITEM
    )
    got = {(r.id, r.program): r.answer for r in I.answers(items).collect()}
    assert got["1", "longest-option"] == "C"
    assert got["1", "grammatical-fit-option"] == "A"
    assert got["1", "avoid-absolute-terms"] is None
    assert got["2", "option-repeating-stem-numbers"] == "C"
    assert got["2", "middle-value-option"] == "B"
    assert got["2", "position-c"] == "C"
    assert all(v is None for (i, _), v in got.items() if i == "3")
    assert got["4", "convergence-option"] is None
    scored = I.score(items, I.answers(items))
    assert scored.filter("skipped and correct is not null").count() == 0
    assert scored.count() == 4 * len(I.rules())
    told = {r.program: r for r in I.rule_chance(scored).collect()}
    assert told["option-repeating-stem-numbers"].n_correct == 1


def test_key_never_reaches_a_rule(spark):
    items = spark.createDataFrame([("1", "a", "c", "s", "B", [("A", "x"), ("B", "yy")])], ITEM)
    other = items.withColumn("key", F.lit("A"))
    assert I.answers(items).collect() == I.answers(other).collect()


def test_binomial_tail_and_holm(spark):
    assert S.upper_tail(90, 279, 0.25) == pytest.approx(0.00383, abs=5e-6)
    assert S.upper_tail(0, 5, 0.1) == 1.0 and S.upper_tail(6, 5, 0.5) == 0.0
    t = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.04), ("d", 0.001)], "t string, p double")
    assert {r.t: r.holm for r in S.holm(t, "p").collect()} == {"d": True, "a": True, "b": True, "c": True}
    t = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.04)], "t string, p double")
    assert {r.t: r.holm for r in S.holm(t, "p").collect()} == {"a": True, "b": False, "c": False}


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "c", 5), (2, "d", 1)], "k int, l string, s int")
    assert {r.k: r.answer for r in R.unique_argmax(df, ["k"], "l", "s").collect()} == {1: None, 2: "c"}
    assert R.page(df, [F.col("k"), F.col("l")], 0, 2).collect()[0].total == 4
    assert [r.l for r in R.page(df, [F.col("k"), F.col("l")], 2, 2).collect()] == ["c", "d"]
    near = R.nearest(spark.createDataFrame([(1, 9.9), (2, 50.0)], "i int, x double"), spark.createDataFrame([(7, 10.1), (8, 9.0)], "j int, y double"), [], "x", "y", 1.0, ["i"], "j")
    assert [(r.i, r.j) for r in near.collect()] == [(1, 7)]
