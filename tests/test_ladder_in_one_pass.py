"""The programs of the ladder answer in one pass as each does by itself, and nothing is joined for them."""

from __future__ import annotations

import random

import pytest

from rulemeter.operators import fitted as M

SCHEMA = "id long, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>"


@pytest.fixture
def items(spark):
    r = random.Random(11)
    words = "red ring gear bolt small blue é ſo 12 7 3.5 an of".split()
    text = lambda: None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randint(0, 6)))
    rows = [(i, "OF"[i % 2], "c", text(), r.choice([None, "A", "b", "C"]), None if i % 17 == 0 else [(x, text()) for x in r.choice(["ABCD", "AB", "", "AAB", "BCA"])]) for i in range(200)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _apart(train, judged):
    told = {"fitted-ngram": M.apply_ngram(M.train_ngram(train), judged), "fitted-overlap": M.apply_overlap(M.train_overlap(train), judged), "random-ngram": M.random_ngram(judged, 9)}
    return {(r.id, r.program): r.asDict() for name, t in told.items() for r in M.fitted_trials(f"{name}/d", t, judged).collect()}


@pytest.mark.parametrize("held", [M.FEATURES_HELD, 0])
def test_trials_are_those_of_each_program(items, monkeypatch, held):
    train, judged = items.filter("authority = 'O'"), items.filter("authority = 'F'")
    want = _apart(train, judged)
    monkeypatch.setattr(M, "FEATURES_HELD", held)
    got = M.all_trials(train, judged, 9, "d").collect()
    assert len(got) == len(want) > 200
    assert {(r.id, r.program): r.asDict() for r in got} == want


def test_nothing_is_joined_or_shuffled(items):
    plan = M.all_trials(items.filter("id < 100"), items.filter("id >= 100"), 9, "d")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_trials_are_counted_once(spark):
    from pyspark.sql import functions as F

    met = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: met.add(1) or x, "string")
    trials = spark.range(40).select("id", seen(F.lit("p/d")).alias("program"), F.lit("A").alias("answer"), F.lit(False).alias("skipped"), (F.col("id") % 2 == 0).alias("correct"), F.lit(0.25).alias("chance"))
    rungs = spark.createDataFrame([(0, "p/d", "d", 5, "all", "p/d")], "step int, program string, train_slice string, n_train long, slice string, random_program string")
    (row,) = M.held_out_ladder(trials, {"all": F.lit(True)}, rungs).collect()
    assert (row.n_scored, row.n_correct, row.random_baseline) == (40, 20, 0.5) and met.value == 40
