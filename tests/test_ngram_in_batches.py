"""The n-gram model counted and scored in batches of items: no feature rows are shuffled, results as of the joined model."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rulemeter.operators import fitted as M

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


def _joined(model, items):
    """The model joined feature by feature, as a large one is."""
    held, M.FEATURES_HELD = M.FEATURES_HELD, 0
    try:
        return M.apply_ngram(model, items)
    finally:
        M.FEATURES_HELD = held


def test_model_in_every_task_scores_as_the_joined_one(items):
    model = M.train_ngram(items)
    rows = M.option_features(items, "id", "key").select(M._is_key().alias("hit"), F.explode("features").alias("feature"))
    want = rows.groupBy("feature").agg(F.count_if("hit").alias("in_key"), F.count_if(~F.col("hit")).alias("in_rest"))
    assert sorted(map(str, model.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, M.apply_ngram(model, items).collect())) == sorted(map(str, _joined(model, items).collect()))
    none = M.train_ngram(items.filter("false"))
    assert sorted(map(str, M.apply_ngram(none, items).collect())) == sorted(map(str, _joined(none, items).collect()))


def test_no_feature_row_is_shuffled(items):
    plan = M.apply_ngram(M.train_ngram(items), items)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_model_is_fitted_once(spark, items):
    told = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(stem):
        told.add(1)
        return stem

    M.apply_ngram(M.train_ngram(items.withColumn("stem", seen("stem"))), items).collect()
    assert told.value == items.count()
