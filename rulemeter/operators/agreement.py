"""Predictions made on blinded packets: scored, brought back to the items' own letters, and compared with another scorer's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letter(s: Column) -> Column:
    """The first character of an answer, upper case; null if it is blank."""
    return F.nullif(F.substring(F.upper(F.trim(s)), 1, 1), F.lit(""))


def blinded_scores(packets: DataFrame, predictions: DataFrame) -> DataFrame:
    """``packets`` (opaqueId, shuffledKey, ..) with predicted and correct, both null where no prediction came.

    Of predictions (opaqueId, predicted) that share an opaqueId the largest letter counts."""
    told = predictions.select("opaqueId", letter(F.col("predicted")).alias("predicted")).groupBy("opaqueId").agg(F.max("predicted").alias("predicted"))
    return packets.join(told, "opaqueId", "left").withColumn("correct", F.when(F.col("predicted").isNotNull(), F.col("predicted").eqNullSafe(letter(F.col("shuffledKey")))))


def score_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n_packets, n_scored, n_missing, n_correct, rate): predictions that never came are missing, not wrong."""
    return scored.groupBy(*by).agg(F.count("*").alias("n_packets"), F.count("correct").alias("n_scored"), F.count_if(F.col("correct").isNull()).alias("n_missing"), F.count_if("correct").alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("rate"))


def own_letter(letter_map: Column, shuffled: Column) -> Column:
    """The item's letter behind a shuffled one: the first whose image it is; null if there is none."""
    hits = F.filter(F.array_sort(F.map_entries(letter_map)), lambda e: letter(e["value"]) == shuffled)
    return letter(F.get(hits, F.lit(0))["key"])


def agreement(local: DataFrame, scored: DataFrame, maps: DataFrame) -> DataFrame:
    """One row of how two scorers of the same items agree: ``local`` (id, answer, correct), ``scored`` (id, predicted, correct)
    in shuffled letters, ``maps`` (id, letterMap: own to shuffled letter).

    Items that both scored overlap; letters are compared where the map leads back to one. Rates of nothing are null."""
    theirs = scored.filter("predicted is not null").select("id", "predicted", F.col("correct").alias("theirs"))
    t = local.select("id", letter(F.col("answer")).alias("answer"), F.coalesce("correct", F.lit(False)).alias("ours")).join(theirs, "id").join(maps.select("id", "letterMap"), "id", "left")
    t = t.withColumn("own", own_letter(F.col("letterMap"), F.col("predicted")))
    ours, theirs, same = F.col("ours"), F.coalesce("theirs", F.lit(False)), F.coalesce(F.col("own") == F.col("answer"), F.lit(False))
    share = lambda on: F.avg(on.cast("double"))
    return t.agg(
        F.count("*").alias("n_overlap"), share(ours == theirs).alias("correctness_agreement"), F.count("own").alias("n_letters"), F.count_if(F.col("own").isNull()).alias("n_unmapped"),
        F.try_divide(F.count_if(same & F.col("own").isNotNull()), F.count("own")).alias("letter_agreement"), share(ours & theirs).alias("both_correct"), share(ours).alias("our_rate"), share(theirs).alias("their_rate"),
    )
