"""Held-out figures of the toxicity score, as the README gives them: python -m rulemeter.llm.figures DIR."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table


def toxicity_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: held-out toxic and other documents, recall, false positives, and both of a count of two or more entries."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    entries = {e for e in bytes.fromhex(model["toxic"]).split(toxicity._GAP) if e}
    hits = F.udf(lambda t: sum((b" " + w + b" ")[: toxicity.PREFIX] in entries for w in toxicity.words_of(t or "")), "long")
    counted = docs.join(known, "doc_id").filter(toxicity.is_held_out()).select("doc_id", hits("text").alias("hits"))
    t = toxicity.score(docs, model).filter("held_out").join(known, "doc_id").join(counted, "doc_id")
    rate = lambda on, toxic: F.avg(F.when(F.col("toxic") == toxic, on.cast("double")))
    flagged, two = F.col("predicted") == 1, F.col("hits") >= 2
    return t.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("other"), rate(flagged, 1).alias("recall"), rate(flagged, 0).alias("false_positives"), rate(two, 1).alias("two_hit_recall"), rate(two, 0).alias("two_hit_false_positives"))


if __name__ == "__main__":
    toxicity_figures(SparkSession.builder.getOrCreate(), sys.argv[1]).show(truncate=False)
