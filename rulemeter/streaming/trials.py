"""The append-only trial log as a stream: each (item, program) once, however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import SCHEMAS


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as they arrive in a folder; lines without a key are left out."""
    rows = spark.readStream.schema(SCHEMAS["trial"]).json(path)
    return rows.filter("itemId is not null and programId is not null").withColumn("at", F.try_to_timestamp("timestamp"))


def first_trials(trials: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first delivery of each key; the state of keys is dropped once they are later than ``lateness``."""
    return trials.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["itemId", "programId"])


def rates(trials: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Scored and correct trials of each program by window of time."""
    return trials.withWatermark("at", lateness).groupBy(F.window("at", window), "programId").agg(F.count("correct").alias("n_scored"), F.count_if("correct").alias("n_correct"))


def write_log(trials: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet log exactly once; ``checkpoint`` is a folder that all executors share."""
    return trials.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
