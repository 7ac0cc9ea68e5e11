"""Shared pieces of the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once; they bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows of a few numbers each that one task writes.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        import tempfile

        at = tempfile.mkdtemp(prefix="rulemeter_")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows of a few numbers each, in no more tasks than they need: a small table is few files."""
    return df.coalesce(rows // TASK_ROWS + 1)


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made of it, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
