"""Columns that are worked out once for each row, and tables that are worked out once for several uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **parts: Column) -> DataFrame:
    """``df`` with the columns ``parts``, which take the place of those of the same name.

    They come out of a generator, which the optimizer doesn't look through: an expression that names them several times, or
    within a lambda, would otherwise hold as many copies of them."""
    told = F.explode(F.array(F.struct(*(c.alias(k) for k, c in parts.items())))).alias("_s")
    return df.select("*", told).select(*[c for c in df.columns if c not in parts], "_s.*")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the folder of spark.checkpoint.dir (one of our own where it is unset) and read again.

    A plan that names a table several times holds its whole plan as often, and works it out as often."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="rulemeter_")
    at = f"{top.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.parquet(at)
