"""The census: which operations of an item's claim a program without them could do without, and the roll-up by claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_claims(claims: DataFrame, order: str) -> DataFrame:
    """(authority, claim, operations): of claims that share an (authority, code) the first in the given order."""
    return claims.groupBy("authority", F.col("code").alias("claim")).agg(F.min_by("operations", order).alias("operations"))


def item_operations(items: DataFrame, claims: DataFrame, order: str | None = None) -> DataFrame:
    """(id, authority, claim, operation): the operations of an item's claim; an item whose claim is unknown or asks for
    nothing keeps a row with a null operation. Of claims that share an (authority, code) the first by ``order`` counts
    (by place, if they have it, else by their operations)."""
    order = order or ("place" if "place" in claims.columns else "operations")
    return items.join(first_claims(claims, order), ["authority", "claim"], "left").select("id", "authority", "claim", F.explode_outer("operations").alias("operation"))


def cells(items: DataFrame, claims: DataFrame, scored: DataFrame, eligible: DataFrame, programs: DataFrame) -> DataFrame:
    """(id, authority, claim, operation, value, witness, attempted), one row for each item and operation.

    A cell is 0, with the witness that comes first, if a correct trial of a program that is eligible in the item's claim
    lacks the operation; else 1. ``programs`` is (program, ord, lacks); attempted tells whether any trial was answered."""
    good = scored.filter("correct").join(eligible.select("authority", "claim", "program"), ["authority", "claim", "program"], "left_semi")
    found = good.join(F.broadcast(programs), "program").select("id", F.explode("lacks").alias("operation"), "program", "ord")  # a catalog of programs
    first = found.groupBy("id", "operation").agg(F.min_by("program", "ord").alias("witness"))
    tried = scored.groupBy("id").agg(F.max((~F.col("skipped")).cast("int")).alias("_tried"))
    t = item_operations(items, claims).filter("operation is not null").join(first.hint("merge"), ["id", "operation"], "left").join(tried.hint("merge"), "id", "left")
    return t.select("id", "authority", "claim", "operation", F.when(F.col("witness").isNull(), 1).otherwise(0).alias("value"), "witness", (F.coalesce("_tried", F.lit(0)) == 1).alias("attempted"))


def comparisons(items: DataFrame, told: DataFrame) -> DataFrame:
    """By (authority, claim): items, attempted items, bypassed share of attempted cells, witnesses, positive controls.

    A positive control is an attempted item of whose cells none was bypassed. The share is 0 where nothing was attempted."""
    by_item = told.groupBy("id").agg(F.count_if("attempted").alias("a"), F.count_if(F.col("attempted") & (F.col("value") == 0)).alias("z"), F.min("value").alias("low"))
    t = items.select("id", "authority", "claim").join(by_item.hint("merge"), "id", "left")
    share = F.coalesce(F.try_divide(F.sum("z"), F.sum("a")), F.lit(0.0))
    return t.groupBy("authority", "claim").agg(
        F.count("*").alias("n_items"), F.count_if(F.col("a") > 0).alias("n_attempted"), share.alias("bypass_rate"), F.coalesce(F.sum("z"), F.lit(0)).alias("n_witnesses"), F.count_if((F.col("low") == 1) & (F.col("a") > 0)).alias("n_positive")
    )
