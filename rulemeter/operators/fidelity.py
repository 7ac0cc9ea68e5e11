"""How faithful a transcription is to a text: token overlap as multisets, character ratio, verdict by thresholds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.array_intersect(left, right), F.lit(0), lambda acc, t: acc + F.least(times(left, t), times(right, t)))


def token_scores(left: Column, right: Column) -> Column:
    """Struct (precision, recall, f1): all 1 if both are empty, all 0 if one is."""
    l, r = tokens(left), tokens(right)
    n = overlap(l, r).cast("double")
    none, both = (F.size(l) == 0) & (F.size(r) == 0), (F.size(l) > 0) & (F.size(r) > 0)
    p, q = F.coalesce(F.try_divide(n, F.size(l)), F.lit(0.0)), F.coalesce(F.try_divide(n, F.size(r)), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * n, (F.size(l) + F.size(r)).cast("double")), F.lit(0.0))
    pick = lambda v: F.when(none, 1.0).when(both, v).otherwise(0.0)
    return F.struct(pick(p).alias("precision"), pick(q).alias("recall"), pick(f).alias("f1"))


@F.pandas_udf(T.DoubleType())
def character_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest matching blocks over both lengths, without regard to white space and case; levenshtein is another measure."""
    from difflib import SequenceMatcher

    def one(a: str | None, b: str | None) -> float:
        a, b = ("".join((x or "").lower().split()) for x in (a, b))
        if not a or not b:
            return float(a == b)
        return SequenceMatcher(None, a, b, autojunk=False).ratio()

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def verdicts(rows: DataFrame, stem_least: float = 0.9, option_least: float = 0.9) -> DataFrame:
    """Adds stem_f1, option_score (the worst option's) and verdict to rows (stem, stem_read, options, options_read).

    options are maps of letters. A letter that was not read scores 0; an item without options has score 1."""
    pairs = F.transform(F.map_entries("options"), lambda e: F.struct(e["value"].alias("a"), F.try_element_at("options_read", e["key"]).alias("b")))
    score = F.array_min(F.transform(pairs, lambda p: token_scores(p["a"], p["b"])["f1"]))
    t = rows.withColumn("stem_f1", token_scores(F.col("stem"), F.col("stem_read"))["f1"]).withColumn("option_score", F.coalesce(score, F.lit(1.0)))
    stem, option = F.col("stem_f1") >= stem_least, F.col("option_score") >= option_least
    return t.withColumn("verdict", F.when(stem & option, "faithful").when(option, "stem differs").when(stem, "options differ").otherwise("both differ"))


def calibrate(rows: DataFrame, grid: list[float], floor: float = 0.85) -> DataFrame:
    """(stem_least, option_least, agreement) of every grid point against ``judged`` (boolean), best first; the grid is small."""
    points = rows.sparkSession.createDataFrame([(a, b) for a in grid for b in grid], "stem_least double, option_least double")
    ok = (F.col("stem_f1") >= F.col("stem_least")) & (F.col("option_score") >= F.col("option_least"))
    told = verdicts(rows).crossJoin(F.broadcast(points)).groupBy("stem_least", "option_least").agg(F.avg((ok == F.col("judged")).cast("double")).alias("agreement"))
    return told.withColumn("meets_floor", F.col("agreement") >= floor).orderBy(F.desc("agreement"), F.desc("stem_least"), F.desc("option_least"))
