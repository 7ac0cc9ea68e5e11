"""Answers of strategy channels, scored by cell: elimination by stem constraints, rates with p and bar, families of tests, and
the null of random tie-breaks.

Channel answers are (id, answer, chance), answer and chance null where the channel did not fire; items are (id, authority,
claim, stem, key, options)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rng import draws as draws_of
from ..functions.staging import once
from .stats import binomial_sf, holm, with_interval
from .strategies import lower_central

LEAST = 10

# fixed values: words of a stem that constrain its answer
HOW_MANY = r"(?i)\bhow many\b|\bnumber of\b"
PROBABILITY = r"(?i)\bprobability\b"
PERCENT = r"(?i)\bpercent(?:age)?\b|%"
LENGTH = r"(?i)\b(length|distance|area|volume|perimeter|height|width)\b"
INTERIOR_ANGLE = r"(?i)interior\s+angle|(?:\btriangle\b.*\bangle\b)|(?:\bangle\b.*\btriangle\b)"
ANGLE = r"(?i)\bangle\b|\bdegrees\b"
MEAN = r"(?i)\bmean\b|\bmedian\b"
# end of fixed values


def survivors(items: DataFrame) -> DataFrame:
    """(id, n_options, n_constraints, left): the options that no constraint of the stem rules out, as (letter, v).

    Counts are whole and not negative, probabilities within 0 and 1, percentages within 0 and 100, lengths positive, interior
    angles under 180 and others under 360 degrees, means and medians within the stem's numbers if it has two or more. An
    option that is no number stays."""
    stem = F.coalesce(F.col("stem"), F.lit(""))
    interior, numbers = stem.rlike(INTERIOR_ANGLE), T.stem_numbers(stem)
    asks = F.struct(
        stem.rlike(HOW_MANY).alias("count"), stem.rlike(PROBABILITY).alias("probability"), stem.rlike(PERCENT).alias("percent"), stem.rlike(LENGTH).alias("length"), interior.alias("interior"),
        (stem.rlike(ANGLE) & ~interior).alias("angle"), F.when(stem.rlike(MEAN), numbers).otherwise(F.array().cast("array<double>")).alias("data"),
    )
    o = F.transform(F.coalesce("options", F.array().cast("array<struct<letter:string,text:string>>")), lambda x: F.struct(x["letter"].alias("letter"), T.option_number(T.clean_number(x["text"])).alias("v")))
    t = items.select("id", F.explode(F.array(F.struct(asks.alias("c"), o.alias("o")))).alias("s")).select("id", "s.c", "s.o")
    c = F.col("c")
    mean = F.size(c["data"]) >= 2
    t = t.select("id", "c", F.explode(F.array(F.struct("o", F.array_min(c["data"]).alias("low"), F.array_max(c["data"]).alias("high")))).alias("s")).select("id", "c", "s.*")

    def allowed(v: Column) -> Column:
        rules = [
            (c["count"], (v >= 0) & (F.abs(v - F.rint(v)) < 1e-6)), (c["probability"], v.between(0.0, 1.0)), (c["percent"], v.between(0.0, 100.0)), (c["length"], v > 0),
            (c["interior"], (v > 0) & (v < 180)), (c["angle"], (v > 0) & (v < 360)), (mean, v.between(F.col("low"), F.col("high"))),
        ]
        out = F.lit(True)
        for on, ok in rules:
            out = out & (~on | ok)
        return v.isNull() | out

    n = sum((on.cast("int") for on in (c["count"], c["probability"], c["percent"], c["length"], c["interior"], c["angle"], mean)), F.lit(0))
    t = once(t, n_constraints=n, left=F.filter("o", lambda x: allowed(x["v"])))
    return t.select("id", F.size("o").alias("n_options"), "n_constraints", "left")


def elimination(items: DataFrame) -> DataFrame:
    """(id, answer, chance, n_options, n_constraints, n_left, letters): the only survivor; of several numbers the lower central
    one; else the first. Chance is 1 / survivors; both are null where none survives."""
    t = survivors(items)
    left, n = F.col("left"), F.size("left")
    numeric = F.forall(left, lambda x: x["v"].isNotNull())
    first = F.array_min(F.transform(left, lambda x: x["letter"]))
    answer = F.when(n == 1, first).when((n > 1) & numeric, lower_central(left)).when(n > 1, first)
    t = once(t, n_left=n, answer=answer, letters=F.transform(left, lambda x: x["letter"]))
    return t.select("id", "answer", F.try_divide(F.lit(1.0), "n_left").alias("chance"), "n_options", "n_constraints", "n_left", "letters")


def hub_channel(items: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, answer, chance) of hub answers; the chance of one option in all."""
    t = items.select("id", F.try_divide(F.lit(1.0), F.size("options")).alias("chance")).join(hubs.select("id", "answer"), "id")
    return t.select("id", "answer", F.when(F.col("answer").isNotNull(), F.col("chance")).alias("chance"))


def channel_rows(channels: dict[str, DataFrame], items: DataFrame, least: int = LEAST, alpha: float = 0.05) -> DataFrame:
    """A row for each channel and each cell (authority, claim) of ``least`` items, zeros where it answered nothing: n_items,
    n_scored, n_correct, rate, chance, coverage, lo, hi, p, clears, in_family, holm and bonferroni within the channel, and both
    over the channels' families pooled.

    p is the binomial tail of the right answers at the mean chance. A cell clears the bar if its interval lies above chance and
    ``least`` were answered; in a family are cells with so many answers and a chance above 0."""
    cell = ["authority", "claim"]
    judged = items.select("id", *cell, "key")
    cells = judged.groupBy(*cell).agg(F.count("*").alias("n_items")).filter(F.col("n_items") >= least)
    names = F.explode(F.array(*map(F.lit, channels)))
    every = cells.select(*cell, "n_items", names.alias("channel"))
    told = None
    for name, t in channels.items():
        t = t.filter("answer is not null and chance is not null").select("id", "answer", "chance", F.lit(name).alias("channel"))
        told = t if told is None else told.unionByName(t)
    ok = F.lower(F.trim("answer")) == F.lower(F.trim("key"))
    scored = told.join(judged, "id").groupBy("channel", *cell).agg(F.count("*").alias("n_scored"), F.count_if(ok).alias("n_correct"), F.avg("chance").alias("chance"))
    t = every.join(scored, ["channel", *cell], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_scored", "n_correct")} | {"chance": F.coalesce("chance", F.lit(0.0))})
    t = t.withColumn("rate", F.coalesce(F.try_divide("n_correct", "n_scored"), F.lit(0.0))).withColumn("coverage", F.col("n_scored") / F.col("n_items"))
    t = binomial_sf(with_interval(t), "n_correct", "n_scored", "chance").withColumn("p", F.when(F.col("n_correct") > 0, F.col("tail")).otherwise(1.0)).drop("tail")
    enough = (F.col("n_scored") >= least) & (F.col("chance") > 0)
    t = t.withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(0.0))}).withColumn("clears", enough & (F.col("lo") > F.col("chance"))).withColumn("in_family", enough)
    flags = lambda t, family: holm(t, "p", alpha, ["channel", *cell], family).drop("m", "rank")
    t = flags(t, ["in_family"]).withColumnsRenamed({"holm": "pooled_holm", "bonferroni": "pooled_bonferroni"})
    t = flags(t, ["channel", "in_family"])
    return t.withColumns({c: F.col(c) & F.col("in_family") for c in ("holm", "bonferroni", "pooled_holm", "pooled_bonferroni")})


def elimination_shares(told: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """By cell of ``least`` items: mean survivors, and the shares of items with one survivor, whose key survives, that had a
    constraint, and of which some but not all options went."""
    t = items.select("id", "authority", "claim", "key").join(told, "id")
    share = lambda on: F.avg(on.cast("double"))
    n, left = F.col("n_options"), F.col("n_left")
    key = F.exists("letters", lambda x: F.upper(x) == F.upper("key"))
    out = t.groupBy("authority", "claim").agg(F.count("*").alias("n_items"), F.avg("n_left").alias("mean_left"), share(left == 1).alias("one_left"), share(F.coalesce(key, F.lit(False))).alias("key_left"), share(F.col("n_constraints") > 0).alias("constrained"), share((left > 0) & (left < n)).alias("eliminated"))
    return out.filter(F.col("n_items") >= least)


def tie_null(rows: DataFrame, seed: int, n_draws: int = 1000) -> DataFrame:
    """(n, n_tied, rule_rate, expected_rate, lo, hi) of answered rows (number, key, answer, tied): the rate of the rule, and the rates
    of ``n_draws`` redraws in which each item with several tied letters takes one of them at random.

    Draw b of an item is the draw b * 2^21 + number of the generator, so that every task makes its own in one pass over its
    items; only counts by draw leave it. ``number`` is a long that tells items apart; lo and hi are the draws floor(.025 B) and floor(.975 B)."""
    same = lambda letter: F.coalesce(F.lower(letter) == F.lower(F.trim("key")), F.lit(False))
    tied = F.col("tied")
    rows = rows.filter("answer is not null").select(F.col("number").cast("long").alias("number"), same(F.col("answer")).alias("ok"), F.transform(tied, same).alias("hits"))
    kinds = {"n": -1, "n_tied": -2, "ok": -3, "sure": -4, "expected": -5}  # what is counted beside the draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, told, expected = np.zeros(n_draws, np.int64), dict.fromkeys(kinds, 0), 0.0
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                t = whole.slice(first, 4096)
                numbers, ok, hits = (t.column(i) for i in range(3))
                ok = ok.to_numpy(zero_copy_only=False).astype(bool)
                flat, sizes = hits.flatten().to_numpy(zero_copy_only=False).astype(bool), hits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts, several = np.cumsum(sizes) - sizes, sizes > 1
                right = np.concatenate(([0], np.cumsum(flat)))
                share = (right[starts + sizes] - right[starts])[several] / sizes[several]
                for k, v in (("n", len(ok)), ("n_tied", several.sum()), ("ok", ok.sum()), ("sure", (ok & ~several).sum())):
                    told[k] += int(v)
                expected += float(share.sum()) + float((ok & ~several).sum())
                numbers, starts, sizes = (v[several] for v in (numbers.to_numpy(zero_copy_only=False), starts, sizes))
                for b in range(n_draws):
                    counts[b] += np.count_nonzero(flat[starts + (draws_of(seed, b * (1 << 21) + numbers) * sizes).astype(np.int64)])
        b, c = [*kinds.values(), *range(n_draws)], [*told.values(), *counts.tolist()]
        yield pa.record_batch([pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array([expected if k == kinds["expected"] else 0.0 for k in b], pa.float64())], names=["b", "c", "x"])

    counted = rows.mapInArrow(run, "b long, c long, x double").groupBy("b").agg(F.sum("c").alias("c"), F.sum("x").alias("x"))
    one = lambda k, c="c": F.max(F.when(F.col("b") == kinds[k], F.col(c))).alias(k)
    t = counted.agg(one("n"), one("n_tied"), one("ok"), one("sure"), one("expected", "x"), F.array_sort(F.collect_list(F.when(F.col("b") >= 0, F.col("c")))).alias("r"))  # n_draws numbers
    bound = lambda q: (F.get("r", F.lit(min(n_draws - 1, int(q * n_draws)))) + F.col("sure")) / F.col("n")
    return t.filter("n > 0").select("n", "n_tied", (F.col("ok") / F.col("n")).alias("rule_rate"), (F.col("expected") / F.col("n")).alias("expected_rate"), bound(0.025).alias("lo"), bound(0.975).alias("hi"))
