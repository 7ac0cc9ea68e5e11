"""Roll-ups of scored trials: summaries by cell, baselines, marks, paired and laddered rates.

A scored trial is (id, authority, claim, program, answer, skipped, key, chance, correct). Every function gives one row for
each group that has rows; shares of nothing are null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import with_interval


def _share(ok: Column) -> Column:
    return F.avg(ok.cast("double"))


def applicable(trials: DataFrame, rules: DataFrame) -> DataFrame:
    """Trials of rules (program, applies_to) that apply to the item's response_type."""
    return trials.join(F.broadcast(rules), "program").filter(F.array_contains("applies_to", F.col("response_type"))).drop("applies_to")  # a catalog of rules


def channel_summary(scored: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, n, n_scored, n_correct, rate, chance, with_chance) of groups with ``least`` trials or more.

    An abstention counts as chance in with_chance, and not at all in rate and chance."""
    imputed = F.when(F.col("skipped"), F.col("chance")).otherwise(F.col("correct").cast("double"))
    t = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("correct").alias("n_scored"), F.count_if("correct").alias("n_correct"), _share(F.col("correct")).alias("rate"), F.avg(F.when(~F.col("skipped"), F.col("chance"))).alias("chance"), F.avg(imputed).alias("with_chance")
    )
    return t.filter(F.col("n") >= least)


def trial_marks(scored: DataFrame, rolled: DataFrame) -> DataFrame:
    """Each trial with its (authority, claim, program)'s pass rate, and whether that is above chance."""
    r = rolled.select("authority", "claim", "program", "pass_rate", F.col("chance").alias("mean_chance"))
    t = scored.select("id", "authority", "claim", "program", "answer", "correct").join(r, ["authority", "claim", "program"], "left")
    return t.withColumn("above_chance", F.coalesce(F.col("pass_rate") > F.col("mean_chance") + 1e-9, F.lit(False)))


def held_out(scored: DataFrame, held: Column) -> DataFrame:
    """By program over the rows that are held out: attempted, scored, skipped, correct, rate (null if none was scored)."""
    t = scored.filter(held).groupBy("program")
    return t.agg(F.count("*").alias("attempted"), F.count("correct").alias("scored"), F.count_if("skipped").alias("skipped"), F.count_if("correct").alias("correct"), _share(F.col("correct")).alias("rate"))


def modal_letters(keys: DataFrame, by: list[str]) -> DataFrame:
    """(by, letter, n, share): the most frequent key of a group, the smallest on a tie, and its share."""
    counts = keys.groupBy(*by, F.col("key").alias("letter")).agg(F.count("*").alias("c"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct("letter", "c"), F.struct(-F.col("c"), F.col("letter"))).alias("m"), F.sum("c").alias("all"))
    return best.select(*by, F.col("m.letter").alias("letter"), F.col("m.c").alias("n"), (F.col("m.c") / F.col("all")).alias("share"))


def modal_split(scored: DataFrame, modal: DataFrame, by: list[str]) -> DataFrame:
    """By program: correct picks of the group's modal letter and of other letters, and the rate over items of either kind."""
    t = scored.join(modal.select(*by, F.col("letter").alias("modal")), by)
    is_modal = F.col("key") == F.col("modal")
    return t.groupBy("program").agg(
        F.count_if(F.col("correct") & is_modal).alias("modal_correct"), F.count_if(F.col("correct") & ~is_modal).alias("other_correct"), F.avg(F.when(is_modal, F.col("correct").cast("double"))).alias("modal_rate"), F.avg(F.when(~is_modal, F.col("correct").cast("double"))).alias("other_rate")
    )


def enriched_cells(answered: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """By cell of ``least`` answered trials: n, n_correct, rate, chance, lo, hi, the modal key with its count and frequency, whether
    the interval lies above chance, above that frequency and above both (the double bar), and n, rate, chance, lo and hi of
    the trials whose key is another letter."""
    t = answered.filter("correct is not null")
    modal = modal_letters(t, by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("letter").alias("modal"), F.col("n").alias("modal_n"), F.col("share").alias("modal_share"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    t = t.join(modal, same).withColumn("_other", ~F.col("key").eqNullSafe(F.col("modal")))
    o = F.col("_other")
    rows = t.groupBy(*by, "modal", "modal_n", "modal_share").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), _share(F.col("correct")).alias("rate"), F.avg("chance").alias("chance"),
        F.count_if(o).alias("other_n"), F.count_if(o & F.col("correct")).alias("other_correct"), F.avg(F.when(o, F.col("correct").cast("double"))).alias("other_rate"), F.avg(F.when(o, F.col("chance"))).alias("other_chance"),
    ).filter(F.col("n") >= least)
    rows = with_interval(rows, "n", "n_correct").withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    rows = with_interval(rows, "other_n", "other_correct").withColumnsRenamed({"lo": "other_lo", "hi": "other_hi"}).withColumnsRenamed({"_lo": "lo", "_hi": "hi"})
    above = {"above_chance": F.col("lo") > F.col("chance"), "above_modal": F.col("lo") > F.col("modal_share")}
    return rows.withColumns(above).withColumn("double_bar", F.col("above_chance") & F.col("above_modal"))


def residual_items(items: DataFrame, cues: dict[str, DataFrame]) -> DataFrame:
    """(id): items (id, key) whose key none of the cues' answers (id, answer) is."""
    hit = None
    for t in cues.values():
        t = t.select("id", "answer").filter("answer is not null")
        hit = t if hit is None else hit.unionByName(t)
    right = items.select("id", F.lower(F.trim("key")).alias("_k")).join(hit, "id").filter(F.lower(F.trim("answer")) == F.col("_k"))
    return items.select("id").join(right.select("id"), "id", "left_anti")


def residual(scored: DataFrame, cues: list[str]) -> DataFrame:
    """(id): items whose key no cue program answers."""
    hit = F.max(F.coalesce(F.col("correct") & F.col("program").isin(cues), F.lit(False)).cast("int"))
    return scored.groupBy("id").agg(hit.alias("hit")).filter("hit = 0").select("id")


def paired(scored: DataFrame, a: str, b: str) -> DataFrame:
    """Of two programs over the items both answered: n, each one's rate, the mean difference, and the 2x2 counts."""
    one = lambda p, c: scored.filter((F.col("program") == p) & F.col("correct").isNotNull()).select("id", F.col("correct").alias(c))
    t = one(a, "x").join(one(b, "y").hint("merge"), "id")  # a stored table is larger than its files tell
    x, y = F.col("x"), F.col("y")
    return t.agg(
        F.count("*").alias("n"), _share(x).alias("rate_a"), _share(y).alias("rate_b"), F.avg(x.cast("double") - y.cast("double")).alias("difference"),
        F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"),
    )


def ladder(rungs: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rung, step, n, rate) of tables of one column ``ok`` (0 to 1), in the order given."""
    out = None
    for i, (name, t) in enumerate(rungs):
        row = t.agg(F.lit(name).alias("rung"), F.lit(i).alias("step"), F.count("ok").alias("n"), F.avg(F.col("ok").cast("double")).alias("rate"))
        out = row if out is None else out.unionByName(row)
    return out


def sign_counts(rates: DataFrame, rate: str, chance: str) -> DataFrame:
    """(above, below, n): groups above and below chance, ties dropped."""
    d = F.col(rate) - F.col(chance)
    return rates.agg(F.count_if(d > 1e-9).alias("above"), F.count_if(d < -1e-9).alias("below")).withColumn("n", F.col("above") + F.col("below"))


def programs_of(scored: DataFrame) -> DataFrame:
    """(id, n_programs, n_letters, programs): the programs that answered an item, and the distinct letters they chose."""
    t = scored.filter(~F.col("skipped")).groupBy("id")
    return t.agg(F.count_distinct("program").alias("n_programs"), F.count_distinct("answer").alias("n_letters"), F.array_join(F.sort_array(F.collect_set("program")), ",").alias("programs"))


def last_by_id(rows: DataFrame, id_: str, order: str) -> DataFrame:
    """The last row of each id in the order of the source."""
    return rows.groupBy(id_).agg(F.max_by(F.struct(*[c for c in rows.columns if c != id_]), order).alias("r")).select(id_, "r.*")


def arithmetic_runs(values: DataFrame, group: str, value: str, steps: tuple[int, ...] = (1, 2, 5, 10, 15), least: int = 4) -> DataFrame:
    """(group, start, step, n): maximal runs of distinct values with one of ``steps`` between neighbours, ``least`` or more long."""
    v = values.select(group, F.col(value).cast("long").alias("v")).distinct()
    w = W.partitionBy(group).orderBy("v")
    v = v.withColumn("d", F.lead("v").over(w) - F.col("v"))
    v = v.withColumn("new", F.coalesce((F.col("d") != F.lag("d").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = v.filter(F.col("d").isin(*steps)).groupBy(group, "run", F.col("d").alias("step")).agg(F.min("v").alias("start"), (F.count("*") + 1).alias("n"))
    return runs.filter(F.col("n") >= least).select(group, "start", "step", "n")
