"""Benchmark decontamination by template canonicalisation, in native operators.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after a number turn into typed
placeholders, other words are lower-cased and stripped of punctuation. Windows of WINDOW template tokens are hashed and
joined with the benchmark's, so a question with other numbers or names still meets its original. A pair of a document
and an item counts as a leak when enough of the item's windows occur in the document and the slots agree: the values
that stand in one slot value's places must be the same throughout the document's copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
#: Words that a window must hold beside placeholders.
LITERALS = 4
#: Share of an item's windows that a leak holds, and the share of its slot values that agree.
COVERAGE, CONSISTENT = 0.3, 0.5
#: Benchmark windows up to which they are sent to every task; beyond, both sides are shuffled by the window's hash.
FEW_WINDOWS = 1_000_000
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years mph kph cent cents dollar dollars euro euros pound pounds percent degree degrees meter meters metre metres"
).split()
_EDGE = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026"
NUMBER, NAME, UNIT = "\u0001number", "\u0001name", "\u0001unit"


def _templates(df: DataFrame, key: str) -> DataFrame:
    """(key, _t): arrays of (kind, word), where kind is null but for placeholders; words without content are left out.

    No lambda reads a whole array: the optimizer moves expressions into one another, and would have such an array worked
    out again for every element. Each word stands beside the one before it instead."""
    raw = df.select(key, F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "").alias("_w"))
    bare = raw.select(key, "_w", F.transform("_w", lambda w: F.btrim(w, F.lit(_EDGE))).alias("_c"))
    start = F.array(F.lit(""))
    beside = F.arrays_zip(F.col("_c").alias("c"), F.concat(start, F.col("_c")).alias("p"), F.concat(start, F.col("_w")).alias("q"))

    def one(z: Column) -> Column:
        c, p, q = z["c"], z["p"], z["q"]
        number = lambda x: (x >= "0") & (x < ":")  # noqa: E731  by the first character
        first = F.substring(c, 1, 1)
        name = (q != "") & (F.lower(first) != first) & ~F.substring(q, -1, 1).isin(".", "!", "?", ":") & (F.length(c) > 1) & (F.upper(c) != c)
        unit = F.when(number(p), F.when(F.lower(c).isin(UNITS), F.lit(UNIT)))
        # most words begin with a small letter: they are neither numbers nor names
        kind = F.when((c >= "a") & (c < "{"), unit).when(number(c), F.lit(NUMBER)).when(name, F.lit(NAME)).otherwise(unit)
        return F.struct(kind.alias("kind"), F.lower(c).alias("word"))

    return bare.select(key, F.filter(F.transform(beside, one), lambda t: t["word"] != "").alias("_t"))


def _windows(templates: DataFrame, key: str, window: int, exact: bool = False) -> DataFrame:
    """(key, pos, hash): one row for each window of a text; ``exact`` takes the words of placeholders as they are."""
    t = templates.select(key, F.transform("_t", lambda x: F.xxhash64(x["word"] if exact else F.coalesce(x["kind"], x["word"]))).alias("_h"), F.size("_t").alias("n"))
    shifted = F.arrays_zip(*[F.slice(F.col("_h"), k + 1, F.greatest(F.col("n") - window + 1, F.lit(0))).alias(f"h{k}") for k in range(window)])
    return t.select(key, F.posexplode(F.transform(shifted, lambda w: F.xxhash64(w))).alias("pos", "hash"))


def _slots(templates: DataFrame, key: str) -> DataFrame:
    """(key, at, kind, value): one row for each placeholder of a text."""
    placed = F.filter(F.transform("_t", lambda t, i: F.struct(i.alias("at"), t["kind"].alias("kind"), t["word"].alias("value"))), lambda t: t["kind"].isNotNull())
    return templates.select(key, F.explode(placed).alias("t")).select(key, "t.at", "t.kind", "t.value")


def _word_for_word(ours: DataFrame, asked: DataFrame, window: int) -> DataFrame | None:
    """(doc_id, item_id) where a document holds all words of an item in a row, numbers and names as they are; None without items.

    An item is laid out in windows of ``window`` words, the last of them at its end, a shorter item in one of its own
    length; a document must hold them all from one start."""
    step = F.least(F.size("_t"), F.lit(window))
    item = F.struct("item_id", F.xxhash64(F.transform("_t", lambda x: x["word"])).alias("which"), F.size("_t").alias("n"))
    left = materialize(asked.filter(F.size("_t") > 0).select(item.alias("item"), step.alias("step"), "_t").dropDuplicates(["item"]))
    found = None
    for n in [r.step for r in left.select("step").distinct().collect()]:  # at most ``window`` of them
        pieces = _windows(left.filter(F.col("step") == n), "item", n, True).filter((F.col("pos") % n == 0) | (F.col("pos") == F.col("item.n") - n))
        pieces = materialize(pieces.select("item", F.col("pos").alias("at"), "hash", F.ceil(F.col("item.n") / n).alias("pieces")))
        near = F.broadcast if pieces.count() <= FEW_WINDOWS else lambda df: df
        hits = _windows(_templates(ours, "doc_id"), "doc_id", n, True).join(near(pieces), "hash")
        hits = hits.groupBy("doc_id", "item", "pieces", (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("held")).filter("held = pieces")
        hits = hits.select("doc_id", "item.item_id")
        found = hits if found is None else found.unionByName(hits)
    return found if found is None else found.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, slot_agreement) of the pairs that are leaks.

    item_windows counts the item's distinct windows with at least LITERALS words beside placeholders, n_windows those
    found in the document. An item without such a window (a short one, or one of names and numbers) is one window of its
    own length, which a leak holds word for word. Null and empty texts match nothing. Rows that share an id are taken together; null ids are left out. Empty tables give no rows. Columns
    other than the ids and texts are not read."""
    ours = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = materialize(_templates(benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id"))
    slots = materialize(_slots(asked, "item_id"))
    places = _windows(asked, "item_id", window)
    held = places.join(slots.select("item_id", "at"), "item_id", "left").withColumn("in", ((F.col("at") >= F.col("pos")) & (F.col("at") < F.col("pos") + window)).cast("int"))
    held = held.groupBy("item_id", "pos", "hash").agg(F.coalesce(F.sum("in"), F.lit(0)).alias("n_slots")).filter(F.col("n_slots") <= window - LITERALS)
    # equal windows of an item are one; its first place stands for it
    items = materialize(held.groupBy("item_id", "hash").agg(F.min("pos").alias("item_pos"), F.max("n_slots").alias("n_slots")))
    few = items.count() <= FEW_WINDOWS
    near = F.broadcast if few else lambda df: df
    hits = _windows(_templates(ours, "doc_id"), "doc_id", window).join(near(items), "hash")
    hits = materialize(hits.groupBy("doc_id", "item_id", "hash", "item_pos", "n_slots").agg(F.min("pos").alias("pos")))
    total = items.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    share = F.col("n_windows") / F.col("item_windows")
    found = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows")).join(near(total), "item_id").filter(share >= coverage)

    # which value of the document stands where the item has its own: only documents with such windows are read again
    wanted = hits.filter("n_slots > 0").join(near(slots), "item_id").filter((F.col("at") >= F.col("item_pos")) & (F.col("at") < F.col("item_pos") + window))
    wanted = materialize(wanted.select("doc_id", "item_id", "kind", F.col("value").alias("asked"), (F.col("pos") + F.col("at") - F.col("item_pos")).alias("at")).distinct())
    again = ours.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    told = wanted.join(_slots(_templates(again, "doc_id"), "doc_id").select("doc_id", "at", "value"), ["doc_id", "at"])
    agree = told.select("doc_id", "item_id", "kind", "asked", "value").distinct().groupBy("doc_id", "item_id", "kind", "asked").agg(F.count("*").alias("n"))
    agree = agree.groupBy("doc_id", "item_id").agg(F.avg((F.col("n") == 1).cast("double")).alias("slot_agreement"))
    result = found.join(agree, ["doc_id", "item_id"], "left").withColumn("slot_agreement", F.coalesce("slot_agreement", F.lit(1.0)))
    result = result.filter(F.col("slot_agreement") >= consistent).select("doc_id", "item_id", "n_windows", "item_windows", share.alias("coverage"), "slot_agreement")
    whole = _word_for_word(ours, asked.join(total.select("item_id"), "item_id", "left_anti"), window)
    if whole is None:
        return result
    one = F.lit(1).cast("long")
    return result.unionByName(whole.select("doc_id", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit(1.0).alias("coverage"), F.lit(1.0).alias("slot_agreement")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leak; null doc_ids stay."""
    return docs.join(materialize(leaks(docs, benchmark).select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
