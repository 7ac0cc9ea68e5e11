"""The rules over Arrow batches say what Spark's own patterns say, and know as few distinct texts as they are bound to."""

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import text as T
from rulemeter.operators import items as I
from rulemeter.operators import rules as R

ODD = ["", " ", "always", "²always", "alwaysé", "alĺ", "́all", "a-all", "Some mAy", "ſome", "most", "mostly", "-0 ", "-12.5x", "1,5", "--5", "é 3", "9" * 320, "İ 2 RED", "red ring", "x ", "_all", "٣all"]
STEMS = ["a", "an", "An  __", "is an __ ", "a é", "a İ", "an ", "an  ", "éa", "²an", "man", "a\n", "a _\u0085"]


def test_parts_of_texts_equal_spark(spark):
    t = spark.createDataFrame([(s,) for s in ODD], "s string")
    want = t.select("s", T.tokens(F.col("s")).alias("t"), T.leading_number(F.col("s")).alias("v"), F.col("s").rlike(T.ABSOLUTE).alias("a"), F.regexp_count("s", F.lit(T.HEDGE)).alias("h"), F.substring(F.trim("s"), 1, 1).alias("f")).collect()
    for w in want:
        got = R.Option("A", *R.option_parts(w.s))
        assert (list(got.tokens), got.value, got.absolute, got.hedges, got.first) == (w.t, w.v, w.a, w.h, w.f), ascii(w.s)


@pytest.mark.parametrize("article", ["an", "a"])
def test_articles_at_the_end_of_a_stem_equal_spark(spark, article):
    t = spark.createDataFrame([(s,) for s in STEMS], "s string")
    for w in t.select("s", F.trim("s").rlike(rf"(?i)\b{article}(\s+_+)?\s*$").alias("w")).collect():
        assert getattr(R.stem_parts(w.s), f"wants_{article}") == w.w, ascii(w.s)


def test_a_text_is_read_once_and_few_are_remembered(monkeypatch):
    monkeypatch.setattr(R, "REMEMBERED", 3)
    read = []
    get = R.remembered(lambda s: read.append(s) or len(s))
    assert [get(s) for s in ("a", "bb", "a", "ccc", "dddd", "a")] == [1, 2, 1, 3, 4, 1]
    assert read == ["a", "bb", "ccc", "dddd", "a"]


def test_only_the_named_rules_are_worked_out(spark, monkeypatch):
    monkeypatch.setitem(I.RULES, "position-c", None)  # would fail where it is called
    items = spark.createDataFrame([(1, "x", "c", "s", "A", [("A", "long one"), ("B", "b")])], "id long, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>")
    assert [tuple(r) for r in I.judged(items, ["longest-option"]).select("answer", "correct").collect()] == [("A", True)]
