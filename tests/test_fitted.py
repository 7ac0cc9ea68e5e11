import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import rng
from rulemeter.operators import fitted as M

SCHEMA = "id long, authority string, stem string, key string, options array<struct<letter:string,text:string>>"


def rows(n=30):
    r, words = random.Random(8), "the ring Bolt gears of 12 7.5 never an é-plan".split()
    out = []
    for i in range(n):
        options = [(x, " ".join(r.choices(words, k=r.randint(0, 30))) if r.random() < 0.9 else None) for x in "ABCDE"[: r.randint(1, 5)]]
        out.append((i, "FO"[i % 2], " ".join(r.choices(words, k=6)) if i % 7 else None, r.choice(options)[0].lower(), options))
    return out + [(n, "F", "no options", "A", []), (n + 1, "F", "null options", "A", None), (n + 2, "O", "7 rings", None, [("A", "rings 7"), ("B", "rings 7")])]


def tokens(s, least):
    return [t for t in re.split("[^a-z0-9]+", (s or "").lower()) if len(t) >= max(2, least)]


def leading(s):
    m = re.match(r"^[^0-9-]*(-?[0-9]+(?:\.[0-9]+)?)", (s or "").strip())
    return float(m[1]) if m else None


def features(item, letter):
    """The rule written out, for one option."""
    _, _, stem, _, options = item
    text, stem_words, out = dict(options)[letter] or "", set(tokens(stem, 3)), []
    for t in tokens(text, 3):
        out += [f"o:{t}", f"ov:{t}"] if t in stem_words else [f"o:{t}"]
    c = re.sub("[^a-z0-9]+", " ", text.lower())
    out += [f"c3:{c[i : i + 3]}" for i in range(min(60, max(0, len(c) - 2)))]
    lengths, values = [len(t or "") for _, t in options], sorted(v for _, t in options if (v := leading(t)) is not None)
    if len(text) == max(lengths):
        out.append("cue:longest")
    if len(values) >= 3 and leading(text) == values[(len(values) - 1) // 2]:
        out.append("cue:middle")
    if any(n in text for n in re.findall(r"-?[0-9]+(?:[.,][0-9]+)?", stem or "")):
        out.append("cue:numrepeat")
    return [*out, f"pos:{letter}", f"len:{min(8, len(text) // 12)}"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


def best(scores):
    return min(scores, key=lambda k: (-scores[k], k))


def test_features(items):
    got = {(r.id, r.letter): r.features for r in M.option_features(items, "id").collect()}
    want = {(i[0], x): features(i, x) for i in rows() for x, _ in i[4] or []}
    assert got == want


def test_ngram(items):
    k, d = Counter(), Counter()
    train, judge = [i for i in rows() if i[1] == "O"], [i for i in rows() if i[1] == "F" and i[4]]
    for i in train:
        for x, _ in i[4] or []:
            (k if i[3] and x == i[3].upper() else d).update(features(i, x))
    model = M.train_ngram(items.filter("authority = 'O'"))
    assert {r.feature: (r.in_key, r.in_rest) for r in model.collect()} == {f: (k[f], d[f]) for f in k | d}
    v = len(set(k) | set(d)) + 1
    w = lambda f: round(1e9 * (math.log((k[f] + 1) / (k.total() + v)) - math.log((d[f] + 1) / (d.total() + v))))
    want = {i[0]: best({x: sum(map(w, features(i, x))) for x, _ in i[4]}) for i in judge}
    assert {r.id: r.answer for r in M.apply_ngram(model, items.filter("authority = 'F'")).collect()} == want


def test_random_weights_are_drawn_by_first_appearance(spark, items):
    draws = [r.x for r in spark.range(1, 900).select(rng.mulberry32(F.lit(5), F.col("id")).alias("x")).orderBy("id").collect()]
    want = {}
    for i in rows():
        weights, scores = {}, {}
        for x, _ in i[4] or []:
            fs = features(i, x)
            for f in fs:
                weights.setdefault(f, round(1e9 * (draws[len(weights)] * 2 - 1)))
            scores[x] = sum(weights[f] for f in fs)
        if scores:
            want[i[0]] = best(scores)
    assert {r.id: r.answer for r in M.random_ngram(items, 5).collect()} == want


def test_overlap(items):
    k, d = Counter(), Counter()
    for i in rows():
        for x, t in i[4] or []:
            if i[1] == "O":
                (k if i[3] and x == i[3].upper() else d).update(set(tokens(i[2], 3)) & set(tokens(t, 3)))
    w = {t: round(1e9 * math.log((k[t] + 1) / (d[t] + 1))) for t in k | d}
    model = M.train_overlap(items.filter("authority = 'O'"))
    assert {r.token: r.w for r in model.collect()} == w
    want = {}
    for i in rows():
        scores = {x: sum(w.get(s, 0) for s in tokens(i[2], 3) if s in tokens(t, 3)) for x, t in i[4] or []}
        if scores:
            want[i[0]] = best(scores) if max(scores.values()) > 0 else None
    assert {r.id: r.answer for r in M.apply_overlap(model, items).collect()} == want


def test_formulas(spark):
    data = [(1, "What is 20% of 50?", "10"), (2, "20 and 50", "1000"), (3, "8 by 2 by 3", "48"), (4, "no numbers", "1"), (5, None, "1"), (6, "7", "49"), (7, "3 into 0", "0"), (8, "1 over 3", "0.33333333")]
    t = M.formula_trials(spark.createDataFrame(data, "id long, stem string, key string"))
    got = {(r.id, r.formula): (r.answer, r.correct) for r in t.collect()}
    assert got[1, "percent-of"] == ("10", True) and got[1, "percent-up"] == ("60", False) and got[2, "mul-ab"] == ("1000", True) and got[3, "mul-abc"] == ("48", True)
    assert got[6, "square"] == ("49", True) and (7, "div-a-b") not in got and got[7, "div-b-a"] == ("0", True) and got[8, "div-a-b"] == ("0.33333333", True)
    assert {i for i, _ in got} == {1, 2, 3, 6, 7, 8} and len([f for i, f in got if i == 6]) == 1
    assert M.train_formula(t).first().asDict() == {"formula": "div-b-a", "hits": 1} or M.train_formula(t).first().hits == max(Counter(f for (_, f), (_, ok) in got.items() if ok).values())
    assert M.train_formula(t.filter("false")).count() == 0


def test_numbers_as_text(spark):
    vs = [(2.0, "2"), (0.5, "0.5"), (1 / 3, "0.33333333"), (-7.0, "-7"), (123456.789123, "123456.79"), (0.0, "0")]
    got = spark.createDataFrame(vs, "v double, s string").select(M.format_number(F.col("v")).alias("g"), "s").collect()
    assert [float(r.g) for r in got] == [float(r.s) for r in got] and [r.g for r in got] == [r.s for r in got]


def test_ladder_notes(spark):
    trials = [("p", "x", i, "A" if i < 30 else "B", False, i < 30, 0.25) for i in range(40)] + [("q", "x", i, None, True, None, 0.25) for i in range(4)] + [("r", "x", i, "A", False, i < 1, 0.25) for i in range(4)] + [("s", "x", i, "A", False, True, 0.25) for i in range(3)]
    t = spark.createDataFrame(trials, "program string, side string, id long, answer string, skipped boolean, correct boolean, chance double")
    rungs = spark.createDataFrame([(i, p, "t", 9, "x", r) for i, (p, r) in enumerate([("p", "r"), ("q", None), ("r", None), ("s", "nobody"), ("never", "r")])], "step int, program string, train_slice string, n_train long, slice string, random_program string")
    got = {r.program: r for r in M.held_out_ladder(t, {"x": F.col("side") == "x", "y": F.lit(False)}, rungs).collect()}
    assert {p: r.note for p, r in got.items()} == {"p": "beats chance", "q": "abstained on all", "r": "does not beat chance", "s": "beats chance, too few", "never": "no trials"}
    assert (got["p"].pass_rate, got["p"].random_baseline, got["s"].random_baseline, got["q"].skipped) == (0.75, 0.25, 0.25, 4)
