import math
import random

import pytest
from pyspark.sql import functions as F

from rulemeter.operators import items as I
from rulemeter.operators import programs as P
from rulemeter.operators import stats as S

NAMES = ["longest", "position_c", "overlap", "num_repeat", "no_absolute", "numeric_min", "numeric_med", "numeric_max", "specificity", "grammar_agree", "distinctive"]


def items(spark, n=40):
    r, words = random.Random(6), "red green blue ring bolt gear always about none 12 7 30".split()
    rows = []
    for i in range(n):
        options = [(x, " ".join(r.choices(words, k=r.randint(1, 4)))) for x in "ABCD"[: r.randint(2, 4)]]
        rows.append((i, "FOP"[i % 3], f"c{i % 2}", f"Pick {r.choice(words)} {r.choice(words)} with a", r.choice(options)[0].lower() if i % 5 else None, options if i else []))
    return spark.createDataFrame(rows, "id long, authority string, claim string, stem string, key string, options array<struct<letter:string,text:string>>")


def answer(program, options):
    """The rule written out, over (letter, features) of one item."""
    scores = {}
    for letter, f in options:
        vals = [f[x] for x in program.weights]
        scores[letter] = (sum(vals) if min(vals) > 0 else 0) if program.kind == "and" else sum(w * f[x] for x, w in program.weights.items())
    best = max(scores.values())
    winners = sorted(k for k, s in scores.items() if s == best)
    if program.kind == "random":
        return winners[0]
    return winners[0] if len(winners) == 1 and best > 0 else None


def test_the_space_has_1562_programs():
    programs = P.enumerate_programs(NAMES)
    assert len(programs) == len({p.id for p in programs}) == 1562
    assert [sum(p.kind == k for p in programs) for k in ("atom", "and", "w")] == [11, 55, 1496]
    assert P.enumerate_programs(["a", "b"])[2:] == [("search/and:a+b", "and", {"a": 1, "b": 1}), ("search/w:a-1", "w", {"a": -1}), ("search/w:b-1", "w", {"b": -1}), ("search/w:a-1,b-1", "w", {"a": -1, "b": -1}), ("search/w:a-1,b+1", "w", {"a": -1, "b": 1}), ("search/w:a+1,b-1", "w", {"a": 1, "b": -1})]


def test_tally_equals_the_rule_written_out(spark):
    arrays = I.feature_arrays(items(spark), ["red", "about"], ["authority", "key"])
    programs = P.enumerate_programs(NAMES, 2) + P.random_programs(NAMES, 3, each=10)
    want = {}
    for row in arrays.collect():
        options = [(x.letter, {f: round(x[f] * 1e6) for f in NAMES}) for x in row.features]
        for p in programs if options else []:
            if (a := answer(p, options)) is not None:
                n, ok, chance = want.get((row.authority, p.id), (0, 0, 0.0))
                want[row.authority, p.id] = n + 1, ok + (row.key is not None and a.lower() == row.key), chance + 1 / len(options)
    got = {(r.authority, r.program): (r.n, r.ok, r.chance) for r in P.tally(arrays.repartition(3), programs, ["authority"]).collect()}
    assert set(got) == set(want)
    for k, (n, ok, chance) in want.items():
        assert got[k][:2] == (n, ok) and got[k][2] == pytest.approx(chance)
    assert P.tally(arrays.filter("false"), programs, ["authority"]).count() == 0


def test_ids_are_parsed_back(spark):
    programs = P.enumerate_programs(NAMES)
    t = spark.createDataFrame([(p.id + "/there",) for p in programs] + [("search/greedy:a+b+c",), ("search/w:a1",), ("longest-option",), (None,)], "program string")
    got = {r.program: (r.kind, r.weights) for r in P.parse_ids(t).collect()}
    assert all(got[p.id + "/there"] == (p.kind, p.weights) for p in programs)
    assert got["search/greedy:a+b+c"] == ("greedy", {"a": 1.0, "b": 1.0, "c": 1.0})
    assert got["search/w:a1"] == got["longest-option"] == got[None] == (None, None)


def test_random_programs_are_drawn_alike():
    a, b = P.random_programs(NAMES, 9), P.random_programs(NAMES, 9)
    assert a == b != P.random_programs(NAMES, 10) and len(a) == 120 and [p.k for p in a] == [1] * 40 + [2] * 40 + [3] * 40


def test_searches_find_a_planted_feature(spark):
    t = items(spark, 60).select("id", "authority", "claim", "stem", F.array_max(F.transform(F.col("options"), lambda x: F.struct(F.length(x["text"]), x["letter"])))["letter"].alias("key"), "options")
    arrays = I.feature_arrays(t, [], ["key"])
    selected, randoms = P.fit_search(arrays, NAMES, 5)
    assert len(selected) == 14 and len(randoms) == 120 and selected[-2].kind == "greedy" and selected[-1].kind == "evo"
    assert all("longest" in p.id for p in selected[:1]) and "longest" in selected[-2].weights
    assert P.fit_search(arrays, NAMES, 5) == (selected, randoms)
    rates = P.rates_of(arrays)
    assert rates(selected[:1])[selected[0].id][1] == 1.0


def test_order_statistics(spark):
    v = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: x.cast("double"))
    r = spark.range(1).select(P.rank_value(v, 0.95).alias("a"), P.rank_value(v, 0.95, False).alias("b"), P.rank_value(F.array(F.lit(3.0)), 0.95).alias("c"), P.rank_value(F.array(F.lit(3.0)), 0.95, False).alias("d")).first()
    assert tuple(r) == (38.0, 39.0, 3.0, 3.0)


def test_intervals_are_binomial_quantiles(spark):
    rows = [(20, 7), (1, 1), (5, 0), (300, 120), (0, 0)]
    got = {(r.n_scored, r.n_correct): (r.lo, r.hi) for r in S.with_interval(spark.createDataFrame(rows, "n_scored long, n_correct long")).collect()}
    for n, c in rows[:4]:
        cum, want = 0.0, []
        for k in range(n + 1):
            cum += math.comb(n, k) * (c / n) ** k * (1 - c / n) ** (n - k)
            want.append(cum)
        lo, hi = (next(k for k, p in enumerate(want) if p >= q) / n for q in (0.025, 0.975))
        assert got[n, c] == pytest.approx((lo, hi))
    assert got[0, 0] == (None, None)


def test_eligibility(spark):
    cols = "claim string, direction string, program string, n_scored long, n_correct long, chance double"
    rates = [
        ("x", None, "longest-option", 100, 60, 0.25), ("x", None, "position-c", 100, 27, 0.25), ("x", None, "lucky", 9, 9, 0.25),
        ("x", "d", "search/atom:a", 100, 60, 0.25), ("x", "d", "search/and:a+b", 100, 60, 0.25), ("x", "d", "search/random:k1:3", 100, 99, 0.25), ("y", "d", "search/atom:a", 100, 99, 0.25),
    ]
    randoms = [("x", "d", f"search/random:k1:{i}", 100, 40 + i) for i in range(20)] + [("x", "d", f"search/random:k2:{i}", 100, 50 + i) for i in range(20)] + [("y", "d", "search/random:k1:0", 7, 1)]
    got = P.eligibility(spark.createDataFrame(rates, cols), spark.createDataFrame(randoms, "claim string, direction string, program string, n long, ok long"), ["claim"]).collect()
    got = {(r.claim, r.program): (r.note, r.p95) for r in got}
    assert got == {
        ("x", "longest-option"): ("eligible", 0.0), ("x", "position-c"): ("does not beat chance", 0.0), ("x", "lucky"): ("too few", 0.0), ("x", "search/atom:a"): ("eligible", 0.58),
        ("x", "search/and:a+b"): ("below random p95", 0.68), ("x", "search/random:k1:3"): ("random baseline", 0.58), ("y", "search/atom:a"): ("below random p95", 1.0),
    }
