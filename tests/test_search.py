import random

from rulemeter.operators import search as S
from rulemeter.operators import stats


def data(spark):
    r = random.Random(2)
    feats, keys = [], []
    for i in range(60):
        best = r.choice("ABCD")
        for letter in "ABCD":
            feats.append((i, letter, int(letter == best), r.randint(0, 1), r.random()))
        keys.append((i, best if i % 10 else "A"))
    return spark.createDataFrame(feats, "id int, letter string, good int, noise int, level double").cache(), spark.createDataFrame(keys, "id int, key string")


def test_enumeration_counts():
    assert len(S.enumerate_programs(["a", "b", "c"], 3)) == 3 + 3 * 2 + 4
    assert len({S.name_of(p) for p in S.enumerate_programs(list("abcdefgh"), 3)}) == 8 + 28 * 2 + 56 * 4


def test_searches_find_the_planted_feature(spark):
    feats, keys = data(spark)
    names = ["good", "noise", "level"]
    rates = S.pass_rates(feats, keys, S.enumerate_programs(names, 2))
    assert rates["good*1"][0] == 60 and rates["good*1"][1] > 0.85
    found, rate = S.greedy(feats, keys, names)
    assert "good" in found and rate >= rates["good*1"][1]
    again = S.evolve(feats, keys, names, generations=2)
    assert again == S.evolve(feats, keys, names, generations=2) and "good" in again[0]


def test_sequential_bootstrap_equals_a_loop(spark):
    vs = [0.0, 1.0, 1.0, 0.0, 1.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(vs)], "k string, i int, v double")
    draw = random.Random(26).randrange
    means = sorted(sum(vs[draw(5)] for _ in range(5)) / 5 for _ in range(200))
    r = stats.sequential_bootstrap(df.repartition(3), ["k"], "v", ["i"], 200).first()
    assert (r.n, r.lo, r.hi) == (5, means[int(0.025 * 199)], means[int(0.975 * 199)])
