"""Joins that make no pairs, and draws that no task gathers."""

import random

from rulemeter.operators import relational as R
from rulemeter.operators import stats as S


def by_pairs(left, right, reach):
    out = {}
    for i, g, x in left:
        near = [(abs(x - y), j) for j, h, y in right if g == h and x is not None and y is not None and abs(x - y) <= reach]
        if near:
            out[i] = min([min(near), *([out[i]] if i in out else [])])
    return {(i, *m) for i, m in out.items()}


def test_nearest_equals_all_pairs(spark):
    r = random.Random(8)
    value = lambda: r.choice([None, float(r.randint(-40, 40)), r.randint(-400, 400) / 10, 500.0, -10.0])
    left = [(r.randint(0, 250), r.choice("ab"), value()) for _ in range(300)]
    right = [(i, r.choice("abc"), value()) for i in range(120)]
    got = R.nearest(spark.createDataFrame(left, "i long, g string, x double"), spark.createDataFrame(right, "j long, g string, y double"), ["g"], "x", "y", 10.0, ["i"], "j")
    assert {tuple(t) for t in got.collect()} == by_pairs(left, right, 10.0)


def test_nearest_makes_no_pairs(spark):
    t = spark.range(20_000).selectExpr("id", "1 as g", "cast(id % 7 as double) as v")
    got = R.nearest(t.withColumnRenamed("v", "x"), t.selectExpr("id as j", "g", "v as y"), ["g"], "x", "y", 500.0, ["id"], "j")  # 4e8 pairs
    assert got.filter("distance = 0 and j = id % 7").count() == 20_000


def test_bootstrap_draws_in_all_tasks(spark):
    rows = spark.range(2000).selectExpr("'a' as g", "id", "cast(id % 3 = 0 as int) as v").coalesce(1)
    t = S.bootstrap_ci(rows, ["g"], "v", ["id"])
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan
    assert "_b" not in " ".join(line for line in plan.splitlines() if "SortMergeJoin" in line)
    (row,) = t.collect()
    assert row.n == 2000 and row.lo < row.rate < row.hi


def test_random_weights_shuffle_no_features(spark):
    from rulemeter.operators import fitted as M

    items = spark.range(50).selectExpr("id", "'of 12 red rings' as stem", "array(named_struct('letter', 'A', 'text', concat(id, ' red rings')), named_struct('letter', 'B', 'text', '12 bolts'), named_struct('letter', 'C', 'text', '')) as options")
    t = M.random_ngram(items, 7)
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    assert t.count() == 50
