import math
import random

from rulemeter.operators import strategies as S


def test_closure_takes_all_numbers_breaks_ties_and_knows_geometry(spark):
    items = [
        ("tie", "with 3 and 4", [("A", "12"), ("B", "7"), ("C", "1"), ("D", "99.5")]),
        ("even tie", "with 3 and 4", [("A", "12"), ("B", "7"), ("C", "99.5")]),
        ("seventh", "of 1, 2, 3, 4, 5, 6 and 1000", [("A", "1006"), ("B", "77.77")]),
        ("root", "a number 49", [("A", "7"), ("B", "5.5")]),
        ("triangle", "a triangle of 5 by 9", [("A", "22.5"), ("B", "77.77")]),
        ("no triangle", "a thing of 5 by 9", [("A", "22.5"), ("B", "77.77")]),
    ]
    df = spark.createDataFrame(items, "id string, stem string, options array<struct<letter:string,text:string>>")
    got = {r.id: (r.answer, r.depth) for r in S.closure_answers(df).collect()}
    assert got["tie"] == ("B", 1) and got["even tie"] == ("B", 1) and got["seventh"] == ("A", 1)
    assert got["root"] == ("A", 1) and got["triangle"] == ("A", 1) and got["no triangle"] != ("A", 1)


def by_loops(numbers, geometry):
    """Values and least depths of two steps, made by plain loops, without a bound."""
    depth = {round(x, 8): 0 for x in numbers}
    for d in (1, 2):
        have, made = list(depth), []
        for a in have:
            for b in have:
                made += [a + b, a - b, a * b]
                if abs(b) > 1e-12:
                    made.append(a / b)
                if d == 1 and geometry:
                    made.append(a * b / 2)
            if d == 1 and a >= 0:
                made.append(math.sqrt(a))
            if d == 1 and geometry:
                made.append(a * math.pi)
        for v in made:
            if abs(v) <= 1e12:
                depth.setdefault(round(v, 8), d)
    return depth


def test_closure_equals_plain_loops():
    r = random.Random(2)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            numbers = [r.choice([0.0, 1.0, -2.5, r.randint(-9, 99) * 1.0, r.random() * 10]) for _ in range(n)]
            for geometry in (False, True):
                want = by_loops(numbers, geometry)
                assert S.closure(numbers, most=10**7, geometry=geometry) == want
                few = S.closure(numbers, most=30, geometry=geometry)
                assert len(few) == min(len(want), max(30, len(set(round(x, 8) for x in numbers)))) and all(want[v] == d for v, d in few.items())


def test_depths_of_asked_values_equal_the_closure():
    r = random.Random(4)
    for n in (0, 1, 2, 3, 4, 6):
        for most in (10, 400, 4000):
            numbers = [r.choice([0.0, 1e12, -2.5, r.randint(-9, 99) * 1.0, r.random() * 1e7]) for _ in range(n)]
            for geometry in (False, True):
                for depth in (1, 2):
                    have = S.closure(numbers, depth, most, geometry)
                    some = r.sample(list(have), min(len(have), 40))
                    asked = some + [x + d for x in some for d in (1e-8, -1e-8, 3e-8, 0.5)] + [7.25, float("nan"), float("inf"), 3e12]
                    asked = [round(x, 8) for x in asked]
                    assert S.depths(numbers, asked, depth, most, geometry) == {x: have[x] for x in asked if x in have}


def test_a_small_file_is_worked_on_in_all_tasks(spark):
    from rulemeter.plans import channels, exam, transcripts

    at = "/root/testdata/sf0.001"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1
    for made in (exam.part_items, channels.part_problems, channels.part_systems, transcripts.transcripts):
        assert made(spark, at).rdd.getNumPartitions() == n


def test_a_filter_does_not_make_the_closure_twice(spark):
    from rulemeter.plans import exam

    t = S.closure_answers(exam.part_items(spark, "/root/testdata/sf0.001")).filter("answer is not null")
    assert t._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
