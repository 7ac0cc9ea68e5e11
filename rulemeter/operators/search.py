"""Adaptive program search: the driver chooses the candidates of a step, one Spark job scores them all."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import MASK, STEP
from .items import apply_programs

Weights = dict[str, float]
#: Items that a program must answer for its rate to count.
LEAST_ANSWERS = 8


def name_of(weights: Weights) -> str:
    return "+".join(f"{f}*{w:g}" for f, w in sorted(weights.items()))


def enumerate_programs(features: list[str], k: int = 3, signs: tuple[float, ...] = (1.0, -1.0)) -> list[Weights]:
    """Single features, then signed sets of up to k whose first weight is positive."""
    out: list[Weights] = [{f: 1.0} for f in features]
    for size in range(2, k + 1):
        for names in combinations(features, size):
            out += [dict(zip(names, (1.0, *rest), strict=True)) for rest in product(signs, repeat=size - 1)]
    return out


def program_table(spark, programs: list[Weights]) -> DataFrame:
    """(program, feature, weight): made on the driver, a few thousand rows."""
    return spark.createDataFrame([(name_of(p), f, float(w)) for p in programs for f, w in p.items()], "program string, feature string, weight double")


def pass_rates(features: DataFrame, keys: DataFrame, programs: list[Weights]) -> dict[str, tuple[int, float]]:
    """Answers and pass rate of each program over keys (id, key), in one job; a row for each program reaches the driver."""
    told = apply_programs(features.join(keys.select("id", "key"), "id"), program_table(features.sparkSession, programs), ["key"]).filter("answer is not null")
    rows = told.groupBy("program").agg(F.count("*").alias("n"), F.avg((F.col("answer") == F.col("key")).cast("double")).alias("rate")).collect()
    return {r.program: (r.n, r.rate) for r in rows}


def _best(programs: list[Weights], rates: dict[str, tuple[int, float]]) -> tuple[Weights | None, float]:
    """The first program of the best rate among those with enough answers."""
    top: tuple[Weights | None, float] = (None, -1.0)
    for p in programs:
        n, rate = rates.get(name_of(p), (0, 0.0))
        if n >= LEAST_ANSWERS and rate > top[1]:
            top = p, rate
    return top


def greedy(features: DataFrame, keys: DataFrame, names: list[str], k: int = 3) -> tuple[Weights | None, float]:
    """Forward selection: in each of at most k jobs the signed feature that helps most is added; it ends when none helps."""
    chosen, best = None, -1.0
    for _ in range(k):
        tried = [(chosen or {}) | {f: w} for f in names if f not in (chosen or {}) for w in (1.0, -1.0)]
        found, rate = _best(tried, pass_rates(features, keys, tried))
        if found is None or rate <= best:
            break
        chosen, best = found, rate
    return chosen, best


class _Draws:
    """The counter-based draws one after another."""

    def __init__(self, seed: int) -> None:
        self.seed, self.k = seed, 0

    def next(self) -> float:
        self.k += 1
        a = (self.seed + self.k * STEP) & MASK
        t = (a ^ a >> 15) * (a | 1) & MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & MASK)) & MASK
        return (t ^ t >> 14) / 4294967296

    def choice(self, xs: list):
        return xs[int(self.next() * len(xs))]


def random_program(draws: _Draws, names: list[str], k: int) -> Weights:
    left, out = list(names), {}
    for _ in range(min(k, len(left))):
        out[left.pop(int(draws.next() * len(left)))] = draws.choice([1.0, -1.0])
    return out


def evolve(features: DataFrame, keys: DataFrame, names: list[str], seed: int = 5, size: int = 24, generations: int = 6, keep: int = 8, k: int = 3) -> tuple[Weights | None, float]:
    """Each generation is scored in one job; the best ``keep`` stay and the rest are their offspring with one weight changed."""
    draws = _Draws(seed)
    crowd, known = [random_program(draws, names, 1 + int(draws.next() * k)) for _ in range(size)], {}
    for _ in range(generations):
        new = [p for p in crowd if name_of(p) not in known]
        if new:
            known |= {name_of(p): (0, 0.0) for p in new} | pass_rates(features, keys, new)
        ranked = sorted(crowd, key=lambda p: (-known[name_of(p)][1] if known[name_of(p)][0] >= LEAST_ANSWERS else 1.0, name_of(p)))[:keep]
        crowd = list(ranked)
        while len(crowd) < size:
            child = dict(draws.choice(ranked))
            f = draws.choice(names)
            if f in child and len(child) > 1:
                del child[f]
            elif len(child) < k or f in child:
                child[f] = draws.choice([1.0, -1.0])
            crowd.append(child)
    every = {name_of(p): p for p in crowd if name_of(p) in known}
    return _best(list(every.values()), known)
