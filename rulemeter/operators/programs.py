"""Cue programs: enumeration, conjunctions, random programs, fitted selection, and roll-ups against a random null.

A program weighs the features of an option; an item's answer is the option of the only positive best score. A driver-made
catalog of a few thousand programs goes to every task as a matrix, items keep their options as arrays, and only counts by
group and program leave a task: neither options nor trials are shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .items import FEATURES
from .search import LEAST_ANSWERS, _Draws
from .stats import with_interval

#: Features of a program at most; programs that the fit selects by rate; random programs for each number of features.
CAP, SELECTED, RANDOMS = 3, 12, 40
#: Answers below which a pass is logged and not claimed.
LEAST_WITNESS = 10
#: Cells (item, program) that a task works on at once, and groups whose counts it holds.
CELLS, GROUPS = 1_000_000, 256


class Program(NamedTuple):
    """``kind``: atom, and, w (weighted), greedy, evo or random; an ``and`` scores 0 unless all its features are positive,
    a ``random`` one takes the first of equal best options, of whatever score."""

    id: str
    kind: str
    weights: dict[str, float]

    @property
    def k(self) -> int:
        return len(self.weights)


def enumerate_programs(features: list[str], cap: int = CAP) -> list[Program]:
    """Every feature, every pair as a conjunction, then all signed sets of up to ``cap`` that neither of those is."""
    out = [Program(f"search/atom:{f}", "atom", {f: 1.0}) for f in features]
    out += [Program(f"search/and:{a}+{b}", "and", {a: 1.0, b: 1.0}) for a, b in combinations(features, 2)]
    for k in range(1, cap + 1):
        for names in combinations(features, k):
            for signs in product((-1.0, 1.0), repeat=k):
                if k > 2 or min(signs) < 0:
                    out.append(Program("search/w:" + ",".join(f"{f}{int(s):+d}" for f, s in zip(names, signs, strict=True)), "w", dict(zip(names, signs, strict=True))))
    return out


def parse_ids(programs: DataFrame, id_: str = "program") -> DataFrame:
    """Adds kind and weights (map of feature to weight) as a program's id tells them; null for ids of other forms.

    The forms are search/atom:f, search/and:a+b, search/greedy:a+b.. and search/w:a+1,b-1.., each with /direction or not."""
    body = F.split(F.regexp_replace(id_, "^search/", ""), "/")[0]
    kind = F.regexp_extract(body, "^(atom|and|greedy|w):", 1)
    rest = F.regexp_replace(body, "^[a-z]+:", "")
    signed = F.transform(F.split(rest, ","), lambda t: F.struct(F.regexp_extract(t, r"^([A-Za-z_]+)[+-]\d+$", 1), F.regexp_extract(t, r"([+-]\d+)$", 1).try_cast("double")))
    plain = F.transform(F.split(rest, r"\+"), lambda t: F.struct(t, F.lit(1.0)))
    weights = F.when(kind == "w", F.when(rest.rlike(r"^([A-Za-z_]+[+-]\d+)(,[A-Za-z_]+[+-]\d+)*$"), F.map_from_entries(signed))).when(kind != "", F.map_from_entries(plain))
    return programs.withColumn("kind", F.when(weights.isNotNull(), kind)).withColumn("weights", weights)


def random_programs(features: list[str], seed: int, each: int = RANDOMS, cap: int = CAP) -> list[Program]:
    """``each`` programs of every number of features, drawn one after another."""
    draws = _Draws(seed)
    return [_random(draws, features, k, 1000 * k + i) for k in range(1, cap + 1) for i in range(each)]


def _random(draws: _Draws, features: list[str], k: int, number: int) -> Program:
    left, names = list(features), []
    for _ in range(min(k, len(left))):
        names.append(left.pop(int(draws.next() * len(left))))
    return Program(f"search/random:k{k}:{number}", "random", {f: -1.0 if draws.next() < 0.5 else 1.0 for f in names})


def tally(arrays: DataFrame, programs: list[Program], by: list[str]) -> DataFrame:
    """(by.., program, n, ok, chance): by group and program the items it answers, those it answers rightly, and the sum over
    the answered ones of 1 / options.

    ``arrays`` has by.., key and features (items.feature_arrays), or is a table of items.patterns. Items without options are answered
    by none. Features count in millionths, so that sums are exact and ties are ties."""
    if "features" in arrays.columns:
        names = [f.name for f in arrays.schema["features"].dataType.elementType.fields if f.name != "letter"]
        letter = F.transform("features", lambda x: F.lower(F.trim(x["letter"])) == F.lower(F.trim("key")))
        x = F.flatten(F.transform("features", lambda x: F.array(*(F.coalesce(F.rint(x[c] * 1e6), F.lit(0.0)) for c in names)))).cast("array<long>")
        arrays = arrays.filter(F.size("features") > 0).withColumns({"hits": F.transform(letter, lambda b: F.coalesce(b, F.lit(False))), "x": x, "items": F.lit(1).cast("long")})
    else:
        names = list(FEATURES)
    weights = np.zeros((len(names), len(programs)))
    for j, p in enumerate(programs):
        for f, w in p.weights.items():
            weights[names.index(f), j] = w
    both = [(j, [names.index(f) for f in p.weights]) for j, p in enumerate(programs) if p.kind == "and"]
    loose = np.array([j for j, p in enumerate(programs) if p.kind == "random"], np.int64)
    ids, step = [p.id for p in programs], max(16, CELLS // (4 * max(1, len(programs))))
    fields = [T.StructField(c, arrays.schema[c].dataType) for c in by]
    schema = T.StructType([*fields, T.StructField("program", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ok", T.LongType()), T.StructField("chance", T.DoubleType())])
    held = arrays.select(*by, "hits", "x", "items")

    def told(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for group, s in sums.items():
            on = np.flatnonzero(s[0])
            cols = [pa.array([v] * len(on)) if v is not None else pa.nulls(len(on)) for v in group]
            kinds = [f.dataType for f in fields]
            cols = [c.cast(_arrow(k)) for c, k in zip(cols, kinds, strict=True)]
            yield pa.record_batch([*cols, pa.array([ids[j] for j in on], pa.string()), pa.array(s[0][on].astype(np.int64)), pa.array(s[1][on].astype(np.int64)), pa.array(s[2][on])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            hits, xs, counts = (b.column(len(by) + i) for i in range(3))
            sizes, counts = np.asarray(hits.value_lengths()).astype(np.int64), np.asarray(counts)
            hit, values = hits.flatten().to_numpy(zero_copy_only=False).astype(bool), np.asarray(xs.flatten()).reshape(-1, len(names))
            groups, whose = {}, np.zeros(b.num_rows, np.int64)
            for i, g in enumerate(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True) if by else ()):
                whose[i] = groups.setdefault(g, len(groups))
            groups, starts = list(groups) if by else [()], np.cumsum(sizes) - sizes
            for k in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == k)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    places = starts[some] + np.arange(k)[:, None]
                    answered, right = _judge(values[places], hit[places], weights, both, loose)
                    present, which = np.unique(whose[some], return_inverse=True)
                    share = np.zeros((len(present), len(some)))
                    share[which, np.arange(len(some))] = counts[some]
                    n, ok = share @ answered, share @ right
                    for i, g in enumerate(present.tolist()):
                        if groups[g] not in sums:
                            sums[groups[g]] = np.zeros((3, len(programs)))
                        sums[groups[g]] += np.stack([n[i], ok[i], n[i] / k])
            if len(sums) > GROUPS:
                yield from told(sums)
                sums = {}
        yield from told(sums)

    return held.mapInArrow(run, schema).groupBy(*by, "program").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("chance").alias("chance"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _judge(x: np.ndarray, hit: np.ndarray, weights: np.ndarray, both: list, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items of k options, x of (k, items, features) and hit of (k, items), and of programs: 1 where an item is answered, and where rightly.

    Sums are whole numbers, so single floats hold them exactly as long as they stay below 2^24."""
    exact = np.array_equal(weights, np.rint(weights)) and (np.abs(x).reshape(-1, x.shape[-1]).max(axis=0) @ np.abs(weights)).max(initial=0) < 1 << 24
    kind = np.float32 if exact else np.float64
    weights, x = weights.astype(kind), x.astype(kind)
    parts = {n: np.array([fs for _, fs in both if len(fs) == n]).T for n in {len(fs) for _, fs in both}}
    places = {n: np.array([j for j, fs in both if len(fs) == n]) for n in parts}
    scores = []
    for option in x:
        s = option @ weights
        for n, fs in parts.items():
            on = option[:, fs[0]] > 0
            for f in fs[1:]:
                on &= option[:, f] > 0
            s[:, places[n]] *= on
        scores.append(s)
    top = scores[0].copy()
    for s in scores[1:]:
        np.maximum(top, s, out=top)
    number, right, first, open_ = np.zeros(top.shape, np.int8 if len(x) < 128 else np.int64), np.zeros(top.shape, bool), np.zeros((len(top), len(loose)), bool), np.ones((len(top), len(loose)), bool)
    for s, h in zip(scores, hit, strict=True):
        best = s == top
        number += best
        if len(loose):
            first |= best[:, loose] & open_ & h[:, None]
            open_ &= ~best[:, loose]
        best &= h[:, None]
        right |= best
    answered = number == 1
    answered &= top > 0
    right &= answered
    answered[:, loose], right[:, loose] = True, first
    return answered.astype(np.float64), right.astype(np.float64)


Rates = Callable[[list[Program]], dict[str, tuple[int, float]]]


def rates_of(arrays: DataFrame) -> Rates:
    """A function from programs to their answers and pass rates over ``arrays``: one job, one row for each program."""
    return lambda programs: {r.program: (r.n, r.ok / r.n) for r in tally(arrays, programs, []).collect()}


def greedy_search(rates: Rates, features: list[str], draws: _Draws, cap: int = CAP, tie: float = 0.1) -> Program:
    """Forward selection, one job a step: of the features not yet chosen the best is added, an equal one with probability ``tie``."""
    chosen, best = [], -1.0
    for _ in range(cap):
        tried = [Program(f"search/greedy:{'+'.join([*chosen, f])}", "greedy", dict.fromkeys([*chosen, f], 1.0)) for f in features if f not in chosen]
        told = rates(tried)
        step, rate = None, best
        for p in tried:
            got = told.get(p.id, (0, 0.0))[1]
            if got > rate or (got == rate and draws.next() < tie):
                step, rate = p, got
        if step is None or rate <= best:
            break
        chosen, best = list(step.weights), rate
    chosen = chosen or features[:1]
    return Program(f"search/greedy:{'+'.join(chosen)}", "greedy", dict.fromkeys(chosen, 1.0))


def evolve_search(rates: Rates, features: list[str], draws: _Draws, size: int = 24, generations: int = 6, keep: int = 8, cap: int = CAP) -> Program:
    """Each generation is one job; the best ``keep`` stay, their children have a sign turned or a feature more."""
    crowd = [_random(draws, features, 1 + int(draws.next() * cap), i) for i in range(size)]
    best, best_rate = crowd[0], -1.0
    for g in range(generations):
        told = rates(crowd)
        ranked = sorted(crowd, key=lambda p: -told.get(p.id, (0, 0.0))[1])
        top = told.get(ranked[0].id, (0, 0.0))[1]
        if top > best_rate:
            best, best_rate = ranked[0], top
        crowd = ranked[:keep]
        while len(crowd) < size:
            parent = crowd[int(draws.next() * keep)]
            weights, kind = dict(parent.weights), "evo"
            if draws.next() < 0.5 and weights:
                f = list(weights)[int(draws.next() * len(weights))]
                weights[f] = -weights[f]
            elif len(weights) < cap and (extra := next((f for f in features if f not in weights), None)):
                weights[extra] = -1.0 if draws.next() < 0.5 else 1.0
            crowd.append(Program(f"search/evo:g{g}:{len(crowd)}", kind, weights))
    return Program(f"search/evo:{'+'.join(best.weights)}", "evo", best.weights)


def top_programs(rates: dict[str, tuple[int, float]], programs: list[Program], least: int = LEAST_ANSWERS, top: int = SELECTED) -> list[Program]:
    """The ``top`` programs by rate among those with ``least`` answers; equal ones in the order of the enumeration."""
    held = [p for p in programs if rates.get(p.id, (0, 0.0))[0] >= least]
    return sorted(held, key=lambda p: -rates[p.id][1])[:top]


def fit_search(train: DataFrame, features: list[str], seed: int) -> tuple[list[Program], list[Program]]:
    """(selected, randoms): the best enumerated programs, a greedy and an evolved one; and the random ones."""
    rates, draws, programs = rates_of(train), _Draws(seed), enumerate_programs(features)
    selected = top_programs(rates(programs), programs)
    selected += [greedy_search(rates, features, draws), evolve_search(rates, features, draws)]
    return selected, random_programs(features, seed + 1)


def complexity(program: Column) -> Column:
    """What a program's null is matched by: 1 for atoms, 2 for conjunctions, their own for random ones, else one more than the
    plus signs of the id, 3 at most."""
    own = F.regexp_extract(program, r"random:k(\d+)", 1)
    pluses = F.least(F.lit(3), F.regexp_count(program, F.lit(r"\+")) + 1)
    return F.when(program.contains("/atom:"), 1).when(program.contains("/and:"), 2).when(own != "", own.try_cast("int")).otherwise(pluses).cast("int")


def rank_value(sorted_values: Column, share: float, upper: bool = True) -> Column:
    """An order statistic of a sorted array: number ceil(share n) if ``upper``, else floor(share n) + 1 (at most n), from 1."""
    n = F.size(sorted_values)
    at = F.ceil(F.lit(share) * n) - 1 if upper else F.floor(F.lit(share) * n)
    return F.get(sorted_values, F.greatest(F.lit(0), F.least(n - 1, at.cast("int"))))


def random_rates(randoms: DataFrame, by: list[str], least: int = LEAST_ANSWERS) -> DataFrame:
    """(by.., k, rates): the sorted pass rates of the random programs with ``least`` answers, by group and number of features.

    A group has as many rates as there are random programs of a k."""
    held = randoms.filter(F.col("n") >= least).withColumn("k", complexity(F.col("program")))
    return held.groupBy(*by, "k").agg(F.array_sort(F.collect_list(F.col("ok") / F.col("n"))).alias("rates"))


def eligibility(rates: DataFrame, randoms: DataFrame, cell: list[str], least: int = LEAST_WITNESS) -> DataFrame:
    """Rates (cell.., direction, program, n_scored, n_correct, chance) with pass_rate, lo, hi, beats, p95, eligible and note.

    Programs beat chance if the interval lies above it. Searched ones must also reach the 95th percentile of the random programs
    of their direction, complexity and cell (1 if there are none); eligible are those with ``least`` answers that are not
    random themselves. ``direction`` is null for rules that nothing was fitted for."""
    null = random_rates(randoms, [*cell, "direction"]).withColumn("p95", rank_value(F.col("rates"), 0.95)).drop("rates")
    t = with_interval(rates.withColumn("pass_rate", F.col("n_correct") / F.col("n_scored"))).withColumn("k", complexity(F.col("program")))
    t = t.join(null, [*cell, "direction", "k"], "left")
    searched = F.col("program").startswith("search/")
    p95 = F.when(searched, F.coalesce("p95", F.lit(1.0))).otherwise(F.lit(0.0))
    baseline = F.col("program").contains("/random:") | F.col("program").contains("random-ngram")
    beats, above, enough = F.col("lo") > F.col("chance"), ~searched | (F.col("pass_rate") >= F.col("p95")), F.col("n_scored") >= least
    t = t.withColumn("p95", p95).withColumn("beats", beats).withColumn("eligible", ~baseline & F.col("beats") & enough & above)
    note = F.when(F.col("eligible"), "eligible").when(F.col("beats") & ~enough, "too few").when(F.col("beats") & ~above, "below random p95").when(F.col("beats"), "random baseline").otherwise("does not beat chance")
    return t.withColumn("note", note).drop("k")
