"""Power of a cell: the least pass rate that clears chance, and the true rate found four times in five.

Both search over counts, one cell at a time, with numpy draws that equal the counter-based ones; cells are dealt out to
tasks, and equal (n, chance) pairs are worked out once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.rng import MASK, STEP

#: Cells with fewer items have no verdict.
LEAST_ITEMS = 10


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws first, first + 1, ... of a seed, as functions.rng.mulberry32 gives them."""
    m = np.uint64(MASK)
    k = np.arange(first, first + count, dtype=np.uint64)
    a = (np.uint64(seed) + k * np.uint64(STEP)) & m
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & m
    u = t ^ ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & m)) & m)
    return (u ^ (u >> np.uint64(14))) / 4294967296.0


def lower_bound(passed: np.ndarray, n_boot: int, seed: int) -> float:
    """Lower end of the 95% percentile bootstrap of a 0/1 array, replicates in runs of bounded memory."""
    n, means, run = len(passed), [], max(1, 4_000_000 // max(1, len(passed)))
    for b in range(0, n_boot, run):
        r = min(run, n_boot - b)
        at = (draws(seed, b * n + 1, r * n) * n).astype(np.int64)
        means.append(passed[at].reshape(r, n).sum(axis=1) / n)
    return float(np.sort(np.concatenate(means))[int(0.025 * n_boot)])


def _least(n: int, clears) -> float:
    lo, hi, best = 0, n, n
    while lo <= hi:
        k = (lo + hi) // 2
        if clears(k):
            best, hi = k, k - 1
        else:
            lo = k + 1
    return best / n


def min_observable(n: int, chance: float) -> float | None:
    if n < LEAST_ITEMS:
        return None
    return _least(n, lambda k: lower_bound((np.arange(n) < k).astype(float), 400, 21 + n) > chance)


def min_detectable(n: int, chance: float, power: float = 0.8, trials: int = 200) -> float | None:
    if n < LEAST_ITEMS:
        return None

    def clears(k: int) -> bool:
        u = draws(77 + n + 10007 * k, 1, trials * n).reshape(trials, n)
        return sum(lower_bound((row < k / n).astype(float), 200, 31 + t) > chance for t, row in enumerate(u)) / trials >= power

    return _least(n, clears)


def cell_power(cells: DataFrame, n: str = "n", chance: str = "chance", simulate: bool = False) -> DataFrame:
    """Adds min_observable, and min_detectable if asked to simulate; null below LEAST_ITEMS items."""
    pairs = cells.select(n, chance).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["min_observable"] = [min_observable(int(a), float(c)) for a, c in zip(p[n], p[chance], strict=True)]
            p["min_detectable"] = [min_detectable(int(a), float(c)) if simulate else None for a, c in zip(p[n], p[chance], strict=True)]
            yield p.astype({"min_observable": "float64", "min_detectable": "float64"})

    known = pairs.repartition(n).mapInPandas(run, f"{n} {dict(cells.dtypes)[n]}, {chance} {dict(cells.dtypes)[chance]}, min_observable double, min_detectable double")
    return cells.join(known, [n, chance], "left")
