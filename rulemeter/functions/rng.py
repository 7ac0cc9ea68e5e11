"""Counter-based mulberry32 draws: draw k (from 1) is a pure function of seed and k, so any task can make it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _let(x: Column, fn) -> Column:
    """fn(x) with x worked out once: an expression that names another several times would hold as many copies of it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def _imul(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, split so that it stays within a long."""

    def product(x: Column, y: Column) -> Column:
        high = F.shiftleft(F.pmod(F.shiftright(x, 16) * y, F.lit(65536)), 16)
        return (high + x.bitwiseAND(F.lit(65535)) * y).bitwiseAND(F.lit(MASK))

    return _let(F.struct(x.alias("x"), y.alias("y")), lambda p: product(p["x"], p["y"]))


def mulberry32(seed: Column, k: Column) -> Column:
    """A double in [0, 1)."""
    first = lambda a: _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    second = lambda t: t.bitwiseXOR((t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    last = lambda u: u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)
    return _let(_let(_let((seed + k * F.lit(STEP)).bitwiseAND(F.lit(MASK)), first), second), last)


def draws(seed: int, k: np.ndarray) -> np.ndarray:
    """mulberry32() of an array of whole numbers."""
    a = ((np.uint64(seed) + k.astype(np.uint64) * np.uint64(STEP)) & np.uint64(MASK)).astype(np.uint32)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def sql(seed: str, k: str) -> str:
    """DuckDB expression of the draw."""
    imul = lambda x, y: f"((((({x}) >> 16) * ({y})) % 65536 * 65536 + (({x}) & 65535) * ({y})) & 4294967295)"
    a = f"(({seed} + {k} * {STEP}) & {MASK})"
    return f"list_transform([{a}], lambda a: list_transform([{imul('xor(a, a >> 15)', 'a | 1')}], lambda t: list_transform([xor(t, (t + {imul('xor(t, t >> 7)', 't | 61')}) & {MASK})], lambda u: xor(u, u >> 14) / 4294967296.0)[1])[1])[1]"
