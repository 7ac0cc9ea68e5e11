"""Numeral isomorphs: the numerals of an item's options redrawn in their own form, their order kept or not.

A scan gives each option's numerals and what stands between them. An item's distinct numerals (a fraction counts as two) are
drawn anew under its digits, places and sign, each text to one new text. The attempts of a round are made and judged together
where the item's row is, and the first valid one is kept; items without one get more attempts in the next round, and stay as they
are after the last. Draws are counted by (item, arm, attempt, numeral), so that any task can make them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import draws
from ..functions.staging import once
from .rules import remembered

# fixed values: the forms of numerals, in the order in which they are tried
SIGNS = "-−–"
NUMERAL = (
    rf"(?:(?<![\p{{L}}\p{{N}}.])[{SIGNS}](?=\.?[0-9]))?"  # a sign stands where no letter, digit or point does before it
    r"(?:\.[0-9]+"  # .5
    r"|[0-9]++(?:(?:,[0-9]{3}(?![0-9]))++(?!,)(?!\.[0-9])"  # 1,200
    r"|\.[0-9]+"  # 1.5
    rf"|[ \t]*+/[ \t]*+[{SIGNS}]?[0-9]++(?!\.[0-9])"  # 1/2
    r"|))"  # 12
)
# end of fixed values
FRACTION = r"^(.*?[0-9])([ \t]*/[ \t]*)(.*)$"
KEPT, SCRAMBLED = "rank-kept", "scrambled"
SEED = 20260916
#: Attempts after which each round ends; digits of the longest numeral that is drawn.
ROUNDS, MOST_DIGITS = (16, 256, 4096), 15
#: Draws between one attempt and the next, two for each numeral.
STRIDE = 2048
#: Numerals that are drawn at once, of all attempts together.
DRAWN = 100_000


def numerals(text: Column) -> Column:
    """The numerals of a text, in order: integers, integers with commas, decimals, fractions, with their signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMERAL), F.lit(0))


def kind(numeral: Column) -> Column:
    return F.when(numeral.contains("/"), "fraction").when(numeral.contains(","), "comma_integer").when(numeral.contains("."), "decimal").otherwise("integer")


def _atoms_of(numeral: Column) -> Column:
    """A numeral's own text, or the two of a fraction."""
    part = lambda g: F.regexp_extract(numeral, FRACTION, g)
    return F.when(numeral.contains("/"), F.array(part(1), part(3))).otherwise(F.array(numeral))


def _form(text: Column) -> Column:
    """What a redraw keeps of an atom: (text, sign, kind, whole, places, units, low, high, value); units are without the point."""
    sign = F.regexp_extract(text, f"^[{SIGNS}]", 0)
    body = F.regexp_replace(text, f"^[{SIGNS}]", "")
    places = F.length(F.regexp_extract(body, r"\.([0-9]*)$", 1))
    n = F.length(F.regexp_replace(body, "[^0-9]", ""))
    whole, negative = n - places, sign != ""
    units = F.regexp_replace(body, "[^0-9]", "").try_cast("long")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    low = F.when(body.contains(".") & (whole <= 1), 0).when(n == 1, negative.cast("int")).otherwise(ten(n - 1)).cast("long")
    value = F.when(negative, -1.0).otherwise(1.0) * units / F.pow(F.lit(10.0), places)
    parts = {"text": text, "sign": sign, "kind": kind(text), "whole": whole, "places": places, "units": units, "low": low, "high": ten(F.least(n, F.lit(MOST_DIGITS))) - 1, "value": value, "n": n}
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def _find(atoms: Column, text: Column) -> Column:
    return F.get(F.filter(atoms, lambda a: a["text"] == text), F.lit(0))


def _value(atoms: Column, pair: Column, field: str) -> Column:
    """The number that a pair of atoms stands for."""
    a, b = _find(atoms, pair["a"])[field], _find(atoms, pair["b"])[field]
    return F.when(pair["b"].isNull(), a).otherwise(F.try_divide(a, b))


class _Atom(NamedTuple):
    """What a redraw keeps of an atom, as _form() has it."""

    text: str
    sign: str
    kind: str
    whole: int
    places: int
    units: int
    low: int
    high: int
    n: int

    @property
    def value(self) -> float:
        return (-1.0 if self.sign else 1.0) * self.units / 10.0**self.places

    @property
    def form(self) -> tuple:
        return self.sign, self.kind, self.whole, self.places

    def written(self, drawn: int) -> str:
        """The new text: its own sign and form."""
        size = abs(drawn)
        if self.kind == "comma_integer":
            return f"{self.sign}{size:,}"
        digits = str(size)
        if self.kind == "decimal":
            digits = digits.rjust(self.places + min(self.whole, 1), "0")
            digits = f"{digits[: -self.places]}.{digits[-self.places :]}"
        return self.sign + digits


def _atom(text: str) -> _Atom:
    sign = text[:1] if text[:1] in tuple(SIGNS) else ""
    body = text[len(sign) :]
    digits, places = "".join(c for c in body if c in "0123456789"), len(body.partition(".")[2])
    n, whole = len(digits), len(digits) - places
    kind = "comma_integer" if "," in text else "decimal" if "." in text else "integer"
    low = 0 if "." in body and whole <= 1 else int(sign != "") if n == 1 else 10 ** (n - 1)
    return _Atom(text, sign, kind, whole, places, int(digits), low, 10 ** min(n, MOST_DIGITS) - 1, n)


def _pair(numeral: str) -> tuple[str, ...]:
    """A numeral's atom, or the two of a fraction."""
    a, mark, b = numeral.partition("/")
    return (a.rstrip(" \t"), b.lstrip(" \t")) if mark else (numeral,)


def _first_valid(atoms: list[_Atom], leads: list[tuple[int, ...]], fractions: list[tuple[int, ...]], seed: int, arm: str, rounds: tuple[int, ...]) -> list[int] | None:
    """The draws of the first valid attempt, None if there is none before the end of the last round.

    An attempt holds if every value changes, no two integers and no two decimals are equal, no denominator is 0, and where ranks are
    kept fractions change their value and all first numerals keep their order. A round's attempts are drawn and judged together."""
    low, span, mark, power, value = (np.array(v) for v in zip(*((a.low, float(a.high - a.low + 1), -1 if a.sign else 1, 10.0**a.places, a.value) for a in atoms), strict=True))
    kinds = [[j for j, a in enumerate(atoms) if (a.kind == "decimal") == d] for d in (False, True)]
    peers: dict[tuple, list[int]] = {}
    for pair in leads if arm == KEPT else ():
        if len(pair) == 1:
            peers.setdefault(atoms[pair[0]].form, []).append(pair[0])
    number = lambda of, pair: of[..., pair[0]] if len(pair) == 1 else of[..., pair[0]] / of[..., pair[1]]
    old = np.array([number(value, p) for p in leads])
    order, width = np.sign(old[:, None] - old), max(1, DRAWN // max(len(atoms), len(leads) ** 2))
    first = 0
    for last in rounds:
        for at in range(first, last, width):
            k = np.arange(at, min(last, at + width))[:, None] * STRIDE + 2 * np.arange(len(atoms)) + 1
            drawn = mark * (low + np.minimum(span - 1, np.floor((draws(seed, k) + draws(seed, k + 1) / 4294967296.0) * span)).astype(np.int64))
            for same in peers.values():
                # of the leads with one form the k-th smallest takes the k-th smallest draw: as good as redrawing until the order is right
                drawn[:, same] = np.sort(drawn[:, same], axis=1)[:, [sum(value[o] < value[j] for o in same) for j in same]]
            fresh = drawn / power
            ok = (fresh != value).all(axis=1)
            for js in kinds:
                ok &= (np.diff(np.sort(fresh[:, js], axis=1), axis=1) != 0).all(axis=1)
            for p in fractions:
                ok &= fresh[:, p[1]] != 0
            if arm == KEPT and ok.any():
                fresh, drawn = fresh[ok], drawn[ok]
                new = np.stack([number(fresh, p) for p in leads], axis=1)
                ok = (np.sign(new[:, :, None] - new[:, None, :]) == order).all(axis=(1, 2))
                for p in fractions:
                    ok &= number(fresh, p) != number(value, p)
            if ok.any():
                return drawn[ok.argmax()].tolist()
        first = last
    return None


def _redrawn(spans: list[list[str]], seed: int | None, arm: str, rounds: tuple[int, ...], atom: Callable, pair: Callable) -> tuple[str, dict[str, str] | None]:
    """(state, map) of an item by the numerals of its options."""
    every = [pair(s) for ss in spans for s in ss]
    place = {text: j for j, text in enumerate(dict.fromkeys(t for p in every for t in p))}
    if not place:
        return "no numerals", None
    atoms = [atom(t) for t in place]
    at = lambda pairs: [tuple(place[t] for t in p) for p in dict.fromkeys(pairs)]
    leads, fractions = at(pair(ss[0]) for ss in spans if ss), at(p for p in every if len(p) == 2)
    if seed is None or max(a.n for a in atoms) > MOST_DIGITS or len(atoms) > STRIDE // 2 - 1 or any(atoms[p[1]].units == 0 for p in fractions):
        return "failed", None
    drawn = _first_valid(atoms, leads, fractions, seed, arm, rounds)
    return ("failed", None) if drawn is None else ("redrawn", {a.text: a.written(v) for a, v in zip(atoms, drawn, strict=True)})


def _woven(text: str, spans: list[str], to: dict[str, str], pair: Callable) -> str:
    """A text with its numerals renamed; all digits are in numerals, so that the next place of one's text is its own."""
    out, at = [], 0
    for s in spans:
        start, parts = text.index(s, at), pair(s)
        fresh = to[s] if len(parts) == 1 else to[parts[0]] + s[len(parts[0]) : len(s) - len(parts[1])] + to[parts[1]]
        out += [text[at:start], fresh]
        at = start + len(s)
    return "".join([*out, text[at:]])


def isomorphs(items: DataFrame, arm: str = KEPT, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(id, options, state, map) of items (id, options): options with their numerals redrawn, and what became what.

    ``state`` is redrawn, no numerals, or failed: a fraction over 0, a numeral of more than 15 digits, or no valid attempt in
    the last round; those keep their options. Nothing is joined or shuffled: an item's attempts are made where its row is."""
    rows = items.select("id", "options", F.col("id").cast("string").alias("_name"), F.transform("options", lambda o: numerals(o["text"])).alias("_spans"))
    kinds = rows.schema
    schema = T.StructType([kinds["id"], kinds["options"], T.StructField("state", T.StringType()), T.StructField("map", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("to", T.StringType())])))])
    field = [f.name for f in kinds["options"].dataType.elementType.fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        atom, pair = remembered(_atom), remembered(_pair)
        for b in batches:
            options, spans = b.column(1), b.column(3).to_pylist()
            flat = options.flatten()
            sizes, columns = options.value_lengths().fill_null(0).to_pylist(), flat.flatten()
            texts, states, maps, first = columns[field].to_pylist(), [], [], 0
            for name, ss, n in zip(b.column(2).to_pylist(), spans, sizes, strict=True):
                seed = None if name is None else int(sha256(f"{SEED}:{arm}:{name}".encode()).hexdigest()[:8], 16)
                state, to = _redrawn(ss or [], seed, arm, rounds, atom, pair)
                states.append(state)
                maps.append(None if to is None else [{"text": k, "to": v} for k, v in to.items()])
                if to is not None:
                    texts[first : first + n] = [t if t is None else _woven(t, s, to, pair) for t, s in zip(texts[first : first + n], ss, strict=True)]
                first += n
            columns[field] = pa.array(texts, columns[field].type)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            told = pa.StructArray.from_arrays(columns, fields=list(flat.type), mask=flat.is_null())
            fresh = pa.ListArray.from_arrays(pa.array(ends), told, mask=options.is_null())
            pairs = pa.array(maps, pa.list_(pa.struct([("text", pa.string()), ("to", pa.string())])))
            yield pa.record_batch([b.column(0), fresh, pa.array(states, pa.string()), pairs], names=schema.names)

    return rows.mapInArrow(run, schema)


def checked(items: DataFrame, told: DataFrame) -> DataFrame:
    """(id, state, form_kept, rank_kept, n_changed): what a redraw left of its item: whether all but the digits is the same, whether
    the order of the options' first numbers is, and how many options differ."""
    value = lambda s: _value(F.transform(_atoms_of(s), _form), F.struct(F.get(_atoms_of(s), F.lit(0)).alias("a"), F.get(_atoms_of(s), F.lit(1)).alias("b")), "value")
    both = items.select("id", F.col("options").alias("old")).join(told.select("id", "state", F.col("options").alias("new")).hint("merge"), "id")
    pairs = F.zip_with("old", "new", lambda a, b: F.struct(a["text"].alias("a"), b["text"].alias("b")))
    t = once(both, pairs=pairs)
    first = lambda s: F.get(numerals(s), F.lit(0))
    t = once(t, leads=F.transform(F.filter("pairs", lambda p: first(p["a"]).isNotNull()), lambda p: F.struct(value(first(p["a"])).alias("old"), value(first(p["b"])).alias("new"))))
    bare = lambda s: F.translate(s, "0123456789", "9999999999")
    form = F.forall("pairs", lambda p: bare(p["a"]).eqNullSafe(bare(p["b"])))
    rank = F.forall("leads", lambda x: F.forall("leads", lambda y: F.signum(x["old"] - y["old"]).eqNullSafe(F.signum(x["new"] - y["new"]))))
    return t.select("id", "state", form.alias("form_kept"), rank.alias("rank_kept"), F.size(F.filter("pairs", lambda p: ~p["a"].eqNullSafe(p["b"]))).alias("n_changed"))
