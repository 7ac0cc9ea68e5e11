"""Items with lettered options, and the scoring rules in one pass over Arrow batches of items.

An item is (id, authority, claim, stem, key, options), options an array of (letter, text) in letter order. The key never
reaches a rule: answers() drops it before scoring and score() joins it back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from .rules import _CONSONANTS, _VOWELS, RULES, Option, option_parts, remembered, stem_parts


def unique_max(scores: Column, positive: bool = True) -> Column:
    """Letter of the largest score if no other has it (and it is positive); else null."""
    best = F.array_max(F.transform(scores, lambda o: o["s"]))
    top = F.filter(scores, lambda o: o["s"] == best)
    ok = (F.size(top) == 1) & (best > 0) if positive else F.size(top) == 1
    return F.when(ok, F.get(top, F.lit(0))["letter"])


def _scored(options: Column, fn) -> Column:
    return F.transform(options, lambda o: F.struct(o["letter"].alias("letter"), fn(o).alias("s")))


def order_statistic(options: Column, which: str = "lower", least: int = 3) -> Column:
    """First letter whose leading number is the lower or upper central, smallest or largest one, of at least ``least``."""
    return _central(_scored(options, lambda o: T.leading_number(o["text"])), which, least)


def _central(valued: Column, which: str = "lower", least: int = 3) -> Column:
    held = F.filter(valued, lambda o: o["s"].isNotNull())
    values = F.array_sort(F.transform(held, lambda o: o["s"]))
    n = F.size(values)
    at = {"lower": F.floor((n - 1) / 2), "upper": F.ceil((n - 1) / 2), "smallest": F.lit(0), "largest": n - 1}[which].cast("int")
    return F.when(n >= least, F.get(F.filter(held, lambda o: o["s"] == F.get(values, at)), F.lit(0))["letter"])


def _elements(text: Column, tokens: Column, value: Column) -> Column:
    """What two options can share: words, and the leading number and all digits of an option that has one."""
    more = F.array(F.concat(F.lit("num:"), value.cast("string")), F.concat(F.lit("digits:"), F.regexp_replace(text, "[^0-9-]", "")))
    return F.when(value.isNull(), F.array_distinct(tokens)).otherwise(F.array_distinct(F.concat(tokens, more)))


def prepared(items: DataFrame, *keep: str) -> DataFrame:
    """(keep.., p): of each item the stem and the options with their words and numbers, worked out once; not the key.

    ``p`` comes out of a generator, which the optimizer doesn't look through: the arrays would otherwise be worked out again
    for every element of a lambda that names them. Null option texts and stems are empty."""
    stem = F.coalesce(F.col("stem"), F.lit(""))

    def bare(x: Column) -> Column:
        t = F.coalesce(x["text"], F.lit(""))
        return F.struct(x["letter"].alias("letter"), t.alias("text"), F.length(t).alias("n"), T.tokens(t).alias("t"), T.leading_number(t).alias("v"), t.rlike(T.ABSOLUTE).alias("absolute"))

    first = F.struct(stem.alias("stem"), F.trim(stem).alias("bare"), T.tokens(stem, 4).alias("tokens"), T.number_tokens(stem).alias("numbers"), F.transform("options", bare).alias("o"))
    once = items.select(*keep, F.explode(F.array(first)).alias("q"))

    def more(x: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("letter", "text", "n", "t", "v", "absolute")), F.array_distinct(x["t"]).alias("u"), _elements(F.trim(x["text"]), x["t"], x["v"]).alias("e"))

    q = F.col("q")
    second = F.struct(*(q[c].alias(c) for c in ("stem", "bare", "tokens", "numbers")), F.transform(q["o"], more).alias("o"))
    return once.select(*keep, F.explode(F.array(second)).alias("p"))


def _stage(df: DataFrame, name: str, **parts: Column) -> DataFrame:
    """``df`` with a struct of columns that are worked out once, behind a generator."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in parts.items())))).alias(name))


def rules() -> dict[str, Callable]:
    """The rules by name, each from the parts of a stem and of options to a letter, or to None where it does not apply."""
    return dict(RULES)


def _answered(items: DataFrame, names: Sequence[str] | None, *keep: str) -> DataFrame:
    """(keep.., t): an array of (program, answer) for each rule; the columns to keep travel beside, out of the rules' sight."""
    names = list(names or RULES)
    told = [RULES[k] for k in names]
    rows = items.select(*keep, "stem", F.transform("options", lambda x: x["letter"]).alias("_letters"), F.transform("options", lambda x: x["text"]).alias("_texts"))
    schema = T_.StructType([*rows.schema.fields[: len(keep)], T_.StructField("_a", T_.ArrayType(T_.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option, stem = remembered(option_parts), remembered(stem_parts)
        for b in batches:
            out = []
            for s, letters, texts in zip(*(b.column(len(keep) + i).to_pylist() for i in range(3)), strict=True):
                q, o = stem(s), [Option(x, *option(t)) for x, t in zip(letters or (), texts or (), strict=True)]
                out += [rule(q, o) for rule in told]
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(names))
            yield pa.record_batch([*b.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(out, pa.string()))], names=schema.names)

    return rows.mapInArrow(run, schema).select(*keep, F.array(*[F.struct(F.lit(k).alias("program"), F.get("_a", F.lit(i)).alias("answer")) for i, k in enumerate(names)]).alias("t"))


def answers(items: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Trials without the key: (id, program, answer, skipped), one row for each item and rule.

    An item with empty options is skipped by every rule; null option texts are empty."""
    return _answered(items, names, "id").select("id", F.explode("t").alias("t")).select("id", "t.program", "t.answer", F.col("t.answer").isNull().alias("skipped"))


#: What each view shows: the stem, its numbers, the options, and the surface that is worked out of both or of the options only.
VIEWS = {
    "item-cues": ("options", "surface"), "choices-only": ("options", "bare surface"), "stem-ngram": ("stem", "numbers", "options", "surface"), "unbound": ("stem", "numbers", "options"), "instruction-only": ("worked example", "numbers", "options"),
}
STEM_RULES = ("stem-option-overlap", "option-repeating-stem-numbers")


def view_of(channel: Column, program: Column) -> Column:
    """The view that a rule gets: by its channel, and of the partial-input ones by whether it reads the stem."""
    return F.when(channel == "item-cues", "item-cues").when(channel == "unbound-exec", "unbound").when(program.isin(*STEM_RULES), "stem-ngram").when(channel == "partial-input", "choices-only").otherwise("unbound")


def views(items: DataFrame, rules: DataFrame, worked: Column | None = None) -> DataFrame:
    """(id, program, view, stem, numbers, options, surface) of each item and rule (program, channel), none of it with the key.

    What a view does not show is null. ``surface`` holds the letters of the longest options, of the middle values, of those that
    repeat a number of the stem, and the stem words in each option; of the options alone the stem counts as empty. ``worked`` is
    the worked example that instruction-only rules see in place of the stem. The rules are a catalog."""
    p = F.col("p")
    o = p["o"]
    held = F.array_sort(F.filter(F.transform(o, lambda x: x["v"]), lambda v: v.isNotNull()))
    letters = lambda on: F.transform(F.filter(o, on), lambda x: x["letter"])
    top = F.array_max(F.transform(o, lambda x: x["n"]))
    middle = F.when(F.size(held) >= 3, F.get(held, F.floor((F.size(held) - 1) / 2).cast("int")))

    def surface(stem: bool) -> Column:
        none = F.array().cast("array<string>")
        repeated = letters(lambda x: F.exists(p["numbers"], lambda k: F.contains(x["text"], k))) if stem else none
        overlap = F.transform(o, lambda x: F.size(F.filter(x["t"], lambda w: F.array_contains(p["tokens"], w)))) if stem else F.transform(o, lambda x: F.lit(0))
        return F.struct(letters(lambda x: x["n"] == top).alias("longest"), F.coalesce(letters(lambda x: x["v"] == middle), none).alias("middle"), repeated.alias("repeated"), overlap.alias("overlap"))

    keep = items.withColumn("_worked", worked if worked is not None else F.lit(None).cast("string"))
    t = _stage(prepared(keep, "id", "options", "_worked"), "s", whole=surface(True), bare=surface(False))
    t = t.crossJoin(F.broadcast(rules.select("program", view_of(F.col("channel"), F.col("program")).alias("view"))))  # a catalog of rules
    shows = lambda what: F.col("view").isin(*(v for v, parts in VIEWS.items() if what in parts))
    return t.select(
        "id", "program", "view", F.when(shows("stem"), p["stem"]).when(shows("worked example"), F.col("_worked")).alias("stem"), F.when(shows("numbers"), p["numbers"]).alias("numbers"), F.when(shows("options"), F.col("options")).alias("options"),
        F.when(shows("surface"), F.col("s.whole")).when(shows("bare surface"), F.col("s.bare")).alias("surface"),
    )


def score(items: DataFrame, trials: DataFrame) -> DataFrame:
    """Trials joined with what they are judged by: correct is null where skipped, chance is 1 / options."""
    judged = items.select("id", "authority", "claim", "key", F.try_divide(F.lit(1.0), F.size("options")).alias("chance"))
    return trials.join(judged, "id").withColumn("correct", F.when(~F.col("skipped"), F.lower(F.trim("answer")) == F.lower(F.trim("key"))))


def told(items: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(id, authority, claim, key, chance, t): each item with its answers; the key travels beside the item, out of the rules' sight."""
    beside = items.withColumn("chance", F.try_divide(F.lit(1.0), F.size("options")))
    return _answered(beside, names, "id", "authority", "claim", "key", "chance")


def trials(answered: DataFrame) -> DataFrame:
    """What score() gives, of the rows of told()."""
    t = answered.select("id", "authority", "claim", "key", "chance", F.explode("t").alias("t"))
    t = t.select("id", "t.program", "t.answer", F.col("t.answer").isNull().alias("skipped"), "authority", "claim", "key", "chance")
    return t.withColumn("correct", F.when(~F.col("skipped"), F.lower(F.trim("answer")) == F.lower(F.trim("key"))))


def judged(items: DataFrame, names: list[str] | None = None) -> DataFrame:
    """score(items, answers(items)) in one pass. What reads it several times stores told() first."""
    return trials(told(items, names))


def rule_chance(scored: DataFrame) -> DataFrame:
    """By (authority, claim, program): scored, correct, pass rate (0 where nothing was scored), mean chance."""
    return scored.groupBy("authority", "claim", "program").agg(
        F.count("correct").alias("n_scored"), F.count_if("correct").alias("n_correct"), F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("pass_rate"), F.avg(F.when(~F.col("skipped"), F.col("chance"))).alias("chance")
    )


def first_witness(scored: DataFrame, order: list[str]) -> DataFrame:
    """The first correct trial of each item, in the order of the programs."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("program"))
    return scored.filter("correct").groupBy("id").agg(F.min_by("program", at).alias("witness"), F.count("*").alias("n_witnesses"))


def features(items: DataFrame, common: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(id, letter, feature columns) of every option, in one pass over each item's array: feature_arrays() as rows."""
    return feature_arrays(items, common, keep).select("id", *keep, F.explode("features").alias("f")).select("id", *keep, "f.*")


def feature_arrays(items: DataFrame, common: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep.., features): an array of (letter, feature columns) in the order of the item's options.

    ``common`` are the everyday words that count for specificity; beside them every word of an option adds a tenth.
    Columns to ``keep`` travel along, unseen by the features."""
    rows = items.select("id", *keep, "stem", F.transform("options", lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"))).alias("_o"))
    width, kinds = 1 + len(keep), [(name, pa.float64() if name in ("specificity", "distinctive") else pa.int32()) for name in FEATURES]
    fields = T_.StructType([T_.StructField("letter", T_.StringType()), *(T_.StructField(name, T_.DoubleType() if pa.types.is_floating(kind) else T_.IntegerType()) for name, kind in kinds)])
    schema = T_.StructType([*rows.schema.fields[:width], T_.StructField("features", T_.ArrayType(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option, stem = _option_of(common), remembered(stem_parts)
        for b in batches:
            sizes, letters, texts = _flat(b.column(width + 1))
            columns = _feature_columns(b.column(width), letters, texts, sizes, option, stem)
            flat = pa.StructArray.from_arrays([letters, *(pa.array(c).cast(kind) for c, (_, kind) in zip(columns, kinds, strict=True))], names=["letter", *FEATURES])
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            told = pa.ListArray.from_arrays(pa.array(ends), flat, mask=b.column(width + 1).is_null())
            yield pa.record_batch([*b.columns[:width], told], names=schema.names)

    return rows.mapInArrow(run, schema)


def patterns(items: DataFrame, common: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by.., hits, x, items): which options are right and their FEATURES one after another, in millionths of six rounded digits; items
    in which these are equal are one row, with their number. Items without options have none.

    What judges programs needs no more of an item, and has as many rows as differ."""
    rows = items.select(*by, "key", "stem", F.transform("options", lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"))).alias("_o"))
    schema = T_.StructType([*rows.schema.fields[: len(by)], T_.StructField("hits", T_.ArrayType(T_.BooleanType())), T_.StructField("x", T_.ArrayType(T_.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option, stem = _option_of(common), remembered(stem_parts)
        for b in batches:
            sizes, letters, texts = _flat(b.column(len(by) + 2))
            columns = _feature_columns(b.column(len(by) + 1), letters, texts, sizes, option, stem)
            x = np.stack([_millionths(c) for c in columns], axis=1)
            hits = _same_letters(letters, b.column(len(by)), sizes)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            told = [pa.ListArray.from_arrays(pa.array(ends), pa.array(hits)), pa.ListArray.from_arrays(pa.array(ends * len(FEATURES)), pa.array(x.ravel()))]
            yield pa.record_batch([*b.columns[: len(by)], *told], names=schema.names).filter(pa.array(sizes > 0))

    return rows.mapInArrow(run, schema).groupBy(*schema.names).agg(F.count("*").alias("items"))


def _flat(options: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The sizes of lists of options, and all their letters and texts."""
    sizes = options.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, *options.flatten().flatten()


def _coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """Of each value the place in a list of the distinct ones."""
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _same_letters(letters: pa.Array, keys: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Whether the options' letters are their item's key, in either case and without the blanks around."""
    numbers: dict[str, int] = {}
    place = lambda x: -1 if x is None else numbers.setdefault(x.strip(" ").lower(), len(numbers))
    (a, names), (b, others) = _coded(letters), _coded(keys)
    a, b = np.array([place(x) for x in names], np.int64)[a], np.array([place(x) for x in others], np.int64)[b]
    return (a >= 0) & (a == np.repeat(b, sizes))


def _millionths(values: np.ndarray) -> np.ndarray:
    """Values in millionths, rounded as Spark rounds six digits: halves of the shortest decimal form away from zero."""
    out = np.rint(values * 1e6)
    for i in np.flatnonzero(np.abs(np.abs(values * 1e6 - np.floor(values * 1e6)) - 0.5) < 1e-4):
        out[i] = int((Decimal(repr(float(values[i]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return out.astype(np.int64)


#: The features of an option, in the order of their columns.
FEATURES = ("longest", "position_c", "overlap", "num_repeat", "no_absolute", "numeric_min", "numeric_med", "numeric_max", "specificity", "grammar_agree", "distinctive")


def _option_of(common: Sequence[str]) -> Callable:
    """What features need of a text: the text, its length, words, leading number, whether it has no absolute term, specificity, first sign."""
    everyday = frozenset(common)

    def parts(text: str | None) -> tuple:
        told = option_parts(text)
        u = frozenset(told[1])
        return told[0], len(told[0]), u, told[2], int(not told[3]), len(u & everyday) + len(u) * 0.1, told[6]

    return remembered(parts)


def _feature_columns(stems: pa.Array, letters: pa.Array, texts: pa.Array, sizes: np.ndarray, option: Callable, stem: Callable) -> list[np.ndarray]:
    """FEATURES of the options of items with ``sizes`` of them, a column each; items with as many options are worked out together."""
    code, names = _coded(texts)
    parts = [option(t) for t in names]
    of = lambda at, kind: np.array([x[at] for x in parts], kind)[code] if parts else np.zeros(0, kind)
    length, value = of(1, np.int64), of(3, np.float64)  # no number is nan
    which, asked = _coded(stems)
    asked = [stem(s) for s in asked]
    q = np.repeat(which, sizes)
    words = [x[2] for x in parts]
    # a stem meets a text several times in a batch
    pair, met = np.unique(q * max(1, len(parts)) + code, return_inverse=True)
    both = [(asked[i // len(parts)], parts[i % len(parts)]) for i in pair.tolist()]
    overlap = np.array([len(x[2] & s.tokens) for s, x in both], np.int64)[met]
    repeated = np.array([any(m in x[0] for m in s.numbers) for s, x in both], np.int64)[met]
    vowel, consonant = (np.array([x[6] in signs for x in parts], bool)[code] for signs in (_VOWELS, _CONSONANTS))
    an, a = (np.array([getattr(s, c) for s in asked], bool)[q] for c in ("wants_an", "wants_a"))
    letter, told = _coded(letters)
    out = {name: np.zeros(len(code), np.float64 if name in ("specificity", "distinctive") else np.int64) for name in FEATURES}
    out |= {"position_c": (np.array([x == "C" for x in told], bool)[letter]).astype(np.int64), "overlap": overlap, "num_repeat": repeated, "no_absolute": of(4, np.int64), "specificity": of(5, np.float64)}
    out["grammar_agree"] = np.where(an, vowel, a & consonant).astype(np.int64)
    named = np.array([-1 if x is None else i for i, x in enumerate(told)], np.int64)[letter]
    starts = np.cumsum(sizes) - sizes
    for k in np.unique(sizes[sizes > 0]).tolist():
        at = starts[sizes == k][:, None] + np.arange(k)
        n, v = length[at], value[at]
        top = n == n.max(axis=1, keepdims=True)
        out["longest"][at] = top & (top.sum(axis=1, keepdims=True) == 1)
        held, order = (~np.isnan(v)).sum(axis=1), np.sort(v, axis=1)  # nan last
        for name, place, least in (("numeric_min", 0 * held, 2), ("numeric_med", (held - 1) // 2, 3), ("numeric_max", held - 1, 2)):
            same = v == np.take_along_axis(order, np.maximum(place, 0)[:, None], 1)
            out[name][at] = same & ((held >= least) & (same.sum(axis=1) == 1))[:, None]
        if k == 1:
            out["distinctive"][at] = 1.0
            continue
        l, c = named[at], code[at]
        alike = np.zeros((len(at), k, k))
        for i in range(k):
            for j in range(i):
                on = np.flatnonzero((l[:, i] != l[:, j]) & (l[:, i] >= 0) & (l[:, j] >= 0))
                x, y = c[on, i].tolist(), c[on, j].tolist()
                shared = np.array([len(words[m] & words[o]) for m, o in zip(x, y, strict=True)], np.int64)
                every = np.array([len(words[m]) + len(words[o]) for m, o in zip(x, y, strict=True)], np.int64) - shared
                alike[on, i, j] = alike[on, j, i] = shared / np.maximum(every, 1)
        like = np.zeros(at.shape)
        for j in range(k):  # one after another, as sums round otherwise
            like += alike[:, :, j]
        out["distinctive"][at] = 1 - like / (k - 1)
    return [out[name] for name in FEATURES]


def apply_programs(feature_rows: DataFrame, programs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep.., program, answer): weighted sums of features and their unique positive maximum, one row for each item and program.

    ``programs`` is (program, feature, weight), a driver-made table of a few thousand rows. It becomes a matrix that goes to
    every task, so that an item's options are gathered once and nothing is joined or shuffled for a program; a lambda over
    programs would be interpreted for each option. Features count in millionths, so sums are exact and ties are ties."""
    names = [c for c in feature_rows.columns if c not in ("id", "letter", *keep)]
    terms = [r for r in programs.collect() if r.feature in names]
    order = sorted({r.program for r in terms})
    weights = np.zeros((len(names), len(order)))
    for r in terms:
        weights[names.index(r.feature), order.index(r.program)] += r.weight
    option = F.struct("letter", F.array(*(F.coalesce(F.rint(F.col(c) * 1e6), F.lit(0.0)) for c in names)).alias("f"))
    held = feature_rows.groupBy("id", *keep).agg(F.sort_array(F.collect_list(option)).alias("o"))
    schema = T_.StructType([*held.schema.fields[:-1], T_.StructField("program", T_.StringType()), T_.StructField("answer", T_.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = pa.array(order, pa.string())
        step = max(1, 200_000 // max(1, len(order)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                o = b.column(b.num_columns - 1)
                sizes = np.asarray(o.value_lengths())
                flat = o.flatten()
                x = np.asarray(flat.field("f").flatten()).reshape(len(flat), len(names)) @ weights
                starts = np.cumsum(sizes) - sizes
                top = np.maximum.reduceat(x, starts)
                best = x == np.repeat(top, sizes, axis=0)
                one = (np.add.reduceat(best, starts, dtype=np.int64) == 1) & (top > 0)
                which = np.add.reduceat(best * np.arange(len(x))[:, None], starts)
                items = pa.array(np.repeat(np.arange(b.num_rows), len(order)))
                letter = flat.field("letter").take(pa.array(which.ravel(), mask=~one.ravel()))
                yield pa.record_batch([*(b.column(i).take(items) for i in range(b.num_columns - 1)), told.take(pa.array(np.tile(np.arange(len(order)), b.num_rows))), letter], names=schema.names)

    return held.mapInArrow(run, schema)
