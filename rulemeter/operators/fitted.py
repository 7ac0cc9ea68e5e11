"""Option models fitted on items disjoint from those they answer: n-grams, weighted overlap, random weights, formulas.

Features are generated as arrays of each option and exploded; a model is a table of features, joined by feature, so neither
items nor vocabulary pass through one place. Scores count in billionths, so that sums don't depend on their order and ties
are ties. Items are (id, stem, key, options); the key is read by the training functions only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..functions.rng import draws
from ..functions.staging import stored
from .items import prepared
from .rules import REMEMBERED, option_parts, remembered, stem_parts
from .stats import with_interval

#: Letters of a feature word at least; character 3-grams of an option at most.
LETTERS, GRAMS = 3, 60
UNIT = 1e9
#: Features of a model that every task holds at most; a larger model stays a table, which is joined.
FEATURES_HELD = 200_000
_OTHER = re.compile("[^a-z0-9]+")
LEAST_WITNESS = 10


def _long(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= LETTERS)


def option_features(items: DataFrame, *keep: str) -> DataFrame:
    """(keep.., letter, place, features): of each option its words (o:), those that the stem has too (ov:), the 3-grams of its
    letters and digits (c3:), cues (longest, middle value, a number of the stem), place and length; repeats stay.

    ``place`` numbers an item's options from 0. Items without options have no rows."""
    t, s, x = _shared_values(items, *keep), F.col("s"), F.col("x")
    t = t.select(*keep, F.col("p.numbers").alias("numbers"), "s", F.posexplode("p.o").alias("place", "x"))
    words, plain, last = _parts(x, s, F.col("numbers"))
    t = t.select(*keep, "place", "x", words.alias("words"), plain.alias("c"), last.alias("last"))
    n = F.least(F.length("c") - 2, F.lit(GRAMS))
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("c3:"), F.substring("c", i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    return t.select(*keep, x["letter"].alias("letter"), "place", F.concat("words", grams, "last").alias("features"))


def _shared_values(items: DataFrame, *keep: str) -> DataFrame:
    """Prepared items with what their options share: the greatest length, the middle value, the stem's words."""
    p = F.col("p")
    o = p["o"]
    values = F.array_sort(F.filter(F.transform(o, lambda x: x["v"]), lambda v: v.isNotNull()))
    shared = F.struct(F.array_max(F.transform(o, lambda x: x["n"])).alias("top"), F.when(F.size(values) >= 3, F.get(values, F.floor((F.size(values) - 1) / 2).cast("int"))).alias("middle"), _long(T.tokens(p["stem"])).alias("words"))
    return prepared(items, *keep).select(*keep, "p", F.explode(F.array(shared)).alias("s"))


def _parts(x: Column, s: Column, numbers: Column) -> tuple[Column, Column, Column]:
    """Of an option its word features, its letters and digits with single spaces (a-z, 0-9), and its cues, place and length."""
    words = F.flatten(F.transform(_long(x["t"]), lambda w: F.when(F.array_contains(s["words"], w), F.array(F.concat(F.lit("o:"), w), F.concat(F.lit("ov:"), w))).otherwise(F.array(F.concat(F.lit("o:"), w)))))
    cue = lambda name, on: F.when(on, F.lit(f"cue:{name}"))
    cues = F.array_compact(F.array(cue("longest", x["n"] == s["top"]), cue("middle", x["v"] == s["middle"]), cue("numrepeat", F.exists(numbers, lambda k: F.contains(x["text"], k)))))
    last = F.array(F.concat(F.lit("pos:"), x["letter"]), F.concat(F.lit("len:"), F.least(F.lit(8), F.floor(x["n"] / 12)).cast("string")))
    return words, F.regexp_replace(F.lower(x["text"]), "[^a-z0-9]+", " "), F.concat(cues, last)


def _is_key(letter: Column | str = "letter") -> Column:
    return F.coalesce(F.upper(letter) == F.upper("key"), F.lit(False))


def _hits() -> Column:
    """Whether each option is the key."""
    return F.transform("options", lambda x: _is_key(x["letter"]))


class _Text(NamedTuple):
    """What an option's text says by itself: its signs, words, leading number, and its features that nothing else has a part in."""

    text: str
    size: int
    words: tuple[str, ...]
    value: float | None
    own: list[str]


def _text_parts(text: str | None) -> _Text:
    text, tokens, value, *_ = option_parts(text)
    words = tuple(w for w in tokens if len(w) >= LETTERS)
    plain = _OTHER.sub(" ", text.lower())
    grams = [f"c3:{plain[i : i + 3]}" for i in range(min(len(plain) - 2, GRAMS))]
    return _Text(text, len(text), words, value, [*(f"o:{w}" for w in words), *grams, f"len:{min(8, len(text) // 12)}"])


def _stem_words(text: str | None) -> tuple[frozenset[str], tuple[str, ...]]:
    """Words of a stem that features know, and its numbers."""
    words = option_parts(text)[1]
    return frozenset(w for w in words if len(w) >= LETTERS), stem_parts(text).numbers


def _met(stem: tuple, letters: list[str | None], o: list[_Text]) -> list[list[str | None]]:
    """Of each option the features that come of its stem, of the other options and of its letter."""
    words, numbers = stem
    top, values = max(x.size for x in o), sorted(x.value for x in o if x.value is not None)
    middle = values[(len(values) - 1) // 2] if len(values) >= 3 else None
    out = []
    for letter, x in zip(letters, o, strict=True):
        told = [None if letter is None else f"pos:{letter}"]
        if not words.isdisjoint(x.words):
            told += [f"ov:{w}" for w in x.words if w in words]
        if x.size == top:
            told.append("cue:longest")
        if middle is not None and x.value == middle:
            told.append("cue:middle")
        if any(k in x.text for k in numbers):
            told.append("cue:numrepeat")
        out.append(told)
    return out


def _rows(items: DataFrame, *more: Column | str) -> DataFrame:
    """(stem, letters, texts, more..) of items."""
    return items.select("stem", F.transform("options", lambda x: x["letter"]).alias("letters"), F.transform("options", lambda x: x["text"]).alias("texts"), *more)


def train_ngram(items: DataFrame) -> DataFrame:
    """(feature, in_key, in_rest): how often each feature of option_features() stands in keys, and in the other options.

    A task counts the texts it meets and their features once for each distinct text; sums of it are shuffled, no feature rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option, stem = remembered(_text_parts), remembered(_stem_words)
        texts, others = (Counter(), Counter()), (Counter(), Counter())

        def told() -> pa.RecordBatch:
            sums = others
            for count, own in zip(sums, texts, strict=True):
                for text, n in own.items():
                    for f in option(text).own:
                        count[f] += n
                own.clear()
            names = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in sums)]
            for c in sums:
                c.clear()
            return pa.record_batch(columns, names=["feature", "in_rest", "in_key"])

        for b in batches:
            for s, letters, ts, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not letters:
                    continue
                for x, more, hit in zip(ts, _met(stem(s), letters, [option(t) for t in ts]), hits, strict=True):
                    texts[hit][x] += 1
                    others[hit].update(more)
            if sum(map(len, (*texts, *others))) > REMEMBERED:
                yield told()
        yield told()

    t = _rows(items, _hits().alias("hits")).mapInArrow(run, "feature string, in_rest long, in_key long")
    return t.groupBy("feature").agg(F.sum("in_key").alias("in_key"), F.sum("in_rest").alias("in_rest"))


def _first_best(scores: DataFrame) -> DataFrame:
    """(id, answer, score): the best letter of (id, letter, s), the first of equal ones."""
    best = F.min(F.struct((-F.col("s")).alias("s"), "letter"))
    return scores.groupBy("id").agg(best.alias("b")).select("id", F.col("b.letter").alias("answer"), (-F.col("b.s")).alias("score"))


def apply_ngram(model: DataFrame, items: DataFrame) -> DataFrame:
    """(id, answer, score) of items with options: the option with the largest sum of Laplace log-ratios of its features.

    A feature that the model does not know weighs what one that was seen in neither class does."""
    weights, plain, size = _log_ratios(model)
    if size <= FEATURES_HELD:  # counted: every task can hold the model
        return _first_best(_scored_in_place(items, {r.feature: r.w for r in weights.collect()}, plain))
    rows = option_features(items, "id").select("id", "letter", F.explode("features").alias("feature"))
    scored = rows.join(weights, "feature", "left").withColumn("w", F.coalesce("w", F.lit(plain)))
    return _first_best(scored.groupBy("id", "letter").agg(F.sum("w").alias("s")))


def _log_ratios(model: DataFrame) -> tuple[DataFrame, int, int]:
    """(feature, w) of a model, the weight of a feature that it does not know, and how many it knows."""
    model = stored(model)  # its counts are read, then its rows
    k, d, v = model.agg(F.sum("in_key"), F.sum("in_rest"), F.count("*") + 1).first()
    k, d = k or 1, d or 1
    ratio = lambda a, b: F.rint(UNIT * (F.ln((a + 1) / F.lit(float(k + v))) - F.ln((b + 1) / F.lit(float(d + v))))).cast("long")
    plain = model.sparkSession.range(1).select(ratio(F.lit(0), F.lit(0)).alias("w")).first()[0]
    return model.select("feature", ratio(F.col("in_key"), F.col("in_rest")).alias("w")), plain, v


def _scored_in_place(items: DataFrame, weights: dict[str | None, int], plain: int) -> DataFrame:
    """(id, letter, s) of every option by a model that each task holds; an item is one row until its id's rows have met."""
    weights.pop(None, None)  # a feature that is null is equal to none
    shared = items.sparkSession.sparkContext.broadcast(weights)
    kind = items.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def parts(text: str | None) -> tuple[_Text, int]:
            x = _text_parts(text)
            return x, sum(known.get(f, plain) for f in x.own)

        option, stem = remembered(parts), remembered(_stem_words)
        for b in batches:
            sums = []
            for s, letters, ts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if letters:
                    o = [option(t) for t in ts]
                    sums += [own + sum(known.get(f, plain) for f in more) for (_, own), more in zip(o, _met(stem(s), letters, [x for x, _ in o]), strict=True)]
            letters = b.column(1)
            ends = np.concatenate(([0], np.cumsum(letters.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int32)
            cells = pa.StructArray.from_arrays([letters.flatten(), pa.array(sums, pa.int64())], names=["letter", "s"])
            yield pa.record_batch([b.column(3), pa.ListArray.from_arrays(pa.array(ends), cells)], names=["id", "o"])

    schema = S.StructType([S.StructField("id", kind), S.StructField("o", S.ArrayType(S.StructType([S.StructField("letter", S.StringType()), S.StructField("s", S.LongType())])))])
    met = _rows(items, "id").mapInArrow(run, schema).repartition("id").select("id", F.explode("o").alias("x")).select("id", "x.*")
    return met.groupBy("id", "letter").agg(F.sum("s").alias("s"))


def random_ngram(items: DataFrame, seed: int) -> DataFrame:
    """(id, answer, score): the same features with weights between -1 and 1 that are drawn anew for each item, the first draw for
    its first feature, the next for the first that differs from it, and so on. An item is one row, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option, stem, scores = remembered(_text_parts), remembered(_stem_words), _random_scores(seed)
        for b in batches:
            told = []
            for i, (s, letters, ts) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                if letters:
                    told.append((i, *_best(letters, scores(stem(s), letters, [option(t) for t in ts]))))
            at, answers, sums = zip(*told, strict=True) if told else ((), (), ())
            yield pa.record_batch([b.column(3).take(pa.array(at, pa.int64())), pa.array(answers, pa.string()), pa.array(sums, pa.int64())], names=["id", "answer", "score"])

    return _rows(items, "id").mapInArrow(run, f"id {dict(items.dtypes)['id']}, answer string, score long")


def _random_scores(seed: int) -> Callable:
    """A function from a stem, letters and texts to the options' sums of an item's random weights."""
    weights: list[int] = []

    def scores(stem: tuple, letters: list[str | None], o: list[_Text]) -> list[int]:
        features = [_in_order(stem[0], x, more) for x, more in zip(o, _met(stem, letters, o), strict=True)]
        first = dict.fromkeys(f for fs in features for f in fs)
        while len(weights) < len(first):
            weights.extend(np.rint(UNIT * (draws(seed, np.arange(len(weights), len(weights) + 256) + 1) * 2 - 1)).astype(np.int64).tolist())
        drawn = dict(zip(first, weights, strict=False))
        return [sum(map(drawn.__getitem__, fs)) for fs in features]

    return scores


def _in_order(stem: frozenset[str], x: _Text, more: list[str | None]) -> list[str | None]:
    """An option's features in the order of option_features(): words with those that the stem has, 3-grams, cues, place, length."""
    words = x.own[: len(x.words)]
    if not stem.isdisjoint(x.words):
        words = [f for w in x.words for f in ((f"o:{w}", f"ov:{w}") if w in stem else (f"o:{w}",))]
    cues = [f for f in more[1:] if f[0] == "c"]  # more begins with the place; the rest are words and cues
    return [*words, *x.own[len(x.words) : -1], *cues, more[0], x.own[-1]]


def _best(letters: list[str | None], sums: list[int]) -> tuple[str | None, int]:
    """The letter with the largest sum, the first of equal ones, as Spark orders them: none before all others."""
    s, letter = min(zip((-x for x in sums), ((x is not None, x or "") for x in letters), strict=True))
    return (letter[1] if letter[0] else None), -s


def _shared(items: DataFrame, *keep: str, repeats: bool) -> DataFrame:
    """(keep.., letter, words): the stem's words that an option has, each as often as the stem has it if ``repeats``."""
    p, x = F.col("p"), F.col("x")
    stem = _long(T.tokens(p["stem"]))
    t = prepared(items, *keep).select(*keep, (stem if repeats else F.array_distinct(stem)).alias("stem"), F.explode(p["o"]).alias("x"))
    return t.select(*keep, x["letter"].alias("letter"), F.filter("stem", lambda w: F.array_contains(x["t"], w)).alias("words"))


def train_overlap(items: DataFrame) -> DataFrame:
    """(token, w): log((keys + 1) / (other options + 1)) of those that share the token with their stem, in billionths.

    A task counts its options; sums for each token are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        option, stem, counts = remembered(_text_parts), remembered(_stem_words), (Counter(), Counter())

        def told() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.record_batch(columns, names=["token", "rest", "keys"])

        for b in batches:
            for s, ts, hits in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                words = stem(s)[0]
                for t, hit in zip(ts or (), hits or (), strict=True):
                    counts[hit].update(words.intersection(option(t).words))
            if sum(map(len, counts)) > REMEMBERED:
                yield told()
        yield told()

    t = _rows(items, _hits().alias("hits")).mapInArrow(run, "token string, rest long, keys long").groupBy("token")
    return t.agg(F.rint(UNIT * F.ln((F.sum("keys") + 1) / (F.sum("rest") + 1))).cast("long").alias("w"))


def apply_overlap(model: DataFrame, items: DataFrame) -> DataFrame:
    """(id, answer, score) of items with options: the option whose words of the stem weigh most; null unless that is positive."""
    t = _shared(items, "id", repeats=True).select("id", "letter", F.explode_outer("words").alias("token"))
    t = t.join(model, "token", "left").groupBy("id", "letter").agg(F.sum(F.coalesce("w", F.lit(0))).alias("s"))
    return _first_best(t).withColumn("answer", F.when(F.col("score") > 0, F.col("answer")))


def format_number(v: Column) -> Column:
    """A whole number as it is, others with eight significant digits."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(F.format_string("%.7e", v).try_cast("double").cast("string"))


FORMULAS = ["div-a-b", "div-b-a", "mul-ab", "add-ab", "sub-abs", "mul-abc", "percent-of", "percent-down", "percent-up", "mean", "square"]


def formula_values(stem: Column) -> Column:
    """The value of each of FORMULAS over the numbers of a stem, as an array; null where a formula does not apply."""
    n = T.numbers(stem)
    a, b, c = (F.get(n, F.lit(i)) for i in range(3))
    p = F.nullif(F.regexp_extract(stem, r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double")
    other = F.get(F.filter(n, lambda x: x != p), F.lit(0))
    mean = F.when(F.size(n) >= 2, F.aggregate(n, F.lit(0.0), lambda s, x: s + x) / F.size(n))
    return F.array(F.try_divide(a, b), F.try_divide(b, a), a * b, a + b, F.abs(a - b), a * b * c, p / 100 * other, other * (1 - p / 100), other * (1 + p / 100), mean, a * a)


def formula_trials(items: DataFrame) -> DataFrame:
    """(id, formula, place, answer, correct) of numeric items (id, stem, key) and the formulas that apply to them."""
    t = items.select("id", "key", F.posexplode(formula_values(F.coalesce("stem", F.lit("")))).alias("place", "value")).filter("value is not null and not isnan(value) and abs(value) <> double('Infinity')")
    names = F.element_at(F.array(*map(F.lit, FORMULAS)), F.col("place") + 1)
    t = t.select("id", "key", "place", names.alias("formula"), format_number(F.col("value")).alias("answer"))
    return t.withColumn("correct", F.coalesce(T.answers_match(F.col("key"), F.col("answer")), F.lit(False))).drop("key")


def train_formula(trials: DataFrame) -> DataFrame:
    """(formula, hits): the formula with most right answers, the first of equal ones in the order of FORMULAS."""
    hits = trials.groupBy("formula", "place").agg(F.count_if("correct").alias("hits"))
    return hits.agg(F.min_by(F.struct("formula", "hits"), F.struct(-F.col("hits"), F.col("place"))).alias("b")).filter("b is not null").select("b.*")


def fitted_trials(program: str, answers: DataFrame, items: DataFrame) -> DataFrame:
    """Trials (id, program, answer, skipped, correct, chance, and the other columns of items) of (id, answer) rows."""
    judged = items.withColumn("chance", F.try_divide(F.lit(1.0), F.size("options"))).drop("options", "stem")
    t = judged.join(answers.select("id", "answer"), "id").withColumn("program", F.lit(program)).withColumn("skipped", F.col("answer").isNull())
    return t.withColumn("correct", F.when(~F.col("skipped"), F.lower(F.trim("answer")) == F.lower(F.trim("key")))).drop("key")


def all_trials(train: DataFrame, items: DataFrame, seed: int, direction: str) -> DataFrame:
    """fitted_trials() of fitted-ngram, fitted-overlap and random-ngram, each with /direction: models of ``train`` answer ``items``.

    Where every task can hold the models all three answer in one pass beside what an item is judged by: nothing is joined or
    shuffled. Ids must tell items apart."""
    weights, plain, size = _log_ratios(train_ngram(train))
    shared = stored(train_overlap(train))
    if max(size, shared.count()) > FEATURES_HELD:
        told = {"fitted-ngram": apply_ngram(train_ngram(train), items), "fitted-overlap": apply_overlap(shared, items), "random-ngram": random_ngram(items, seed)}
        tables = [fitted_trials(f"{name}/{direction}", t, items) for name, t in told.items()]
        return tables[0].unionByName(tables[1]).unionByName(tables[2])
    grams = {r.feature: r.w for r in weights.collect()}
    grams.pop(None, None)  # a feature that is null is equal to none
    models = items.sparkSession.sparkContext.broadcast((grams, {r.token: r.w for r in shared.collect()}))
    keep = [c for c in items.columns if c not in ("options", "stem")]
    rows = _rows(items, *keep)
    schema = S.StructType([*rows.schema.fields[3:], S.StructField("chance", S.DoubleType()), S.StructField("_a", S.ArrayType(S.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, overlap = models.value

        def parts(text: str | None) -> tuple[_Text, int]:
            x = _text_parts(text)
            return x, sum(known.get(f, plain) for f in x.own)

        def asked(text: str | None) -> tuple[tuple, list[str]]:
            return _stem_words(text), [w for w in option_parts(text)[1] if len(w) >= LETTERS]

        option, stem, random = remembered(parts), remembered(asked), _random_scores(seed)
        for b in batches:
            told, on, chance = [], [], []
            for i, (s, letters, ts) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                if not letters:
                    continue
                q, words = stem(s)
                o = [option(t) for t in ts]
                texts = [x for x, _ in o]
                ngram = [own + sum(known.get(f, plain) for f in more) for (_, own), more in zip(o, _met(q, letters, texts), strict=True)]
                common = [sum(overlap.get(w, 0) for w in words if w in x.words) for x in texts]
                if len(set(letters)) < len(letters):  # options of one letter count together
                    ngram, common = ([sum(v for v, y in zip(sums, letters, strict=True) if y == x) for x in letters] for sums in (ngram, common))
                letter, score = _best(letters, common)
                told += [_best(letters, ngram)[0], letter if score > 0 else None, _best(letters, random(q, letters, texts))[0]]
                on.append(i)
                chance.append(1.0 / len(letters))
            kept = pa.array(on, pa.int64())
            answers = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1, dtype=np.int32) * 3), pa.array(told, pa.string()))
            yield pa.record_batch([*(c.take(kept) for c in b.columns[3:]), pa.array(chance, pa.float64()), answers], names=schema.names)

    programs = ("fitted-ngram", "fitted-overlap", "random-ngram")
    told = F.explode(F.array(*(F.struct(F.lit(f"{p}/{direction}").alias("program"), F.get("_a", F.lit(i)).alias("answer")) for i, p in enumerate(programs))))
    t = rows.mapInArrow(run, schema).select(*keep, "chance", told.alias("t")).select(*keep, "chance", "t.program", "t.answer")
    t = t.withColumn("skipped", F.col("answer").isNull())
    return t.withColumn("correct", F.when(~F.col("skipped"), F.lower(F.trim("answer")) == F.lower(F.trim("key")))).drop("key")


def held_out_ladder(trials: DataFrame, slices: dict[str, Column], rungs: DataFrame) -> DataFrame:
    """The rows of ``rungs`` (step, program, train_slice, n_train, slice, random_program) with what their trials gave.

    ``slices`` are conditions on trials. Rows carry attempted, scored, skipped and correct counts, pass_rate, chance, the rate of
    the random program over the slice (chance where it has none), the interval, whether it beats chance, and a note. The
    trials are counted once for all slices; ``rungs`` is a list of a few rows."""
    names = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in slices.items())))
    counted = trials.withColumn("slice", F.explode(names)).groupBy("program", "slice").agg(
        F.count("*").alias("attempted"), F.count("correct").alias("n_scored"), F.count_if("skipped").alias("skipped"), F.count_if("correct").alias("n_correct"), F.avg(F.when(F.col("correct").isNotNull(), F.coalesce("chance", F.lit(0.0)))).alias("chance"), F.avg(F.col("correct").cast("double")).alias("rate")
    )
    counted = stored(counted)  # a few rows that are read twice: all trials would be made as often
    null = counted.select(F.col("program").alias("random_program"), "slice", F.col("rate").alias("random_rate"))
    t = rungs.join(counted, ["program", "slice"], "left").join(null, ["random_program", "slice"], "left")
    t = t.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("attempted", "n_scored", "skipped", "n_correct")} | {"pass_rate": F.coalesce("rate", F.lit(0.0)), "chance": F.coalesce("chance", F.lit(0.0))})
    t = with_interval(t.withColumn("random_baseline", F.coalesce("random_rate", "chance")).drop("rate", "random_rate"))
    t = t.withColumn("beats", F.coalesce(F.col("lo") > F.col("chance"), F.lit(False))).withColumn("eligible", F.col("beats") & (F.col("n_scored") >= LEAST_WITNESS))
    note = F.when(F.col("attempted") == 0, "no trials").when(F.col("n_scored") == 0, "abstained on all").when(F.col("eligible"), "beats chance").when(F.col("beats"), "beats chance, too few").otherwise("does not beat chance")
    return t.withColumn("note", note)
