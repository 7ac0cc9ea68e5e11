"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Of two words one edit apart, the shorter of m letters, the first or the last m // 2 letters are the same. So each word of l
letters stands in blocks of shared prefixes (the forward dictionary) and of shared suffixes (the reversed one), for m = l
and m = l - 1. Sorted blocks are scanned and their pairs verified. What is left of two words of a block is again one edit
apart, so a block of more than BLOCK words is divided in the same way by halves of the rest, until one letter is left; such a
block is bounded by the alphabet. Each pair belongs to one block: a suffix step holds only those that the prefix step does
not. No pair leaves a task, only each word's count and best neighbour."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .components import _flatten

#: A run is misspelt where this number divides its hash.
MISSPELT = 199
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words that a block is scanned with at most, and distinct words that a task holds before it hands them on.
BLOCK, HELD = 64, 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The runs of a text, A-Z lower-cased, some with a letter deleted by their hash, and how often each stands."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def dictionary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts with at least ``least_chars`` code points and ``least_count`` occurrences."""
    bound_batches(docs.sparkSession)

    def told(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    if len(word) >= least_chars:
                        held[word] += n
            if len(held) > HELD:
                yield told(held)
                held = Counter()
        if held:
            yield told(held)

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _divide(t: DataFrame) -> DataFrame:
    """Each entry under the half in front and the half at the end of its rest; ``m`` letters are left of the shorter word."""
    k = F.floor(F.col("m") / 2).cast("int")
    front, end = F.substring("rest", F.lit(1), k), F.substring("rest", F.length("rest") - k + 1, k)
    step = lambda side, part, rest: F.struct(F.concat("key", F.lit(f"|{side}"), k.cast("string"), F.lit(":"), part).alias("key"), (F.col("m") - k).alias("m"), rest.alias("rest"))
    both = F.array(step("p", front, F.substring("rest", k + 1, F.length("rest"))), step("s", end, F.substring("rest", F.lit(1), F.length("rest") - k)))
    return t.select("word", "n", F.explode(both).alias("e")).select("word", "n", "e.*")


def blocks(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(key, word, n): the blocks in which words are compared, of at most ``block`` words where letters are left to divide by."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1))
    t = _divide(words.select("word", "n", m.alias("m"), F.col("word").alias("rest")).filter(F.col("m") >= least_chars).withColumn("key", F.col("m").cast("string")))
    done = None
    while True:
        large = materialize(t.filter("m > 1").groupBy("key").count().filter(F.col("count") > block).select("key"))
        small = t.join(large, "key", "left_anti").select("key", "word", "n")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        t = materialize(_divide(t.join(large, "key", "left_semi")))


def near_in_block(key: str, words: list[str], counts: list[int]) -> dict[str, tuple[int, int, str]]:
    """Of the words of a block: how many of the others are near it by this block, and the count and name of the best of them."""
    m, *path = key.split("|")
    steps = [(s[0], int(s[1 : s.index(":")])) for s in path]
    m = int(m)
    shorter = [i for i, w in enumerate(words) if len(w) == m]
    longer = [i for i, w in enumerate(words) if len(w) > m]
    out: dict[str, tuple[int, int, str]] = {}

    def add(i: int, j: int) -> None:
        n, top, best = out.get(words[i], (0, -1, ""))
        if counts[j] > top or (counts[j] == top and words[j] < best):
            top, best = counts[j], words[j]
        out[words[i]] = n + 1, top, best

    def pair(i: int, j: int) -> None:
        a, b, p = words[i], words[j], 0
        while p < m and a[p] == b[p]:
            p += 1
        if a[p + 1 :] != b[p + 1 :] if len(b) == m else a[p:] != b[p + 1 :]:
            return
        at = 0
        for side, k in steps:
            if side == "p":
                at += k
            elif p - at >= k:  # the prefix step holds this pair
                return
        add(i, j)
        add(j, i)

    for x, i in enumerate(shorter):
        for j in shorter[x + 1 :]:
            pair(i, j)
        for j in longer:
            pair(i, j)
    return out


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have near words: how many, and the one of largest n, then smallest."""
    bound_batches(words.sparkSession)
    kinds = {"word": pa.string(), "c": pa.int64(), "near": pa.string(), "near_n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def scan() -> list[tuple]:
            if len(held) < 2:
                return []
            return [(w, c, best, top) for w, (c, top, best) in near_in_block(key, [w for w, _ in held], [n for _, n in held]).items()]

        for b in batches:
            rows = []
            for k, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    rows += scan()
                    key, held = k, []
                held.append((w, n))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
        rows = scan()
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    # dealt by a hash of the key: by the key itself the joins' exchange would do, which AQE drops where it makes them broadcasts
    sorted_ = blocks(words, least_chars, block).repartition(F.xxhash64("key")).sortWithinPartitions("key", "word")
    found = sorted_.mapInArrow(run, "word string, c long, near string, near_n long")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), best.alias("b")).select("word", "n_near", "b.near", "b.near_n")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of dictionary(``docs``).

    A word's form is its near word of largest n (then the smallest) if that is at least ``ratio`` times its own; root is the
    last of the forms from a word on. Null and empty texts have no words, a null doc_id is written as nothing in the hash,
    repeated rows count each, a very long text is one text, an empty table gives no rows; other columns are not read."""
    words = materialize(dictionary(docs))
    near = near_words(words)
    fits = F.col("near_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n")
    )
    told = materialize(told)
    forms = told.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent"))
    roots = _flatten(forms, forms.count()).select(F.col("node").alias("word"), "root")  # n grows from form to form, so that chains end
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
