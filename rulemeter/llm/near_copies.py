"""Near copies of texts: sets of five-word shingles with a Jaccard similarity of at least 0.8, decided exactly.

A difference of three bits, op5's contract, is far below what such copies differ in (10 bits of 64 in the mean at 0.8).
Texts of equal words are one class. Classes meet under BANDS keys of ROWS minima of their shingles' hashes, and those
whose SimHash fingerprints differ in at most MAX_BITS bits are brought into one block by a spanning forest. A pair at
0.8 shares no key with a probability of 3e-6. Within a block the shingle sets themselves are compared, so that the keys
and the fingerprints only say which pairs are looked at. A block of more than TILE texts is compared in pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, sized
from .components import components
from .simhash import CHUNK, SEED, _Forest, _linker

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, MAX_BITS = 32, 5, 24
#: Texts of a block that one task compares, a long text counting for one more with each LONG characters.
TILE, LONG = 512, 1 << 15

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The hash of the text's words, and the sorted distinct hashes of its shingles; a shorter text is one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return digest(joined, SEED), np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts, stops = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return digest(joined, SEED), np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The SimHash fingerprint of a set of shingle hashes, and its band keys."""
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK // 16):
        h = hashes[at : at + CHUNK // 16]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for i in range(0, BANDS * ROWS, 16):
            least[i : i + 16] = np.minimum(least[i : i + 16], ((h ^ _XOR[i : i + 16, None]) * _ODD[i : i + 16, None]).min(axis=1))
    fp = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0]
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return int(fp), (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, fp, size, keys); a text without words has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [shingles(t) for t in texts]
            told = [sketch(h) if len(h) else (0, np.empty(0, np.int64)) for _, h in found]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) for _, k in told)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(k for _, k in told)])))
            yield pa.record_batch(
                [b.column(0), pa.array(np.array([c for c, _ in found], np.uint64).view(np.int64)), pa.array([f for f, _ in told], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), keys],
                names=["doc_id", "cls", "fp", "size", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, cls long, fp long, size long, keys array<long>")


def similar_edges(names: list[int], sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """(name, smallest name of its component) by the pairs of sets with a Jaccard similarity of at least ``least``; not of the smallest."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark, left, forest = np.zeros(int(flat.max()) + 1, np.int32), np.ones(len(sets), bool), _Forest()
    for first in range(len(sets)):
        frontier = [first] if left[first] else []
        left[first] = False
        while frontier and left.any():
            x = frontier.pop()
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            near = left & (shared >= least * (sizes + sizes[x] - shared) - 1e-9)
            for y in np.flatnonzero(near).tolist():
                forest.link(names[x], names[y])
                frontier.append(y)
            left &= ~near
    return [(x, r) for x in forest.up if (r := forest.root(x)) != x]


def _verified(tiles: DataFrame) -> DataFrame:
    """(a, b, whole): classes a and their roots b, from rows (block, i, j, k, cls, text) sorted by the first three; ``whole``
    where the block is a single tile, so that b is final."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1 and (edges := similar_edges(list(sets), list(sets.values()))):
                ends = [pa.array([e[n] for e in edges], pa.int64()) for n in (0, 1)]
                yield pa.record_batch([*ends, pa.array([key[3] == 1] * len(edges))], names=["a", "b", "whole"])

        key, sets = None, {}
        for b in batches:
            for *at, cls, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != key:
                    yield from told()
                    key, sets = at, {}
                own, hashes = shingles(text)
                if own - (own >> 63 << 64) == cls:  # rows may share an id and differ in text
                    sets[cls] = hashes
        yield from told()

    return tiles.mapInArrow(run, "a long, b long, whole boolean")


def near_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` (doc_id, text) with a doc_id.

    component_id is the smallest doc_id reachable through texts of equal words or of a Jaccard similarity of at least
    SIMILAR. Null and empty texts are equal. Other columns are not read."""
    bound_batches(docs.sparkSession)
    ours = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(_sketches(ours))
    # rows of a class have equal fingerprints and keys
    classes = materialize(rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.max("size").alias("size"), F.min("keys").alias("keys")))
    n, many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count()
    dealt = classes.select(F.explode("keys").alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
    found = materialize(dealt.mapInArrow(_linker(1, MAX_BITS, None), "a long, b long, hot boolean"))
    blocks = components(found.select("a", "b")).select(F.col("node").alias("fp"), F.col("component").alias("block"))
    held = classes.filter(F.size("keys") > 0).join(blocks, "fp", "left").select("cls", "least", F.coalesce("block", "fp").alias("block"), (1 + F.col("size") / LONG).alias("size"))
    held = materialize(sized(held, many))
    weight = held.groupBy("block").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / tile).cast("int").alias("k")).filter("n > 1")
    placed = held.join(weight, "block").withColumn("t", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    placed = materialize(sized(placed.select("least", "cls", "block", "k", "t"), many))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = pairs.select(F.col("least").alias("doc_id"), "cls", "block", "k", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))
    tiles = ours.join(pairs, "doc_id").select("block", "i", "j", "k", "cls", "text").repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    found = materialize(_verified(tiles))
    same = components(found.filter("not whole")).unionByName(found.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("component")))
    same = same.withColumnRenamed("node", "cls")
    grouped = classes.select("cls", "least").join(same, "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("root"))
    grouped = materialize(sized(grouped, many))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialize(sized(grouped.join(least, "root").select("cls", "component_id"), many))
    return rows.select("doc_id", "cls").join(member, "cls").select("doc_id", "component_id")


def keep_first(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are the first of their group: doc_id = component_id.

    ``links`` (a, b) are further links between doc_ids that make groups. Of rows that share a doc_id one stays; rows with a
    null doc_id stay."""
    found = materialize(near_copies(docs))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    if links is not None:
        edges = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(links)
        gone = components(edges).filter("node <> component").select(F.col("node").alias("doc_id"))
    kept = docs.join(materialize(gone), "doc_id", "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
