"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits, one per majority vote of the hashes of the text's word shingles. Two fingerprints that differ
in at most three bits, cut into two halves, have a half that differs in at most one bit. So each distinct fingerprint is
indexed under its 64 one-wildcard half variants (a half with one bit deleted, and the deleted position); equal keys are
brought together and verified by the exact number of differing bits. Only a spanning forest of each key's links leaves a
task, never its pairs. A key shared by more than HOT_RUN fingerprints goes to a second pass which indexes the other half
in the same way (two quarters, one of which differs in at most one bit); a key there has at most 2^18 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Fingerprints of one key which one task verifies at once; more go to the second pass.
HOT_RUN = 1 << 16
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 17


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero for texts without words. Chunks of hashes bound the memory of long texts."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def count() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([n for _, n in owners])
        sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.int64)
        for (i, _), row in zip(owners, sums, strict=True):
            ones[i] += row
        hashes.clear()
        owners.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        k = min(shingle, len(words))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
        stops = ends[k - 1 :].tolist()
        total[i] = len(starts)
        for at in range(0, len(starts), CHUNK):
            new = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
            hashes += new
            owners.append((i, len(new)))
            if len(hashes) >= CHUNK:
                count()
    count()
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    out[:] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1) if len(texts) else out
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text is empty; other columns are ignored."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist(), shingle).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of signed numbers it counts the bits of the absolute value


class _Forest:
    """Union-find over the fingerprints that have links in this task; an edge leaves only if it joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _link_run(fps: np.ndarray, forest: _Forest, most: int) -> None:
    """Spanning links of one key's fingerprints: each is taken once from a frontier and compared with all not yet reached."""
    left = np.unique(fps)
    while left.size > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            x = frontier.pop()
            near = _bit_count(left ^ x) <= most
            if near.any():
                for y in left[near].tolist():
                    forest.link(int(x), y)
                    frontier.append(np.int64(y))
                left = left[~near]


def _linker(n_keys: int, most: int, hot_run: int | None):
    """For mapInArrow over rows (key.., fp) sorted by key: edges (a, b), and the rows of hot keys as (key, fp, hot)."""

    def flush(k: np.ndarray, fp: np.ndarray, forest: _Forest) -> None:
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        starts = np.concatenate(([0], cut))
        sizes = np.diff(np.concatenate((starts, [len(k)])))
        small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
        ks, fs = k[small], fp[small]
        for d in range(1, int(sizes[(sizes > 1) & (sizes <= 32)].max(initial=1))):
            hit = np.flatnonzero((ks[d:] == ks[:-d]) & (_bit_count(fs[d:] ^ fs[:-d]) <= most))
            for a, b in zip(fs[hit].tolist(), fs[hit + d].tolist(), strict=True):
                forest.link(a, b)
        for i in np.flatnonzero(sizes > 32):
            _link_run(fp[starts[i] : starts[i] + sizes[i]], forest, most)

    def out(forest: _Forest, hot: list[tuple[int, np.ndarray]] = ()) -> Iterator[pa.RecordBatch]:
        a, b = (np.array([e[i] for e in forest.edges], np.int64) for i in (0, 1))
        forest.edges = []
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], names=["a", "b", "hot"])
        for key, fps in hot:
            yield pa.record_batch([pa.array(np.full(len(fps), key, np.int64)), pa.array(fps), pa.array(np.ones(len(fps), bool))], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held_k, held_f, hot_key = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            k = cols[0]
            if n_keys == 2:
                # one number for each key pair within this sorted stream: the pairs of a partition are compared for equality only
                k = cols[0] * np.int64(1000003) ^ (cols[1] + (cols[0] << np.int64(17)))
            k, f = np.concatenate((held_k, k)), np.concatenate((held_f, cols[-1]))
            held_k, held_f = k[:0], f[:0]
            if hot_key is not None:
                same = k == hot_key
                if same.any():
                    yield from out(forest, [(hot_key, f[same])])
                k, f = k[~same], f[~same]
                if not len(k):
                    continue
                hot_key = None
            others = np.flatnonzero(k != k[-1])
            last = int(others[-1]) + 1 if len(others) else 0  # from here on: the last key, whose run may go on
            held_k, held_f = k[last:], f[last:]
            if last:
                flush(k[:last], f[:last], forest)
            if hot_run and len(held_k) > hot_run:
                hot_key = int(held_k[0])
                yield from out(forest, [(hot_key, held_f)])
                held_k, held_f = held_k[:0], held_f[:0]
            yield from out(forest)
        if len(held_k):
            flush(held_k, held_f, forest)
        yield from out(forest)

    return run


def _variants(fp, first: int, widths: tuple[int, ...]):
    """Array of keys: for each segment (of the given bit widths, from bit ``first``) and deleted bit: segment, bit and the other bits."""
    keys, at = [], first
    for w in widths:
        for i in range(at, at + w):
            mask = ((1 << w) - 1) << at & ~(1 << i)
            mask -= (mask >> 63) << 64
            keys.append(F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask).cast("long")), at).bitwiseOR(F.lit(i << 32).cast("long")))
        at += w
    return F.array(*keys)


def links(fps: DataFrame, most: int = MAX_BITS, hot_run: int = HOT_RUN) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components equal those of all links up to ``most`` <= 3 bits."""
    keyed = fps.select("fp", F.explode(_variants(F.col("fp"), 0, (32, 32))).alias("key")).select("key", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "fp")
    found = materialize(dealt.mapInArrow(_linker(1, most, hot_run), "a long, b long, hot boolean"))
    edges = found.filter("not hot").select("a", "b")
    hot = found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not hot.isEmpty():
        # the key's deleted bit tells its half; the fingerprints differ by up to three bits in the other half
        other = F.when(F.shiftright("key", 32) < 32, _variants(F.col("fp"), 32, (16, 16))).otherwise(_variants(F.col("fp"), 0, (16, 16)))
        deeper = hot.select("key", F.explode(other).alias("sub"), "fp").repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "fp")
        more = materialize(deeper.mapInArrow(_linker(2, most, None), "a long, b long, hot boolean"))
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS, hot_run: int = HOT_RUN) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable through fingerprints at ``most`` or fewer differing bits. Null and
    empty texts have fingerprint zero and are linked like others. Rows with a null doc_id keep their fingerprint, and
    the smallest doc_id of their component, or null. Repeated rows give repeated rows; an empty table gives none.
    Columns other than doc_id and text are not read."""
    rows = materialize(with_fingerprints(docs, shingle))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes.select("fp"), most, hot_run)).withColumnRenamed("node", "fp")
    grouped = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = materialize(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    member = materialize(grouped.join(least, "root").select("fp", "component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(member, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are the first of their group: doc_id = component_id.

    Of rows that share a doc_id one stays; rows with a null doc_id stay."""
    found = materialize(near_duplicates(docs, shingle, most))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(materialize(gone), "doc_id", "left_anti").select(*docs.columns)
    if found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
