"""Ranked lexical search: document-at-a-time merging of compressed postings.

The index is a table. A task cuts its documents into shards of a bounded number of postings; a shard's documents are
numbered by ascending doc_id, and each term's postings (number gaps and frequencies) are packed as variable-length bytes.
A search reads the postings of its terms, and in each shard merges them with a heap of list heads: the documents come in
ascending order, and a bounded heap keyed by score, then doc_id keeps the best. A list's best score bounds what it can add;
lists that together cannot lift a document over the worst one kept are no longer merged but looked up. The shards' heaps are
merged at last. No word is a key of a shuffle but for the counts of the query's terms."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, materialize

TOP = 10
#: Postings of a shard, at most but for its last document's.
SHARD = 2_000_000
#: Rows (item, term) that one reading of the index serves.
QUERY_ROWS = 100_000
INDEX = "shard long, term string, n long, total long, blob binary"
#: Bytes of terms as they are, all others as spaces; bytes from 128 on belong to terms, so UTF-8 need not be decoded.
_TERMS = bytes(c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TERMS).split()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of numbers (seven bits each, the high bit set on all but the last), and each one's length."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        more = (size[on] > k + 1).astype(np.uint8) << 7
        out[ends[on] - size[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def unpack(blob: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(blob < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        on = first + k <= last
        out[on] |= (blob[first[on] + k].astype(np.int64) & 127) << (7 * k)
    return out


class _Shard:
    """The postings of a shard while a task gathers them."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.names: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if not terms:
            return
        counts, names = Counter(terms), self.names
        which = np.fromiter((names.setdefault(t, len(names)) for t in counts), np.int32, len(counts))
        self.parts.append((which, np.fromiter(counts.values(), np.int32, len(counts))))
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.postings += len(counts)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row for the documents (term null), then one for each term."""
        n, none = len(self.ids), np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, none))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        sizes = np.array(self.sizes, np.int64)
        docs = ids[order].tobytes() + sizes[order].tobytes() + none[order].astype(np.int8).tobytes()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        batch = lambda *cols: pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "term", "n", "total", "blob"])
        yield batch([shard], [None], [n], [int(sizes.sum())], [docs])
        term = np.concatenate([p[0] for p in self.parts])
        tf = np.concatenate([p[1] for p in self.parts])
        doc = np.repeat(number, [len(p[0]) for p in self.parts])
        by = np.lexsort((doc, term))
        term, tf, doc = term[by], tf[by], doc[by]
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        gap = np.diff(doc, prepend=0)
        gap[starts] = doc[starts]
        packed, size = pack(np.stack([gap, tf], axis=1).ravel())
        bounds = np.concatenate(([0], np.cumsum(size)))[2 * np.append(starts, len(term))]
        names, whole = list(self.names), packed.tobytes()
        counts = np.diff(np.append(starts, len(term)))
        for at in range(0, len(starts), 10_000):
            some = range(at, min(at + 10_000, len(starts)))
            yield batch([shard] * len(some), [names[term[starts[i]]].decode("utf-8", "replace") for i in some], counts[at : at + 10_000], [None] * len(some), [whole[bounds[i] : bounds[i + 1]] for i in some])


def build_index(docs: DataFrame, at: str | None = None, shard: int = SHARD) -> str:
    """Write the index of ``docs`` (doc_id, text) in folder ``at`` (a new one in the shared folder if None), and return it.

    Documents without a term are not in it."""
    bound_batches(docs.sparkSession)
    at = at or fresh_path(docs.sparkSession, "lexical_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.add(doc_id, text or b"")
                if held.postings >= shard:
                    yield from held.rows((part << 32) + k)
                    k, held = k + 1, _Shard()
        if held.ids:
            yield from held.rows((part << 32) + k)

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX).write.parquet(at)
    return at


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q): how often each term stands in the texts of an item; rows that share an item_id are one item."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("q"))


def best_of_shard(lists: list[tuple[list[int], list[int], int]], top: int) -> list[tuple[int, int]]:
    """(score, -document) of the ``top`` best documents of lists (ascending documents, their scores, the largest score)."""
    lists = sorted(lists, key=lambda x: x[2])
    docs, scores = [x[0] for x in lists], [x[1] for x in lists]
    below = [0]  # what the first i lists can add together
    for x in lists:
        below.append(below[-1] + x[2])
    at, kept, least, split = [0] * len(lists), [], 0, 0
    heads = [(d[0], i) for i, d in enumerate(docs)]
    heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            score += scores[i][at[i]]
            at[i] += 1
            if at[i] < len(docs[i]):
                heapreplace(heads, (docs[i][at[i]], i))
            else:
                heappop(heads)
        for i in range(split - 1, -1, -1):
            if score + below[i + 1] <= least:
                break
            at[i] = k = bisect_left(docs[i], doc, at[i])
            if k < len(docs[i]) and docs[i][k] == doc:
                score += scores[i][k]
        if score > least:  # later documents of an equal score come after
            if len(kept) < top:
                heappush(kept, (score, -doc))
            else:
                heapreplace(kept, (score, -doc))
            if len(kept) == top and kept[0][0] > least:
                least = kept[0][0]
                was = split
                while split < len(lists) and below[split + 1] <= least:
                    split += 1
                if split > was:
                    heads = [h for h in heads if h[1] >= split]
                    heapify(heads)
    return kept


def search(spark, index: str, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of ``index`` for each item of ``items`` (item_id, text).

    Scores are whole numbers; equal scores come by ascending doc_id, a null doc_id last, and only scores above 0 are
    returned. Items without a term that some document holds have no rows. Rows of documents that share a doc_id rank
    each for itself; rows of items that share an item_id (null included) are one item."""
    table = spark.read.schema(INDEX).parquet(index)
    n, total = table.filter("term is null").agg(F.sum("n"), F.sum("total")).first()
    asked = materialize(query_terms(items))
    held = table.filter("term is not null").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n or 0) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = materialize(asked.join(held, "term").select("item_id", "term", "q", weight.cast("long").alias("w")).filter("w > 0"))
    n_blocks = weighted.count() // QUERY_ROWS + 1
    found = fresh_path(spark, "lexical_found")
    for k in range(n_blocks):
        block = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        _search_block(table, block, n, total, top, dict(items.dtypes)["item_id"]).write.mode("append").parquet(found)
    best = spark.read.parquet(found)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.select("item_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= top)


def _search_block(table: DataFrame, block: DataFrame, n: int, total: int, top: int, kind: str) -> DataFrame:
    """The best documents of each shard for a block of items, whose rows (at most about QUERY_ROWS) go to every task."""
    weights, wanted = {}, {}
    for r in block.collect():
        weights[r.term] = r.w
        wanted.setdefault(r.item_id, []).append((r.term, r.q))
    names = block.select("term").distinct()
    needed = table.join(F.broadcast(names), "term", "left_semi").unionByName(table.filter("term is null"))
    schema = f"item_id {kind}, doc_id long, score long"
    ids_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(shard: pa.Table) -> pa.Table:
        docs, lists = None, {}
        terms, blobs = shard.column("term").to_pylist(), shard.column("blob").to_pylist()
        m_docs = blobs[terms.index(None)]
        size = len(m_docs) // 17
        docs = np.frombuffer(m_docs, np.int64, size)
        lengths = np.frombuffer(m_docs, np.int64, size, 8 * size)
        none = np.frombuffer(m_docs, np.int8, size, 16 * size)
        m = 25 + (75 * lengths * n) // total
        for term, blob in zip(terms, blobs, strict=True):
            if term is not None:
                both = unpack(np.frombuffer(blob, np.uint8)).reshape(-1, 2)
                at, tf = np.cumsum(both[:, 0]), both[:, 1]
                score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
                lists[term] = at.tolist(), score.tolist(), int(score.max())
        rows = []
        for item, asked in wanted.items():
            own = []
            for term, q in asked:
                if term in lists and lists[term][2] > 0:
                    at, score, most = lists[term]
                    own.append((at, score if q == 1 else [q * s for s in score], q * most))
            rows += [(item, None if none[-d] else int(docs[-d]), s) for s, d in best_of_shard(own, top)]
        kinds = (ids_type, pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["item_id", "doc_id", "score"])

    return needed.groupBy("shard").applyInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """search() over an index of all ``docs`` (doc_id, text). A null text has no terms, a very long one is one document, an
    empty table of either kind gives no rows, other columns are not read."""
    return search(docs.sparkSession, build_index(docs), items.select("item_id", "text"), top)


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SQL_TERMS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PATTERN}')) AS term"
ORACLE = f"""WITH d AS (SELECT doc_id, {_SQL_TERMS} FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
z AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id), g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM z), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, {_SQL_TERMS} FROM benchmark), s AS (SELECT item_id, p.doc_id,
 sum(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
 FROM q JOIN p USING (term) JOIN f USING (term) JOIN z ON z.doc_id = p.doc_id CROSS JOIN g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {TOP}"""
