"""Token ids in a fixed-width bit-packed file format.

A file is a Parquet file whose rows are blocks, so any store that Spark writes can hold it, and lost tasks are written
again by Spark's commit protocol. A block holds whole documents in ascending doc_id order: their ids and lengths, the
number of ids before it in its part, and the payload, each token id in ``width`` bits (the fewest that hold the largest
id of the vocabulary), least significant bit first. Id k of a block begins at bit k * width, so a range of ids is
unpacked with numpy without reading what stands before it. The index table holds how many ids come before each part;
it has one row for each part."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path

END_ID = 1
#: Ids in a block; the document that passes it ends the block.
BLOCK_IDS = 1 << 16


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a block, reading only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    lo, hi = first * width, (first + n) * width
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + n * width]
    return (bits.reshape(n, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode (doc_id, text) and write blocks and index below ``path``, in ascending doc_id order (null first).

    A null text is empty: the document is its end id alone. Rows that share a doc_id stand one after another, ordered by
    the hash of their text; an empty table writes no block. Other columns are not read."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from .words import tokenizer

    top = max(tokenizer(tokenizer_path).get_vocab_size() - 1, end_id)
    width = max(1, top.bit_length())

    # equal ids of rows that share a doc_id may part, so no doc_id is bound to one task; text is dealt out, not what is
    # made of it, as the ranges are found in a first reading which would otherwise encode everything twice
    salted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = salted.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .words import id_table

        part, known = TaskContext.get().partitionId(), id_table(tokenizer_path)
        before, held, some = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal before, some
            sizes = [len(x) for _, x in held]
            ids = np.concatenate([x for _, x in held])
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()), pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids, width)], pa.binary())],
                names=["part", "before", "n_ids", "width", "doc_ids", "sizes", "payload"],
            )
            before, some = before + len(ids), 0
            held.clear()
            return row

        end = np.array([end_id], np.uint32)
        for b in batches:
            ids, counts = known.encode(b.column(1).to_pylist())
            stops = np.cumsum(counts).tolist()
            for d, s, e in zip(b.column(0).to_pylist(), [0, *stops], stops, strict=False):
                held.append((d, np.concatenate((ids[s:e], end))))
                some += e - s + 1
                if some >= block_ids:
                    yield close()
        if held:
            yield close()

    made = dealt.select("doc_id", "text").mapInArrow(block, "part int, before long, n_ids long, width int, doc_ids array<long>, sizes array<long>, payload binary")
    made.write.parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    upto = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts.select("part", F.coalesce(upto, F.lit(0)).cast("long").alias("base")).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"]).astype("<u4")
                stops = np.cumsum(r["sizes"])
                starts = stops - np.array(r["sizes"], np.int64)
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["base"] + r["before"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    index = F.broadcast(spark.read.parquet(f"{path}/index"))  # one row for each part, however large the table
    return blocks.join(index, "part").select("base", "before", "n_ids", "width", "doc_ids", "sizes", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to ``path`` (a new folder in the shared one if None) and read the files back."""
    at = path or fresh_path(docs.sparkSession, "token_ids")
    write_ids(docs, at, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, at)
