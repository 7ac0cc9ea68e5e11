"""Toxicity by compression distance.

Two zstandard dictionaries, one of toxic and one of ordinary text: each holds the word beginnings that stand in many
different contexts of its class and far fewer of the other's. Counting contexts (pairs of a word and the one before it),
not documents, keeps copied passages out. An entry has the MIN_MATCH bytes that a match needs, the space before the word
among them, so that only whole entries match: a word of four letters or fewer as it stands (short ones are filled up), or
the first five letters of a longer one. Their content is chosen by this contrast because zstandard's own trainer, which
knows one class only, fills both with the prose that the classes share (its held-out recall is 0.03, see the README).

A text is cut into windows of WINDOW words, in each of which a word stands once: a match with the window's own text would
hide one with a dictionary. Each window is compressed with either dictionary, a run of one byte before and another behind
it, and the differences of the lengths are the only features: the bytes that the toxic dictionary saves, those that the
ordinary one saves, the number of windows, and whether the toxic dictionary is ahead in one window and in two. A logistic
curve fitted on other labelled documents turns them into a score. Literals are left uncompressed, so a window's difference
is what its matches with the dictionaries save."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Labelled documents that the dictionaries (of each class) and the curve are fitted on. Their texts stay on the executors
#: and are taken whole; the driver gets ids, chosen beginnings and five features a document.
DICT_DOCS, CURVE_DOCS = 1500, 6000
WINDOW, DICT_BYTES, MIN_MATCH = 4, 4096, 6
#: A beginning is a class's own if it is RATIO times as frequent as in the other, in enough contexts, and SIGMAS standard
#: deviations above the count that the other's rate would give.
RATIO, MIN_CONTEXTS, CONTEXT_SHARE, SIGMAS, PREFIX = 5.0, 3, 7.5e-5, 4.0, 6
THRESHOLD = 0.3  # given; the window, the features and the form of entries were chosen on a quarter of the labels that is not held out

_SPACED = bytes(32 if c < 32 or chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
#: Between the segments of a dictionary; no word holds such a byte.
_GAP = b"\x01"
#: Ends a dictionary, whose last bytes zstandard doesn't look up.
_TAIL = b"\x03" * 16
#: Stands before every window: a block that saves nothing would be stored raw, and its matches would not show.
_SAVES = b"\x02" * 128
#: Stands behind every window, whose own end would not be looked up either.
_END = b"\x04" * 16
#: Words of fewer letters are filled up to so many.
_SHORT, _FILL = 4, b"\x05"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words, one byte for each code point, cut at ASCII punctuation and white space, short ones filled up."""
    low = text.lower()
    try:
        b = low.encode("latin-1")
    except UnicodeEncodeError:  # other scripts share the upper half
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        b = np.where(c < 256, c, 128 + c % 128).astype(np.uint8).tobytes()
    return [w.ljust(_SHORT, _FILL) for w in b.translate(_SPACED).split()]


def window(words: list[bytes]) -> bytes:
    """What is compressed of a window: its words, each once, between spaces."""
    return _SAVES + b" " + b" ".join(dict.fromkeys(words)) + b" " + _END


def _contexts(texts: DataFrame) -> DataFrame:
    """(use, begin, context) of every word of rows (use, text): its beginning, and a hash of it with the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for use, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text or "")
                told = {((b" " + w + b" ")[:PREFIX], xxhash.xxh64_intdigest(v + b" " + w) - (1 << 63)) for v, w in zip([b"", *words], words, strict=False)}
                yield pa.record_batch([pa.array([use] * len(told), pa.int32()), pa.array([w for w, _ in told], pa.binary()), pa.array([c for _, c in told], pa.int64())], names=["use", "begin", "context"])

    return texts.mapInArrow(run, "use int, begin binary, context long")


def _own(texts: DataFrame) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, from rows (use, text) with use 1 and 0. At most 1 / CONTEXT_SHARE beginnings of
    a class pass the test, so what reaches the driver is bounded."""
    seen = materialize(_contexts(texts).distinct().groupBy("begin").agg(F.count_if(F.col("use") == 1).alias("c1"), F.count_if(F.col("use") == 0).alias("c0")))
    n1, n0 = seen.agg(F.coalesce(F.sum("c1"), F.lit(0)), F.coalesce(F.sum("c0"), F.lit(0))).first()
    out = []
    for mine, n, other, m in (("c1", n1, "c0", n0), ("c0", n0, "c1", n1)):
        k, chance = F.col(mine), (F.col(other) + 0.5) / (m + 1) * n
        ok = (k >= max(MIN_CONTEXTS, CONTEXT_SHARE * n)) & (k + 0.5 > RATIO * chance) & (k - chance > SIGMAS * F.sqrt(chance + 1))
        content = b""
        for r in sorted(seen.filter(ok).collect(), key=lambda r: (-r[mine], bytes(r.begin))):
            if len(content) + len(r.begin) < DICT_BYTES:
                content += _GAP + bytes(r.begin)
        out.append(content)
    return out[0], out[1]


@cache
def _coders(toxic: bytes, ordinary: bytes):
    import zstandard as zs

    size = max(len(toxic), len(ordinary), 64)
    shape = zs.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=MIN_MATCH, target_length=1, strategy=zs.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for content in (toxic, ordinary):
        d = zs.ZstdCompressionDict(content.rjust(size, b"\0") + _TAIL, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=shape)
        out.append(zs.ZstdCompressor(dict_data=d, compression_params=shape).compress)
    return tuple(out)


def features(text: str, toxic: bytes, ordinary: bytes) -> list[float]:
    by_toxic, by_ordinary = _coders(toxic, ordinary)
    words = words_of(text)
    saved = lost = n = ahead = 0
    for at in range(0, len(words), WINDOW):
        w = window(words[at : at + WINDOW])
        d = len(by_ordinary(w)) - len(by_toxic(w))
        saved, lost, n, ahead = saved + max(d, 0), lost + max(-d, 0), n + 1, ahead + (d > 0)
    return [*(float(np.log1p(x)) for x in (saved, lost, n)), float(ahead > 0), float(ahead > 1)]


def _fit(x: np.ndarray, y: np.ndarray) -> dict:
    m, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[np.ones(len(x)), (x - m) / sd], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (q * (1 - q) + 1e-9)[:, None]).T @ z + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - q) - 0.1 * w)
    return {"m": m.tolist(), "sd": sd.tolist(), "w": w.tolist()}


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, dict_docs: int = DICT_DOCS, curve_docs: int = CURVE_DOCS) -> dict:
    """The model, from labelled rows that are not held out: a bounded sample in the order of the ids' hashes.

    Without labels of both classes the score is the share of toxic labels (0 without labels)."""
    known = labels.filter(~is_held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    picked = [known.filter((half == 0) & (F.col("toxic") == k)).orderBy(*order).limit(dict_docs).withColumn("use", F.lit(k)) for k in (0, 1)]
    picked.append(known.filter(half == 1).orderBy(*order).limit(curve_docs).withColumn("use", F.lit(2)))
    ids = [tuple(r) for p in picked for r in p.select("doc_id", "toxic", "use").collect()]  # bounded by the parameters
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int, use int"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # of rows that share an id the least text is taken
    rows = materialize(text.join(chosen, "doc_id").groupBy("doc_id", "toxic", "use").agg(F.min("text").alias("text")))
    base = float(np.mean([t for _, t, _ in ids])) if ids else 0.0
    held = {(r.use, r.toxic) for r in rows.select("use", "toxic").distinct().collect()}
    if not {(0, 0), (1, 1), (2, 0), (2, 1)} <= held:
        return {"toxic": "", "ordinary": "", "base": base}
    toxic, ordinary = _own(rows.filter("use < 2").select("use", "text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "", toxic, ordinary) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    curve = rows.filter("use = 2").select("doc_id", "toxic", "text").mapInArrow(told, "doc_id long, toxic int, x array<double>").collect()
    curve.sort(key=lambda r: r.doc_id)
    x, y = np.array([r.x for r in curve]), np.array([float(r.toxic) for r in curve])
    return {"toxic": toxic.hex(), "ordinary": ordinary.hex(), "base": base} | _fit(x, y)


def _scores(texts: list[str | None], m: dict) -> np.ndarray:
    if "w" not in m or not texts:
        return np.full(len(texts), m["base"])
    toxic, ordinary = bytes.fromhex(m["toxic"]), bytes.fromhex(m["ordinary"])
    z = (np.array([features(t or "", toxic, ordinary) for t in texts]) - m["m"]) / np.array(m["sd"])
    return 1 / (1 + np.exp(-np.clip(z @ np.array(m["w"][1:]) + m["w"][0], -30, 30)))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), without a shuffle.

    Only the whole text decides. A null text is empty; an empty one has no window, and so the score of no difference.
    Repeated rows give equal rows, an empty table none; a null doc_id is not held out. Other columns are not read."""
    bound_batches(docs.sparkSession)
    told = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(told)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_scores(b.column(1).to_pylist(), m), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``; no shuffle.

    A null text is empty, ids are not looked at, repeated rows are kept or dropped together, a text of any length is scored
    whole, an empty table stays empty."""
    bound_batches(docs.sparkSession)
    told, at = json.dumps(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(told)
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at).to_pylist(), m) < threshold))

    return docs.mapInArrow(run, docs.schema)
