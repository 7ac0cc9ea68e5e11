"""Line dedup: lines that several documents hold stay in the first of them only.

Normalised lines are exploded to narrow rows of two 64-bit hashes, the documents of each hash are counted, and the positions
to drop are brought back to their documents, whose texts move once. A line that very many documents share is counted by
partial sums, and its rows are joined with one row for the hash, so that the join may split them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, unused

#: Code points of the shortest line that counts, and the documents that make a line a repeated one.
LEAST_CHARS, COPIES = 10, 2
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def _hashes(text: Column) -> list[Column]:
    """128 bits: of 10^12 different lines no two are expected to share them."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2): the hashes of each row's text, and of its lines that are long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t1, t2 = _hashes(text)
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    h1, h2 = _hashes(F.col("key"))
    return lines.select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, copies: int = COPIES) -> DataFrame:
    """(h1, h2, n_docs, first): hashes of lines that ``copies`` documents or more hold, and the smallest doc_id of those."""
    lines = _lines(docs, least_chars).groupBy("h1", "h2")
    n_docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return lines.agg(n_docs.alias("n_docs"), F.min("doc_id").alias("first")).filter(F.col("n_docs") >= copies)


def _without(text: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for t, d in zip(text.to_pylist(), dropped.to_pylist(), strict=True):
        if d:
            gone = set(d)
            t = "\n".join([line for i, line in enumerate(t.split("\n")) if i not in gone])
        out.append(t)
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, copies: int = COPIES) -> DataFrame:
    """``docs`` with ``text`` less the repeated lines, and n_lines (before), n_dropped (longs); one row for each row.

    A line is what stands between two \\n; null and empty texts are one empty line. Lines whose key (line_key) has
    ``least_chars`` code points and stands in ``copies`` documents are dropped, all of them, except in the document with the
    smallest doc_id; there repeats stay too. Rows that share a doc_id are one document, and so are rows without an id,
    which come after all others. Very long texts have as many lines as they have; an empty table gives none. Other columns
    stay as they are; those called n_lines or n_dropped give way."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    # written once: both sides of the join are then plain exchanges, of which a hot one may be split
    repeated = materialize(repeated_lines(docs, least_chars, copies))
    held = _lines(docs, least_chars).join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    lost = held.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("pos"))
    id_, t1, t2, pos = (unused(docs, c) for c in ("_id", "_t1", "_t2", "_pos"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("t1").alias("lost_t1"), F.col("t2").alias("lost_t2"), F.col("pos").alias(pos))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), t1: _hashes(text)[0], t2: _hashes(text)[1]})
    told = keyed.join(lost, [keyed[id_].eqNullSafe(lost["lost_id"]), keyed[t1] == lost["lost_t1"], keyed[t2] == lost["lost_t2"]], "left")
    n_lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    told = told.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size(pos), F.lit(0)).cast("long"), "text": F.arrow_udf(_without, "string")(text, F.col(pos))})
    return told.select(*docs.columns, "n_lines", "n_dropped")


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``; see drop_repeated_lines."""
    kept = drop_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {COPIES}),
d AS (SELECT k.*, coalesce(doc_id <> first, false) AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM d GROUP BY doc_id"""
