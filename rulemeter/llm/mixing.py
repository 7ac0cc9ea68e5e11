"""Mixing sources to target weights, in native operators.

Each source's words, in a fixed order of its documents, are cut into blocks of BLOCK words, and its target is so many
slots. The slots of all sources stand in a line; a pseudorandom permutation of that line, cut into output shards of SHARD
words, draws each shard's source counts: multinomial with the targets as weights, given that the sources' totals are met
exactly. The counts, summed up over the shards, tell which of a source's slots a shard holds. Slots go through whole passes
over the source's blocks, then a part of one more; within a pass slot i takes block p(i), where p is a pseudorandom
permutation of the source's full blocks (the short last block comes last). Permutations are computed for each index by
itself (swap-or-not rounds: a bijection on any range, without a table). Slots and the documents' pieces meet in a join on
(source, block). Nothing is sorted or numbered within a whole source: offsets are prefix sums over buckets, then within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, materialize, unused

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
BUCKETS, ROUNDS, PRIME = 4096, 20, 65521
#: The rounds' shifts: powers modulo PRIME of an odd sequence, as digits.
KEYS = [(pow(h, 3, PRIME) * PRIME + pow(h, 2, PRIME)) * PRIME + h for h in ((r * 7919 + 104729) % PRIME for r in range(ROUNDS))]
#: Words in an output shard; slots that one row counts out.
SHARD, RUN = 1 << 18, 4096
#: Sources up to which the table of targets is sent to every task; beyond, it is joined like any table.
FEW_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) from (source, size): one row for each source.

    Sources in code-point order, null last, take the weights in turn. Water is poured by weight: in the order of the size
    that a unit of weight fills, a source is full if it lies below the level that the rest would reach."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("sid", rank.cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    gone, spent = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("weight", "cap"))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(budget) - spent) / (F.sum("weight").over(whole) - gone))
    per = per.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    per = per.withColumn("rest", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    return per.select("source", "sid", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def permuted(i: Column, n: Column, sid: Column, turn: Column) -> Column:
    """Place of i under a pseudorandom permutation of 0..n-1: each round swaps x with k - x or not, by a bit of a hash of the
    larger. Nothing is used twice but the pair, since a lambda works out what it names as often as it names it."""

    def once(x: Column, key: Column) -> Column:
        y = F.pmod(key + sid * F.lit(40503) + turn * F.lit(69069) - x, n)
        told = F.md5(F.concat_ws(":", F.greatest(x, y).cast("string"), key.cast("string"), sid.cast("string"), turn.cast("string")).cast("binary"))
        return F.when(told < "8", y).otherwise(x)

    return F.aggregate(F.array(*(F.lit(k).cast("long") for k in KEYS)), i, once)


def _passes(goals: DataFrame, block: int) -> DataFrame:
    """(sid, size, want, per, slots, before, all): slots of a pass, of the source, of the sources before it, of all."""
    size, want = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    t = goals.filter(size > 0).select("sid", size.alias("size"), want.alias("want"), F.ceil(size / F.lit(block)).cast("long").alias("per"))
    turns, rest = F.floor(F.col("want") / F.col("size")).cast("long"), F.col("want") % F.col("size")
    t = t.withColumn("slots", turns * F.col("per") + F.ceil(rest / F.lit(block)).cast("long")).filter("slots > 0")
    before = F.coalesce(F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("before", before).withColumn("all", F.sum("slots").over(W.partitionBy()))


def _counted(rows: DataFrame, n: Column, name: str, *keep: str) -> DataFrame:
    """Rows with ``name`` from 0 to n - 1, in runs of RUN, so that many tasks count out a long one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / RUN).cast("long")))).repartition(parts, *keep, "run")
    return runs.withColumn(name, F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN - 1, n - 1)))).drop("run")


def shard_counts(goals: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, sid, n): how many blocks of each source an output shard draws. The counts of a source add up to its slots."""
    line = _counted(_passes(goals, block), F.col("slots"), "j", "sid")
    zero = F.lit(0).cast("long")
    place = permuted(F.col("before") + F.col("j"), F.col("all"), zero, zero)
    return line.groupBy(F.floor(place / F.lit(max(1, shard // block))).cast("long").alias("shard"), "sid").agg(F.count("*").alias("n"))


def slots(goals: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(sid, turn, i, block, take, shard): every block that the mix takes, how many of its first words, and where it goes."""
    drawn = materialize(shard_counts(goals, block, shard).withColumn("part", F.floor(F.col("shard") / RUN)))
    before = lambda n, *by: F.coalesce(F.sum(n).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = drawn.groupBy("sid", "part").agg(F.sum("n").alias("m")).select("sid", "part", before("m", "sid", "part").alias("base"))
    first = drawn.withColumn("inner", before("n", "sid", "part", "shard")).join(sums, ["sid", "part"]).select("sid", "shard", "n", (F.col("base") + F.col("inner")).alias("first"))
    t = _counted(first, F.col("n"), "k", "sid", "shard").join(_passes(goals, block).select("sid", "size", "want", "per"), "sid")
    j = F.col("first") + F.col("k")
    t = t.withColumn("turn", F.floor(j / F.col("per")).cast("long")).withColumn("i", j % F.col("per"))
    words = F.least(F.col("size"), F.col("want") - F.col("turn") * F.col("size"))
    full = F.floor(F.col("size") / F.lit(block)).cast("long")
    at = F.when(F.col("i") < full, permuted(F.col("i"), full, F.col("sid"), F.col("turn"))).otherwise(full)
    return t.select("sid", "turn", "i", at.alias("block"), F.least(F.lit(block), words - F.col("i") * block).cast("long").alias("take"), "shard")


def plan(docs: DataFrame, block: int = BLOCK, row: str | None = None, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, source, size, row, no text), the targets, and the pieces of documents that the mix takes:
    (row, sid, shard, turn, i, at, start, end), start and end in words of the document, at in words of the block.

    ``row`` names a column that numbers the rows of a written table; without it they are numbered here, once."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), number.alias("row")))
    goals = materialize(targets(sized))
    few = goals.count() <= FEW_SOURCES
    keyed = sized.withColumnRenamed("source", "s").join((F.broadcast(goals) if few else goals).select("source", "sid"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # rows without an id are dealt by their sizes
    place = F.pmod(F.pmod(F.coalesce("doc_id", "size"), F.lit(1000003)) * 7919, F.lit(BUCKETS))
    placed = keyed.filter("size > 0").withColumn("bucket", place)
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    base = F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(sums.select("sid", "bucket", base.alias("base")))
    within = W.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases.hint("merge"), ["sid", "bucket"])
    o = F.col("base") + F.col("inner")
    spans = laid.select("row", "sid", "size", o.alias("o"), F.explode(F.sequence(F.floor(o / F.lit(block)).cast("long"), F.floor((o + F.col("size") - 1) / F.lit(block)).cast("long"))).alias("block"))
    low, high = F.greatest(F.col("o") - F.col("block") * block, F.lit(0)), F.least(F.col("o") + F.col("size") - F.col("block") * block, F.lit(block))
    spans = spans.select("row", "sid", "block", low.alias("low"), high.alias("high"), (F.col("block") * block - F.col("o")).alias("shift"))
    # slots compress so well in a shuffle that their size would be misjudged and all of them sent to every task
    met = spans.join(slots(goals, block, shard).hint("merge"), ["sid", "block"])
    end = F.least("high", "take")
    pieces = met.filter(end > F.col("low")).select("row", "sid", "shard", "turn", "i", F.col("low").alias("at"), (F.col("low") + F.col("shift")).alias("start"), (end + F.col("shift")).alias("end"))
    return keyed, goals, pieces


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard) of every row of ``docs`` (doc_id, text, source).

    taken counts the document's words in the mix, repeats too; shard is the first output shard with words of it, -1
    if none are taken. A null or empty text has no words and none are taken. A
    null source is a source, the last. Null and repeated doc_ids are documents of their own, in an order fixed by id and
    size. An empty table gives no rows. Other columns are not read."""
    keyed, goals, pieces = plan(docs, block)
    got = pieces.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.min("shard").alias("shard"))
    few = goals.count() <= FEW_SOURCES
    told = keyed.join(got.hint("merge"), "row", "left").join((F.broadcast(goals) if few else goals).select("sid", "source_size", "target"), "sid")
    return told.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shard", F.lit(-1)).cast("long").alias("shard"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written to the shared folder with numbered rows, and the number's column: an unwritten plan may number its
    rows anew each time it runs."""
    row, at = unused(docs, "row"), fresh_path(docs.sparkSession, "mixed_rows")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(at)
    return docs.sparkSession.read.parquet(at), row


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, sid, turn, i, text): the mix itself, one row for each block of words of an output shard.

    A block's words are joined by spaces, in the order of the source. Rows as in mix()."""
    numbered, row = _numbered(docs)
    _, _, pieces = plan(numbered, block, row, shard)
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    cut = pieces.join(numbered.select(F.col(row).alias("row"), words.alias("w")), "row")
    part = F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), " ")
    whole = F.array_sort(F.collect_list(F.struct("at", part.alias("text"))))  # of at most a block's words
    return cut.groupBy("shard", "sid", "turn", "i").agg(F.array_join(F.transform(whole, lambda x: x["text"]), " ").alias("text"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with the text that the mix takes of each; documents of which it takes nothing go.

    A document taken whole keeps its text as it is, once for each time; a part is its words joined by spaces. Several
    takes are joined by a line feed, and n_chars, where there is one, counts the new text's code points. Null and empty
    texts have no words and go; null ids and sources, repeated rows and empty tables as in mix(). Other columns, whatever
    their names, stay as they are. The rows are written once, so that numbers and texts belong together on any plan."""
    numbered, row = _numbered(docs)
    held, split = unused(numbered, "takes"), unused(numbered, "words")
    keyed, _, pieces = plan(numbered, block, row)
    # pieces of one pass over a document stand next to each other
    runs = pieces.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("parts"), F.sum(F.col("end") - F.col("start")).alias("words"))
    takes = runs.join(keyed.select("row", "size").hint("merge"), "row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("words") == F.col("size")).alias("whole"), "parts"))).alias(held))
    takes = materialize(takes.withColumnRenamed("row", row))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(F.exists(held, lambda t: ~t["whole"]), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    cut = lambda t: F.array_join(F.flatten(F.transform(t["parts"], lambda p: F.slice(F.col(split), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))), " ")
    told = numbered.join(takes.hint("merge"), row).withColumn(split, words)
    whole = F.array_join(F.transform(held, lambda t: text), "\n")
    told = told.withColumn("text", F.when(F.col(split).isNull(), whole).otherwise(F.array_join(F.transform(held, lambda t: F.when(t["whole"], text).otherwise(cut(t))), "\n")))
    if "n_chars" in docs.columns:
        told = told.withColumn("n_chars", F.length("text").cast("long"))
    return told.select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((sid - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM per),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= level * weight AS fullup FROM l),
goals AS (SELECT source, sid, source_size, CASE WHEN fullup THEN cap::DOUBLE ELSE max(CASE WHEN NOT fullup THEN level END) OVER () * weight END AS target FROM f),
p AS (SELECT sid, source_size AS size, floor(target + 0.5)::BIGINT AS want, (source_size + 255) // 256 AS per, source_size // 256 AS nfull FROM goals WHERE source_size > 0),
q AS (SELECT *, want // size * per + (want % size + 255) // 256 AS slots FROM p),
line AS (SELECT sid, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(slots) OVER ()::BIGINT AS n, slots FROM q WHERE slots > 0),
draw AS (
  SELECT sid, n, before + j AS x, 0::BIGINT AS r FROM (SELECT *, unnest(range(0, slots)) AS j FROM line)
  UNION ALL
  SELECT sid, n, CASE WHEN md5(concat_ws(':', greatest(x, y), k, 0, 0)) < '8' THEN y ELSE x END, r + 1
  FROM (SELECT *, ((k - x) % n + n) % n AS y FROM (SELECT *, {KEYS}[r + 1]::BIGINT AS k FROM draw WHERE r < 20))
),
counts AS (SELECT x // 1024 AS shard, sid, count(*) AS c FROM draw WHERE r = 20 GROUP BY ALL),
firsts AS (SELECT shard, sid, c, coalesce(sum(c) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM counts),
js AS (SELECT shard, sid, unnest(range(f, f + c)) AS j FROM firsts),
s AS (SELECT shard, sid, j // per AS turn, j % per AS i, least(size, want - j // per * size) AS words, nfull FROM js JOIN q USING (sid)),
walk AS (
  SELECT shard, sid, turn, words, nfull, i, i AS x, 0::BIGINT AS r FROM s WHERE i < nfull
  UNION ALL
  SELECT shard, sid, turn, words, nfull, i, CASE WHEN md5(concat_ws(':', greatest(x, y), k, sid, turn)) < '8' THEN y ELSE x END, r + 1
  FROM (SELECT *, ((k + sid * 40503 + turn * 69069 - x) % nfull + nfull) % nfull AS y FROM (SELECT *, {KEYS}[r + 1]::BIGINT AS k FROM walk WHERE r < 20))
),
slots AS (SELECT shard, sid, turn, i, x AS block, least(256, words - i * 256) AS take FROM walk WHERE r = 20
          UNION ALL SELECT shard, sid, turn, i, nfull, least(256, words - i * 256) FROM s WHERE i >= nfull),
k AS (SELECT d.doc_id, d.size, g.sid, g.source_size, g.target, ((coalesce(d.doc_id, d.size) % 1000003 + 1000003) % 1000003 * 7919) % 4096 AS bucket
      FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, row_number() OVER () AS rid FROM k),
b AS (SELECT rid, sid, size, o, unnest(range(o // 256, (o + size - 1) // 256 + 1)) AS block FROM o WHERE size > 0),
e AS (SELECT rid, shard, greatest(0, least(o + size - b.block * 256, 256, take) - greatest(o - b.block * 256, 0)) AS w FROM b JOIN slots USING (sid, block)),
t AS (SELECT rid, sum(w) AS taken, min(shard) AS shard FROM e WHERE w > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shard, -1)::BIGINT AS shard FROM o LEFT JOIN t USING (rid)
"""
