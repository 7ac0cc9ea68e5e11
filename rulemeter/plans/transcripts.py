"""Transcribed payloads, blinded packets, masked stems and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking as K
from ..functions import payloads as P
from ..operators import agreement as A
from ..operators import items as I
from ..operators import relational as R
from ..operators import systems as Y
from ..sources import tables as S
from .exam import ITEMS_SQL, TRIALS_SQL, order_items, read, spread

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: What a transcriber may send: p, p + 1, -p, p / 2 as options and the line 3x + 4 = 3p + 4, or a system with pairs.
TEXTS = [
    '```json\n{"options": {"A": "(<p>, <n>)", "B": "(<n>, <p>)", "C": "(<q>, <n>)"}, "equations": ["2x + 3y = <s>", {"latex": "x - y = <d>"}]}\n```',
    'Sure: {"options": ["<p>", "<q>", "-<p>", "<p>/2"], "equations": [{"ascii": "", "latex": "3 \\cdot x + 4 = <t>"}]} That is all }',
    '{"options": {"F": "<q>", "G": "<p>", "A": "again", "x": "no"}, "equations": {"ascii": "3x + 4 = <t>"}}',
    '{"options": [{"label": "2", "text": "<q>"}, {"key": "(a)", "value": "<p>"}, {"content": "-<p>"}], "equations": "3x + 4 = <t>"}',
    'No: {"options": , "equations": ["3x + 4 = <t>"]}',
]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): what a transcriber made of each part's problem, in five forms, one of them broken."""
    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("p"), (F.col("p_partkey") % 90 + 10).alias("n"))
    text = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % len(TEXTS) + 1).cast("int"))
    p, n = F.col("p"), F.col("n")
    for mark, value in {"p": p, "n": n, "q": p + 1, "s": 2 * p + 3 * n, "d": p - n, "t": 3 * p + 4}.items():
        text = F.replace(text, F.lit(f"<{mark}>"), value.cast("string"))
    return part.select("id", text.alias("text"))


@query("""WITH i AS (SELECT p_partkey AS id, p_size::BIGINT AS p, p_partkey % 90 + 10 AS n, p_partkey % 5 AS k FROM part)
SELECT id, k <> 4 AS parsed, CASE k WHEN 0 THEN 'A=(' || p || ', ' || n || ')|B=(' || n || ', ' || p || ')|C=(' || p + 1 || ', ' || n || ')' WHEN 1 THEN 'A=' || p || '|B=' || p + 1 || '|C=-' || p || '|D=' || p || '/2' WHEN 2 THEN 'A=' || p + 1 || '|B=' || p
 WHEN 3 THEN 'A=' || p || '|B=' || p + 1 || '|C=-' || p END AS options, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n_equations, CASE k WHEN 0 THEN CASE WHEN p <> n THEN 'A' END WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS answer FROM i""")
def transcribed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions parsed: options under their letters, equations made plain, and the only option that satisfies them."""
    t = transcripts(spark, sf_dir).select("id", P.json_object(F.col("text")).alias("payload"))
    t = t.select("id", "payload", P.options(F.col("payload")).alias("map"), F.array_join(P.equation_texts(F.col("payload")), " and ").alias("stem"))
    pairs = F.array_sort(F.map_entries("map"))
    items = t.select("id", "payload", "stem", F.transform(pairs, lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text"))).alias("options"))
    told = Y.substitution(items).select("id", "answer", "n_equations")
    listed = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit("="), o["text"])), "|")
    return items.select("id", F.col("payload").isNotNull().alias("parsed"), listed.alias("options")).join(told, "id")


_BLIND = f"WITH {ITEMS_SQL}, {TRIALS_SQL}, a AS (SELECT id, answer AS x FROM trial WHERE program = 'longest-option' AND answer IS NOT NULL), b AS (SELECT id, answer AS y FROM trial WHERE program = 'stem-option-overlap' AND answer IS NOT NULL)"


def _packets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packets with claim, predictions of one rule in shuffled letters, trials of another rule)."""
    items = order_items(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    packets = S.blinded(items).join(items.select("id", "claim"), "id")
    trials = I.judged(items, ["longest-option", "stem-option-overlap"])
    theirs = trials.filter("program = 'stem-option-overlap' and answer is not null").join(packets, "id")
    predictions = theirs.select("opaqueId", F.concat(F.lit(" "), F.lower(F.try_element_at("letterMap", "answer")), F.lit(") ")).alias("predicted"))
    return packets, predictions, trials.filter("program = 'longest-option' and answer is not null")


@query(f"""{_BLIND} SELECT claim, count(*) AS n_packets, count(y) AS n_scored, count(*) - count(y) AS n_missing, count(*) FILTER (y = key) AS n_correct, round(avg(CASE WHEN y IS NOT NULL THEN (y = key)::INT END), 6) AS rate FROM item LEFT JOIN b USING (id) GROUP BY claim""")
def blinded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on blinded packets by claim, those that never came counted."""
    packets, predictions, _ = _packets(spark, sf_dir)
    t = A.score_summary(A.blinded_scores(packets, predictions), ["claim"])
    return t.withColumn("rate", F.round("rate", 6))


@query(f"""{_BLIND}, t AS (SELECT x, y, x = key AS o, y = key AS h FROM a JOIN b USING (id) JOIN item USING (id)) SELECT count(*) AS n_overlap, round(avg((o = h)::INT), 6) AS correctness_agreement, count(y) AS n_letters, count(*) FILTER (y IS NULL) AS n_unmapped,
round(avg((x = y)::INT), 6) AS letter_agreement, round(avg((o AND h)::INT), 6) AS both_correct, round(avg(o::INT), 6) AS our_rate, round(avg(h::INT), 6) AS their_rate FROM t""")
def blinded_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers over the same items, one of them in shuffled letters that are brought back by the inverted map."""
    packets, predictions, local = _packets(spark, sf_dir)
    t = A.agreement(local, A.blinded_scores(packets, predictions).select("id", "predicted", "correct"), packets)
    for c in ("correctness_agreement", "letter_agreement", "both_correct", "our_rate", "their_rate"):
        t = t.withColumn(c, F.round(c, 6))
    return t


@query()
def masked_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked in both versions; SQL engines differ in the patterns these take."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    flags, share = F.array_join("flags", ",").alias("flags"), F.round("share", 6).alias("share")
    return K.both_versions(docs, 1, "text").select("doc_id", "version", "status", "n_placeholders", "second_sweep", flags, share, F.sha2("masked", 256).alias("masked_sha256"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '/([0-9]+)/?(?:[?#].*)?$', 1) AS a, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS b FROM pages), h AS (SELECT p_partkey::VARCHAR AS k, p_name FROM part WHERE p_size <= 25)
SELECT page_id, CASE WHEN x.k IS NOT NULL THEN 0 WHEN y.k IS NOT NULL THEN 1 WHEN z.k IS NOT NULL THEN 2 ELSE -1 END AS rank, coalesce(x.p_name, y.p_name, z.p_name) AS p_name
FROM p LEFT JOIN h x ON x.k = a LEFT JOIN h y ON y.k = b LEFT JOIN h z ON z.k = page_id::VARCHAR""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that each page is about: by the number its address ends with, else its page parameter, else its own number."""
    index = read(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").cast("string").alias("k"), "p_name")
    keys = [F.regexp_extract("url", r"/([0-9]+)/?(?:[?#].*)?$", 1), F.regexp_extract("url", r"[?&]page=([0-9]+)", 1), F.col("page_id").cast("string")]
    return R.prioritised(read(spark, sf_dir, "pages").select("page_id", "url"), "page_id", keys, index, "k").select("page_id", F.coalesce("rank", F.lit(-1)).alias("rank"), "p_name")


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN -20 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN s_acctbal > 0 THEN 3 ELSE 0 END AS score FROM supplier),
b AS (SELECT s_nationkey, arg_min(s_suppkey, (-score, s_suppkey)) AS s_suppkey FROM s GROUP BY s_nationkey) SELECT c_custkey, coalesce(s_suppkey, -1) AS s_suppkey FROM customer LEFT JOIN b ON s_nationkey = c_nationkey""")
def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the best-ranked supplier of the nation, the smallest key of equal ones."""
    k = F.col("s_suppkey")
    score = F.when(k % 5 == 0, -20).otherwise(0) + F.when(k % 3 == 0, 8).otherwise(0) + F.when(F.col("s_acctbal") > 0, 3).otherwise(0)
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return R.best_match(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), suppliers, ["nation"], score, "s_suppkey").select("c_custkey", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"))
