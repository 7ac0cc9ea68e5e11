"""Roll-ups of the rules' trials over the items made of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import stored
from ..operators import items as I
from ..operators import rollups as R
from .exam import INTERVAL_SQL, ITEMS_SQL, ORDER, TRIALS_SQL, order_items, read

QUERIES, ORACLES = {}, {}

_SCORED = f"""{ITEMS_SQL}, {TRIALS_SQL}, n AS (SELECT id, count(*) AS k FROM opt GROUP BY id), p AS (SELECT unnest({ORDER!r}) AS program),
scored AS (SELECT item.id, authority, claim, p.program, answer, key, answer IS NULL AS skipped, 1.0::DOUBLE / k AS chance, CASE WHEN answer IS NOT NULL THEN answer = key END AS correct
           FROM item CROSS JOIN p JOIN n USING (id) LEFT JOIN trial t ON t.id = item.id AND t.program = p.program)"""


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, f"WITH {_SCORED}{sql}"
        return fn

    return add


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.judged(order_items(spark, sf_dir))


def _rounded(t: DataFrame, *names: str) -> DataFrame:
    for c in names:
        t = t.withColumn(c, F.round(c, 6))
    return t


@query("""
SELECT claim, program, count(*) AS n, count(correct) AS n_scored, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 6) AS rate, round(avg(CASE WHEN NOT skipped THEN chance END), 6) AS chance,
round(avg(CASE WHEN skipped THEN chance ELSE correct::INT END), 6) AS with_chance FROM scored GROUP BY ALL HAVING count(*) >= 10""")
def channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by claim and program, abstentions left out and taken as chance."""
    return _rounded(R.channel_summary(_scored(spark, sf_dir), ["claim", "program"]), "rate", "chance", "with_chance")


@query(""", r AS (SELECT authority, claim, program, coalesce(avg(correct::INT), 0) AS pass_rate, avg(CASE WHEN NOT skipped THEN chance END) AS c FROM scored GROUP BY ALL),
m AS (SELECT s.*, pass_rate, coalesce(pass_rate > c + 1e-9, false) AS above_chance FROM scored s LEFT JOIN r USING (authority, claim, program))
SELECT program, above_chance, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(min(pass_rate), 6) AS low, round(max(pass_rate), 6) AS high FROM m GROUP BY ALL""")
def trial_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials marked by whether their cell's program beats chance, counted."""
    scored = I.trials(stored(I.told(order_items(spark, sf_dir))))
    t = R.trial_marks(scored, I.rule_chance(scored))
    return t.groupBy("program", "above_chance").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.min("pass_rate"), 6).alias("low"), F.round(F.max("pass_rate"), 6).alias("high"))


@query("""
SELECT program, count(*) AS attempted, count(correct) AS scored, count(*) FILTER (skipped) AS skipped, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 6) AS rate FROM scored WHERE id % 2 = 1 GROUP BY program""")
def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every program over the held-out half, the odd ids."""
    return _rounded(R.held_out(_scored(spark, sf_dir), F.col("id") % 2 == 1), "rate")


_MODAL = """, kc AS (SELECT authority, key AS letter, count(*) AS c FROM item GROUP BY ALL),
modal AS (SELECT authority, arg_min(letter, (-c, letter)) AS letter, max(c) AS n, round(max(c)::DOUBLE / sum(c), 6) AS share FROM kc GROUP BY authority)"""


@query(_MODAL + " SELECT * FROM modal")
def modal_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent key of each authority."""
    return _rounded(R.modal_letters(order_items(spark, sf_dir), ["authority"]), "share")


@query(_MODAL + """ SELECT program, count(*) FILTER (correct AND key = letter) AS modal_correct, count(*) FILTER (correct AND key <> letter) AS other_correct,
round(avg(CASE WHEN key = letter THEN correct::INT END), 6) AS modal_rate, round(avg(CASE WHEN key <> letter THEN correct::INT END), 6) AS other_rate FROM scored JOIN modal USING (authority) GROUP BY program""")
def modal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correct picks taken apart into modal and other letters."""
    items = order_items(spark, sf_dir)
    return _rounded(R.modal_split(I.judged(items), R.modal_letters(items, ["authority"]), ["authority"]), "modal_rate", "other_rate")


@query(""", h AS (SELECT id, max(coalesce(correct AND program IN ('middle-value-option', 'longest-option', 'position-c'), false)::INT) AS hit FROM scored GROUP BY id)
SELECT claim, count(*) AS n FROM h JOIN item USING (id) WHERE hit = 0 GROUP BY claim""")
def residual_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that no simple cue answers, by claim."""
    items = order_items(spark, sf_dir)
    return R.residual(I.judged(items), ["middle-value-option", "longest-option", "position-c"]).join(items.select("id", "claim"), "id").groupBy("claim").agg(F.count("*").alias("n"))


@query(""", x AS (SELECT a.id, a.correct AS x, b.correct AS y FROM scored a JOIN scored b USING (id) WHERE a.program = 'longest-option' AND b.program = 'stem-option-overlap' AND a.correct IS NOT NULL AND b.correct IS NOT NULL)
SELECT count(*) AS n, round(avg(x::INT), 6) AS rate_a, round(avg(y::INT), 6) AS rate_b, round(avg(x::INT - y::INT), 6) AS difference, count(*) FILTER (x AND y) AS n11, count(*) FILTER (x AND NOT y) AS n10, count(*) FILTER (NOT x AND y) AS n01, count(*) FILTER (NOT x AND NOT y) AS n00 FROM x""")
def paired_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two programs over the items that both answered."""
    return _rounded(R.paired(I.trials(stored(I.told(order_items(spark, sf_dir), ["longest-option", "stem-option-overlap"]))), "longest-option", "stem-option-overlap"), "rate_a", "rate_b", "difference")


@query(_MODAL + """, r AS (SELECT 'chance' AS rung, 0 AS step, 1.0::DOUBLE / k AS ok FROM n UNION ALL SELECT 'modal', 1, (key = letter)::INT FROM item JOIN modal USING (authority)
UNION ALL SELECT 'options', 2, correct::INT FROM scored WHERE program = 'longest-option' UNION ALL SELECT 'stem', 3, correct::INT FROM scored WHERE program = 'stem-option-overlap')
SELECT rung, step, count(ok) AS n, round(avg(ok), 6) AS rate FROM r GROUP BY ALL""")
def information_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from chance to the stem, each with more to go by."""
    items = order_items(spark, sf_dir)
    scored = I.judged(items)
    modal = items.join(R.modal_letters(items, ["authority"]).select("authority", "letter"), "authority")
    by = lambda p: scored.filter(F.col("program") == p).select(F.col("correct").cast("int").alias("ok"))
    t = R.ladder([("chance", items.select((1 / F.size("options")).alias("ok"))), ("modal", modal.select((F.col("key") == F.col("letter")).cast("int").alias("ok"))), ("options", by("longest-option")), ("stem", by("stem-option-overlap"))])
    return _rounded(t, "rate")


@query(""", r AS (SELECT claim, program, avg(correct::INT) AS rate, avg(CASE WHEN NOT skipped THEN chance END) AS c FROM scored GROUP BY ALL)
SELECT count(*) FILTER (rate - c > 1e-9) AS above, count(*) FILTER (rate - c < -1e-9) AS below, count(*) FILTER (abs(rate - c) > 1e-9) AS n FROM r""")
def sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells above and below chance, ties dropped."""
    return R.sign_counts(R.channel_summary(_scored(spark, sf_dir), ["claim", "program"], 1), "rate", "chance")


@query("""
SELECT id, count(DISTINCT program) AS n_programs, count(DISTINCT answer) AS n_letters, array_to_string(list_sort(list(DISTINCT program)), ',') AS programs FROM scored WHERE NOT skipped GROUP BY id""")
def programs_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that answered each item, and the letters they chose."""
    return R.programs_of(_scored(spark, sf_dir))


@query(""", l AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey) SELECT * FROM l""")
def last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, in the order of the keys."""
    return R.last_by_id(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query(""", v AS (SELECT DISTINCT o_custkey, o_orderkey AS v FROM orders), d AS (SELECT *, lead(v) OVER w - v AS d FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY v)),
g AS (SELECT *, sum(coalesce((d <> pd)::INT, 1)) OVER (PARTITION BY o_custkey ORDER BY v) AS run FROM (SELECT *, lag(d) OVER (PARTITION BY o_custkey ORDER BY v) AS pd FROM d))
SELECT o_custkey, min(v) AS start, d AS step, count(*) + 1 AS n FROM g WHERE d IN (1, 2, 5, 10, 15) GROUP BY o_custkey, run, d HAVING count(*) + 1 >= 2""")
def arithmetic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equally spaced order keys of a customer, two or more long."""
    return R.arithmetic_runs(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", least=2)


# fixed values: channels of the rules
CHANNELS = {
    "longest-option": "item-cues", "stem-option-overlap": "partial-input", "option-repeating-stem-numbers": "partial-input", "avoid-absolute-terms": "partial-input", "middle-value-option": "item-cues", "position-c": "item-cues",
}
# end of fixed values


@query(f""", ch AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{'item-cues' if c == 'item-cues' else 'stem-ngram' if p in I.STEM_RULES else 'choices-only'}')" for p, c in CHANNELS.items())}) AS v(program, view)),
lo AS (SELECT id, string_agg(letter, '' ORDER BY letter) AS longest FROM (SELECT *, max(len(text)) OVER (PARTITION BY id) AS m FROM opt) WHERE len(text) = m GROUP BY id),
re AS (SELECT opt.id, string_agg(letter, '' ORDER BY letter) FILTER (len(list_filter(sn, lambda k: contains(text, k))) > 0) AS repeated, sum(len(list_filter(t, lambda x: list_contains(st, x)))) AS overlap FROM opt JOIN tok USING (id, letter, text) JOIN stok ON stok.id = opt.id GROUP BY opt.id)
SELECT id, program, view, CASE WHEN view = 'stem-ngram' THEN stem END AS stem, CASE WHEN view = 'stem-ngram' THEN len(sn) ELSE -1 END AS n_numbers, k AS n_options, longest, CASE WHEN view = 'choices-only' THEN '' ELSE coalesce(repeated, '') END AS repeated, CASE WHEN view = 'choices-only' THEN 0 ELSE overlap END::BIGINT AS overlap
FROM item JOIN stok USING (id) JOIN n USING (id) JOIN lo USING (id) JOIN re USING (id) CROSS JOIN ch""")
def item_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule is shown of each item: never the key, the stem only where its channel has it."""
    rules = spark.createDataFrame(list(CHANNELS.items()), "program string, channel string")
    t = I.views(order_items(spark, sf_dir), rules)
    s = F.col("surface")
    return t.select("id", "program", "view", "stem", F.coalesce(F.size("numbers"), F.lit(-1)).alias("n_numbers"), F.size("options").cast("long").alias("n_options"), F.array_join(s["longest"], "").alias("longest"), F.array_join(s["repeated"], "").alias("repeated"), F.aggregate(s["overlap"], F.lit(0).cast("long"), lambda a, x: a + x).alias("overlap"))


@query(f""", a AS (SELECT * FROM scored WHERE program = 'longest-option' AND correct IS NOT NULL), kc AS (SELECT authority, claim, key, count(*) AS c FROM a GROUP BY ALL), mo AS (SELECT authority, claim, arg_min(key, (-c, key)) AS modal, max(c) AS modal_n, max(c)::DOUBLE / sum(c) AS share FROM kc GROUP BY ALL),
g AS (SELECT authority, claim, any_value(modal) AS modal, any_value(modal_n) AS modal_n, any_value(share) AS share, count(*) AS n1, count(*) FILTER (correct) AS c1, avg(chance) AS chance, count(*) FILTER (key <> modal) AS n2, count(*) FILTER (correct AND key <> modal) AS c2, avg(chance) FILTER (key <> modal) AS chance2 FROM a JOIN mo USING (authority, claim) GROUP BY ALL HAVING count(*) >= 10),
rated AS (SELECT n1 AS n, c1 AS c FROM g UNION SELECT n2, c2 FROM g), {INTERVAL_SQL}
SELECT authority, claim, modal, modal_n, round(share, 6) AS modal_share, n1 AS n, c1 AS n_correct, round(c1::DOUBLE / n1, 6) AS rate, round(chance, 6) AS chance, n2 AS other_n, c2 AS other_correct, round(c2::DOUBLE / n2, 6) AS other_rate, round(chance2, 6) AS other_chance,
round(x.lo, 6) AS lo, round(x.hi, 6) AS hi, round(y.lo, 6) AS other_lo, round(y.hi, 6) AS other_hi, x.lo > chance AS above_chance, x.lo > share AS above_modal, x.lo > chance AND x.lo > share AS double_bar FROM g JOIN bound x ON x.n = n1 AND x.c = c1 LEFT JOIN bound y ON y.n = n2 AND y.c = c2""")
def enriched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one rule with their modal key, the double bar, and the items whose key is another letter."""
    t = R.enriched_cells(I.judged(order_items(spark, sf_dir), ["longest-option"]), ["authority", "claim"])
    return _rounded(t, "modal_share", "rate", "chance", "other_rate", "other_chance", "lo", "hi", "other_lo", "other_hi")


def run_free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of numbers that axes leave; the greedy walk has no SQL."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = d.select("doc_id", F.length("text").alias("n_chars"), T.drop_arithmetic_runs(F.col("text")).alias("kept"))
    return t.select("doc_id", (F.col("n_chars") - F.length("kept")).cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["run_free_texts"] = run_free_texts
