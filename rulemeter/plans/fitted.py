"""Option models over the items made of the order tables, fitted on one side of the orders and judged on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.staging import stored
from ..operators import fitted as M
from .exam import INTERVAL_SQL, ITEMS_SQL, PART_STEMS, order_items, part_items
from .programs import DIRECTIONS


def _sides(spark: SparkSession, sf_dir: str):
    """(direction, training items, judged items, seed)."""
    items = stored(order_items(spark, sf_dir))  # read four times
    return [(name, items.filter(train), items.filter(judge), seed) for name, (train, judge, seed) in DIRECTIONS.items()]


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


_FEAT = f"""WITH {ITEMS_SQL},
wd AS (SELECT tok.id, letter, text, list_filter(t, lambda x: len(x) >= 3) AS t3, list_filter(regexp_split_to_array(lower(stem), '[^a-z0-9]+'), lambda x: len(x) >= 3) AS s3, sn, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS c,
 regexp_extract(text, '^[^0-9-]*(-?[0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE AS v FROM tok JOIN item USING (id) JOIN stok USING (id)),
sh AS (SELECT id, max(len(text)) AS top, list_sort(list(v) FILTER (v IS NOT NULL)) AS vs FROM wd GROUP BY id),
fe AS (SELECT id, letter, list_concat(flatten(list_transform(t3, lambda x: CASE WHEN list_contains(s3, x) THEN ['o:' || x, 'ov:' || x] ELSE ['o:' || x] END)), list_transform(range(1, greatest(1, least(len(c) - 2, 60) + 1)), lambda i: 'c3:' || c[i:i+2]),
 list_filter([CASE WHEN len(text) = top THEN 'cue:longest' END, CASE WHEN len(vs) >= 3 AND v = vs[((len(vs) - 1) // 2 + 1)::INT] THEN 'cue:middle' END, CASE WHEN len(list_filter(sn, lambda k: contains(text, k))) > 0 THEN 'cue:numrepeat' END], lambda x: x IS NOT NULL),
 ['pos:' || letter, 'len:' || least(8, len(text) // 12)]) AS fs FROM wd JOIN sh USING (id)),
fr AS (SELECT id, letter, unnest(fs) AS feature, generate_subscripts(fs, 1) AS nth FROM fe),
side AS (SELECT id, authority, claim, key, 'open-to-rest' AS d, authority = 'O' AS train FROM item UNION ALL SELECT id, authority, claim, key, 'rest-to-open', authority <> 'O' FROM item),
cnt AS (SELECT d, feature, count(*) FILTER (letter = key) AS in_key, count(*) FILTER (letter <> key) AS in_rest FROM fr JOIN side USING (id) WHERE train GROUP BY ALL)"""
_PICK = "arg_min(letter, (-s, letter)) AS answer, max(s)::BIGINT AS score"
_NGRAM = f"""{_FEAT}, tot AS (SELECT d, sum(in_key)::DOUBLE AS kt, sum(in_rest)::DOUBLE AS dt, count(*) + 1 AS v FROM cnt GROUP BY d),
ng AS (SELECT d, id, {_PICK} FROM (SELECT side.d, fr.id, letter, sum(round_even(1e9 * (ln((coalesce(in_key, 0) + 1) / (kt + v)) - ln((coalesce(in_rest, 0) + 1) / (dt + v))), 0)::BIGINT)::BIGINT AS s
 FROM fr JOIN side ON side.id = fr.id AND NOT train JOIN tot ON tot.d = side.d LEFT JOIN cnt ON cnt.d = side.d AND cnt.feature = fr.feature GROUP BY ALL) GROUP BY ALL)"""
_RANDOM = f""", fst AS (SELECT id, feature, row_number() OVER (PARTITION BY id ORDER BY min((letter, nth))) AS draw FROM fr GROUP BY id, feature),
rnd AS (SELECT d, id, {_PICK} FROM (SELECT d, fr.id, letter, sum(round_even(1e9 * (CASE d WHEN 'open-to-rest' THEN {rng.sql("20260916", "draw")} ELSE {rng.sql("20260917", "draw")} END * 2 - 1), 0)::BIGINT)::BIGINT AS s
 FROM fr JOIN fst USING (id, feature) JOIN side ON side.id = fr.id AND NOT train GROUP BY ALL) GROUP BY ALL)"""
_OVERLAP = f""", sw AS (SELECT id, letter, list_filter(s3, lambda x: list_contains(t3, x)) AS ws FROM wd),
ow AS (SELECT d, token, round_even(1e9 * ln((count(*) FILTER (letter = key) + 1) / (count(*) FILTER (letter <> key) + 1)), 0)::BIGINT AS w FROM (SELECT id, letter, unnest(list_distinct(ws)) AS token FROM sw) JOIN side USING (id) WHERE train GROUP BY ALL),
ov AS (SELECT d, id, CASE WHEN score > 0 THEN answer END AS answer, score FROM (SELECT d, id, {_PICK} FROM (SELECT side.d, x.id, letter, coalesce(sum(w), 0)::BIGINT AS s FROM (SELECT id, letter, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS token FROM sw) x
 JOIN side ON side.id = x.id AND NOT train LEFT JOIN ow ON ow.d = side.d AND ow.token = x.token GROUP BY ALL) GROUP BY ALL))"""


def ngram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts of every option feature, for both training sides."""
    return _union([M.train_ngram(train).withColumn("direction", F.lit(d)) for d, train, _, _ in _sides(spark, sf_dir)])


def ngram_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted n-gram model's answer and score of every judged item."""
    return _union([M.apply_ngram(M.train_ngram(train), judge).withColumn("direction", F.lit(d)) for d, train, judge, _ in _sides(spark, sf_dir)])


def random_ngram_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features with random weights."""
    return _union([M.random_ngram(judge, seed).withColumn("direction", F.lit(d)) for d, _, judge, seed in _sides(spark, sf_dir)])


def overlap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted overlap model's answer, null unless its score is positive."""
    return _union([M.apply_overlap(M.train_overlap(train), judge).withColumn("direction", F.lit(d)) for d, train, judge, _ in _sides(spark, sf_dir)])


#: program, its random program, slice, step: a rung of each model and slice, both directions, and one that was never run.
RUNGS = [
    ("fitted-ngram/open-to-rest", "random-ngram/open-to-rest", "rest headline"), ("fitted-ngram/open-to-rest", "random-ngram/open-to-rest", "rest"), ("fitted-overlap/open-to-rest", "random-ngram/open-to-rest", "rest headline"), ("random-ngram/open-to-rest", None, "rest headline"),
    ("fitted-ngram/rest-to-open", "random-ngram/rest-to-open", "open"), ("fitted-overlap/rest-to-open", "random-ngram/rest-to-open", "open"), ("random-ngram/rest-to-open", None, "open"), ("fitted-formula/rest-to-open", None, "open"),
]


def held_out_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rungs of models and slices with interval, random baseline and note."""
    trials, sizes = [], {}
    for d, train, judge, seed in _sides(spark, sf_dir):
        sizes[d] = train.count()
        trials.append(M.all_trials(train, judge, seed, d))
    rows = [(i, p, d, 0 if p.startswith("random") else sizes[d], s, r) for i, (p, r, s) in enumerate(RUNGS) for d in [p.split("/")[1]]]
    rungs = spark.createDataFrame(rows, "step int, program string, train_slice string, n_train long, slice string, random_program string")
    open_ = F.col("authority") == "O"
    t = M.held_out_ladder(_union(trials), {"rest": ~open_, "rest headline": ~open_ & F.col("claim").isin("1-URGENT", "2-HIGH"), "open": open_}, rungs)
    for c in ("pass_rate", "chance", "random_baseline", "lo", "hi"):
        t = t.withColumn(c, F.round(c, 6))
    return t.drop("random_program")


_LADDER_SQL = f"""{_NGRAM}{_RANDOM}{_OVERLAP}, sz AS (SELECT id, count(*) AS size FROM opt GROUP BY id),
tr AS (SELECT 'fitted-ngram/' || d AS program, id, answer FROM ng UNION ALL SELECT 'fitted-overlap/' || d, id, answer FROM ov UNION ALL SELECT 'random-ngram/' || d, id, answer FROM rnd),
sl AS (SELECT *, unnest(CASE WHEN authority = 'O' THEN ['open'] WHEN claim IN ('1-URGENT', '2-HIGH') THEN ['rest', 'rest headline'] ELSE ['rest'] END) AS slice FROM tr JOIN item USING (id) JOIN sz USING (id)),
co AS (SELECT program, slice, count(*) AS attempted, count(answer) AS n, count(*) FILTER (answer IS NULL) AS skipped, count(*) FILTER (answer = key) AS c, avg(CASE WHEN answer IS NOT NULL THEN 1.0::DOUBLE / size END) AS chance, avg(CASE WHEN answer IS NOT NULL THEN (answer = key)::INT END) AS rate FROM sl GROUP BY ALL),
rated AS (SELECT n, c FROM co), {INTERVAL_SQL},
ru AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}', '{s}', {repr(r) if r else 'NULL'})" for i, (p, r, s) in enumerate(RUNGS))}) AS v(step, program, slice, rp)),
nt AS (SELECT d, count(*) FILTER (train) AS n_train FROM side GROUP BY d),
j AS (SELECT step, ru.program, nt.d AS train_slice, CASE WHEN ru.program LIKE 'random%' THEN 0 ELSE n_train END AS n_train, ru.slice, coalesce(a.attempted, 0) AS attempted, coalesce(a.n, 0) AS n_scored, coalesce(a.skipped, 0) AS skipped, coalesce(a.c, 0) AS n_correct, coalesce(a.rate, 0) AS pass_rate, coalesce(a.chance, 0) AS chance, coalesce(b.rate, a.chance, 0) AS random_baseline, lo, hi, coalesce(lo > a.chance, false) AS beats
 FROM ru JOIN nt ON nt.d = string_split(ru.program, '/')[2] LEFT JOIN co a ON a.program = ru.program AND a.slice = ru.slice LEFT JOIN co b ON b.program = rp AND b.slice = ru.slice LEFT JOIN bound ON bound.n = a.n AND bound.c = a.c)
SELECT step, program, train_slice, n_train, slice, attempted, n_scored, skipped, n_correct, round(pass_rate, 6) AS pass_rate, round(chance, 6) AS chance, round(random_baseline, 6) AS random_baseline, round(lo, 6) AS lo, round(hi, 6) AS hi, beats, beats AND n_scored >= 10 AS eligible,
CASE WHEN attempted = 0 THEN 'no trials' WHEN n_scored = 0 THEN 'abstained on all' WHEN beats AND n_scored >= 10 THEN 'beats chance' WHEN beats THEN 'beats chance, too few' ELSE 'does not beat chance' END AS note FROM j"""


def _numeric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The computation items as numeric ones: a stem and the right number."""
    right = F.get("options", (F.col("id") % len(PART_STEMS)).cast("int"))["text"]
    return part_items(spark, sf_dir).select("id", "stem", right.alias("key"))


def formula_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and hits of eleven formulas on even (training) and odd items, and which one training chooses."""
    trials = M.formula_trials(_numeric_items(spark, sf_dir)).withColumn("train", F.col("id") % 2 == 0)
    best = M.train_formula(trials.filter("train"))
    answered = trials.withColumn("answered", F.lit(True))
    t = answered.groupBy("formula").agg(*(F.count_if(F.col(c) & on).alias(f"{half}_{name}") for half, on in (("train", F.col("train")), ("held", ~F.col("train"))) for name, c in (("hits", "correct"), ("n", "answered"))))
    return t.join(best.select("formula", F.lit(True).alias("chosen")), "formula", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


FORMULA_CATALOG_SQL = f"""WITH i AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, p_size::DOUBLE AS p, (p_partkey % 90 + 10)::DOUBLE AS n FROM part),
x AS (SELECT *, [p * n / 100, n * (100 - p) / 100, p * n, (p + n) / 2][(kind + 1)::INT] AS key, CASE WHEN kind < 2 THEN p END AS pc, CASE WHEN p = n THEN NULL ELSE n END AS other FROM i),
v AS (SELECT id, key, unnest({M.FORMULAS!r}) AS formula, unnest(range({len(M.FORMULAS)})) AS place, unnest([CASE WHEN n <> 0 THEN p / n END, CASE WHEN p <> 0 THEN n / p END, p * n, p + n, abs(p - n), NULL, pc / 100 * other, CASE WHEN pc IS NOT NULL THEN other * (1 - pc / 100) END, CASE WHEN pc IS NOT NULL THEN other * (1 + pc / 100) END, (p + n) / 2, p * p]) AS val FROM x),
w AS (SELECT *, CASE WHEN val = floor(val) THEN val ELSE format('{{:.7e}}', val)::DOUBLE END AS a FROM v WHERE val IS NOT NULL), c AS (SELECT *, abs(key - a) <= 1e-6 * greatest(1, abs(key)) OR abs(key - a) < 0.005 AS ok, id % 2 = 0 AS train FROM w),
g AS (SELECT formula, place, count(*) FILTER (ok AND train) AS train_hits, count(*) FILTER (train) AS train_n, count(*) FILTER (ok AND NOT train) AS held_hits, count(*) FILTER (NOT train) AS held_n FROM c GROUP BY ALL)
SELECT formula, train_hits, train_n, held_hits, held_n, formula = (SELECT arg_min(formula, (-train_hits, place)) FROM g) AS chosen FROM g"""

QUERIES = {"ngram_features": ngram_features, "ngram_answers": ngram_answers, "random_ngram_answers": random_ngram_answers, "overlap_answers": overlap_answers, "held_out_ladder": held_out_ladder, "formula_catalog": formula_catalog}
ORACLES = {
    "ngram_features": f"{_FEAT} SELECT d AS direction, feature, in_key, in_rest FROM cnt",
    "ngram_answers": f"{_NGRAM} SELECT d AS direction, id, answer, score FROM ng",
    "random_ngram_answers": f"{_FEAT}{_RANDOM} SELECT d AS direction, id, answer, score FROM rnd",
    "overlap_answers": f"{_FEAT}{_OVERLAP} SELECT d AS direction, id, answer, score FROM ov",
    "held_out_ladder": _LADDER_SQL,
    "formula_catalog": FORMULA_CATALOG_SQL,
}
