"""Strategy channels over problems made of the parts: elimination, hubs, scored cells, tie nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import text as T
from ..functions.staging import once, stored
from ..operators import channels as C
from ..operators import isomorphs as N
from ..operators import items as I
from ..operators import rollups as R
from ..operators import strategies as S
from ..operators import systems as Y
from .exam import INTERVAL_SQL, edges_sql, read, spread

#: Stems of the six kinds of problems: parts between which p, n and p + n stand.
STEMS = [
    ("How many of ", "n", " rings are left when ", "p", " are sold?", "", ""), ("What is the probability of one of ", "p", " rings out of ", "s", "?", "", ""), ("What percent of ", "n", " is ", "p", "?", "", ""),
    ("What is the length of a side, if the area is ", "p", " and the height ", "n", "?", "", ""), ("In a triangle with an angle of ", "p", " degrees and one of ", "n", ", what is the third angle?", "", ""), ("What is the mean of ", "p", ", ", "n", " and ", "s", "?"),
]
LETTERS = "ABCDE"
TIE_SEED = 20260918


def part_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem for each part: six kinds of stems, five options in ten-thousandths, the right one at a place of its own."""
    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), "p_partkey")
    part = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("authority"), F.col("p_size").cast("long").alias("p"), (F.col("p_partkey") % 90 + 10).alias("n"))
    part = part.withColumn("s", F.col("p") + F.col("n")).withColumn("kind", (F.col("id") % 6).cast("int"))
    told = [F.concat(*(F.col(x).cast("string") if x in ("p", "n", "s") else F.lit(x) for x in row if x)) for row in STEMS]
    right = F.element_at(F.array(F.expr("(n - p) * 10000"), F.expr("p * 10000 div s"), F.expr("p * 1000000 div n"), F.expr("p * 10000 div n"), F.expr("(180 - s) * 10000"), F.expr("s * 20000 div 3")), F.col("kind") + 1)
    part = part.withColumn("stem", F.element_at(F.array(*told), F.col("kind") + 1)).withColumn("r", right)
    values = F.array(F.col("r"), F.col("r") * 10, -F.col("r"), F.col("r") + 5000, F.col("r") + 2000000)
    text = lambda v: F.when(v % 10000 == 0, (v / 10000).cast("long").cast("string")).otherwise((v.cast("decimal(18,4)") / 10000).cast("decimal(18,4)").cast("string"))
    # the right option stands at place id mod 5, the others follow
    options = F.array(*(F.struct(F.lit(LETTERS[i]).alias("letter"), text(F.get(values, ((i - F.col("id") + 5 * F.col("id")) % 5).cast("int"))).alias("text")) for i in range(5)))
    key = F.substring(F.lit(LETTERS), (F.col("id") % 5 + 1).cast("int"), F.lit(1))
    return part.select("id", "authority", F.concat(F.lit("kind-"), F.col("kind").cast("string")).alias("claim"), "stem", key.alias("key"), options.alias("options"), "p", "n", "s", "kind")


PROBLEMS_SQL = f"""ra AS (SELECT p_partkey AS id, p_type AS authority, p_size::BIGINT AS p, p_partkey % 90 + 10 AS n, p_size + p_partkey % 90 + 10 AS s, (p_partkey % 6)::INT AS kind FROM part),
rb AS (SELECT *, [(n - p) * 10000, p * 10000 // s, p * 1000000 // n, p * 10000 // n, (180 - s) * 10000, s * 20000 // 3][kind + 1] AS r FROM ra),
item AS (SELECT id, authority, 'kind-' || kind AS claim, '{LETTERS}'[(id % 5 + 1)::INT:(id % 5 + 1)::INT] AS key, p, n, s, kind FROM rb),
oa AS (SELECT id, unnest(range(5)) AS i, [r, r * 10, -r, r + 5000, r + 2000000] AS vs FROM rb), ob AS (SELECT id, '{LETTERS}'[i+1:i+1] AS letter, vs[((i + 4 * id) % 5 + 1)::INT] AS c FROM oa),
opt AS (SELECT id, letter, CASE WHEN c % 10000 = 0 THEN (c // 10000)::VARCHAR ELSE (c::DECIMAL(18, 4) / 10000)::DECIMAL(18, 4)::VARCHAR END AS t FROM ob), num AS (SELECT id, letter, t, t::DOUBLE AS v FROM opt),
lef AS (SELECT num.*, CASE kind WHEN 0 THEN v >= 0 AND abs(v - round_even(v, 0)) < 1e-6 WHEN 1 THEN v BETWEEN 0 AND 1 WHEN 2 THEN v BETWEEN 0 AND 100 WHEN 3 THEN v > 0 WHEN 4 THEN v > 0 AND v < 180
 ELSE v BETWEEN least(p, n, s) AND greatest(p, n, s) END AS stays FROM num JOIN item USING (id)),
eb AS (SELECT id, count(*) FILTER (stays) AS n_left, list_sort(list({{'v': v, 'letter': letter}}) FILTER (stays)) AS l FROM lef GROUP BY id),
el AS (SELECT id, CASE WHEN n_left > 0 THEN list_filter(l, lambda x: x.v = l[((n_left - 1) // 2 + 1)::INT].v)[1].letter END AS answer, CASE WHEN n_left > 0 THEN 1.0::DOUBLE / n_left END AS chance, n_left::INT AS n_left, coalesce(list_sort(list_transform(l, lambda x: x.letter)), []) AS letters FROM eb),
{edges_sql("num")}, hb AS (SELECT id, list_sort(list({{'v': v, 'letter': letter}}) FILTER (out_degree = top AND top > 0)) AS l FROM (SELECT *, max(out_degree) OVER (PARTITION BY id) AS top FROM ed) GROUP BY id),
hu AS (SELECT id, list_filter(l, lambda x: x.v = l[((len(l) - 1) // 2 + 1)::INT].v)[1].letter AS answer, list_sort(list_transform(l, lambda x: x.letter)) AS tied FROM hb)"""


def elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the stem's constraints and the pick among them, for every problem."""
    t = C.elimination(part_problems(spark, sf_dir))
    return t.select("id", "answer", F.round("chance", 6).alias("chance"), "n_constraints", "n_left", F.array_join("letters", "").alias("letters"))


def elimination_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What elimination leaves, by cell."""
    items = part_problems(spark, sf_dir)
    t = C.elimination_shares(C.elimination(items), items)
    for c in ("mean_left", "one_left", "key_left", "constrained", "eliminated"):
        t = t.withColumn(c, F.round(c, 6))
    return t


def hub_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that slips lead from most, with those tied for it."""
    return S.hub(part_problems(spark, sf_dir)).select("id", "answer", F.array_join("tied", "").alias("tied"))


def strategy_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elimination and hubs in every cell: rate, interval, binomial p, bar, Holm and Bonferroni within the channel and pooled."""
    items = part_problems(spark, sf_dir)
    t = C.channel_rows({"elimination": C.elimination(items), "hub": C.hub_channel(items, S.hub(items))}, items)
    for c in ("rate", "chance", "coverage", "lo", "hi"):
        t = t.withColumn(c, F.round(c, 6))
    return t.withColumn("p", F.round("p", 9))


_CHANNELS_SQL = f"""WITH {PROBLEMS_SQL}, ce AS (SELECT authority, claim, count(*) AS n_items FROM item GROUP BY ALL HAVING count(*) >= 10),
an AS (SELECT 'elimination' AS channel, id, answer, chance FROM el UNION ALL SELECT 'hub', id, answer, 0.2::DOUBLE FROM hu),
sc AS (SELECT channel, authority, claim, count(*) AS n, count(*) FILTER (answer = key) AS c, avg(chance) AS chance FROM an JOIN item USING (id) WHERE answer IS NOT NULL GROUP BY ALL),
rated AS (SELECT n, c FROM sc), {INTERVAL_SQL},
tl AS (SELECT channel, authority, claim, CASE WHEN any_value(c) = 0 OR any_value(chance) >= 1 THEN 1.0 ELSE least(1.0, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(chance) + (n - k) * ln(1 - chance)))) END AS p
 FROM (SELECT channel, authority, claim, n, c, least(chance, 1 - 1e-12) AS chance, unnest(range(c, n + 1)) AS k FROM sc) GROUP BY ALL),
j AS (SELECT channel, authority, claim, n_items, coalesce(n, 0) AS n_scored, coalesce(c, 0) AS n_correct, coalesce(chance, 0.0) AS chance, coalesce(c::DOUBLE / n, 0) AS rate, coalesce(n, 0)::DOUBLE / n_items AS coverage, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, coalesce(p, 1) AS p
 FROM ce CROSS JOIN (SELECT unnest(['elimination', 'hub']) AS channel) LEFT JOIN sc USING (channel, authority, claim) LEFT JOIN bound USING (n, c) LEFT JOIN tl USING (channel, authority, claim)),
f AS (SELECT *, n_scored >= 10 AND chance > 0 AS in_family, n_scored >= 10 AND chance > 0 AND lo > chance AS clears FROM j),
h AS (SELECT *, count(*) OVER a AS m1, row_number() OVER b - 1 AS r1, count(*) OVER c AS m2, row_number() OVER d - 1 AS r2 FROM f
 WINDOW a AS (PARTITION BY channel, in_family), b AS (PARTITION BY channel, in_family ORDER BY p, channel, authority, claim), c AS (PARTITION BY in_family), d AS (PARTITION BY in_family ORDER BY p, channel, authority, claim)),
g AS (SELECT *, in_family AND max((p > 0.05 / (m1 - r1))::INT) OVER (PARTITION BY channel, in_family ORDER BY r1) = 0 AS holm, in_family AND p <= 0.05 / m1 AS bonferroni, in_family AND max((p > 0.05 / (m2 - r2))::INT) OVER (PARTITION BY in_family ORDER BY r2) = 0 AS pooled_holm, in_family AND p <= 0.05 / m2 AS pooled_bonferroni FROM h)
SELECT channel, authority, claim, n_items, n_scored, n_correct, round(chance, 6) AS chance, round(rate, 6) AS rate, round(coverage, 6) AS coverage, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 9) AS p, in_family, clears, holm, bonferroni, pooled_holm, pooled_bonferroni FROM g"""


def hub_tie_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What random tie-breaks would make of the hub's ties: 1,000 redraws."""
    items = part_problems(spark, sf_dir)
    t = C.tie_null(S.hub(items).join(items.select("id", "key", F.col("id").alias("number")), "id"), TIE_SEED)
    for c in ("rule_rate", "expected_rate", "lo", "hi"):
        t = t.withColumn(c, F.round(c, 6))
    return t


_TIE_SQL = f"""WITH {PROBLEMS_SQL}, w AS (SELECT id, answer, tied, key, len(tied) AS k FROM hu JOIN item USING (id) WHERE answer IS NOT NULL),
bs AS (SELECT count(*) AS n, count(*) FILTER (k > 1) AS n_tied, avg((answer = key)::INT) AS rule_rate, avg(CASE WHEN k > 1 THEN list_contains(tied, key)::INT / k::DOUBLE ELSE (answer = key)::INT END) AS expected_rate, count(*) FILTER (k = 1 AND answer = key) AS sure FROM w),
dr AS (SELECT b, count(*) FILTER (tied[(floor({rng.sql(str(TIE_SEED), "(b * 2097152 + id)")} * k)::INT + 1)] = key) AS c FROM (SELECT *, unnest(range(1000)) AS b FROM w WHERE k > 1) GROUP BY b),
al AS (SELECT list_sort(list(coalesce(c, 0))) AS r FROM (SELECT unnest(range(1000)) AS b) LEFT JOIN dr USING (b))
SELECT n, n_tied, round(rule_rate, 6) AS rule_rate, round(expected_rate, 6) AS expected_rate, round((r[26] + sure) / n::DOUBLE, 6) AS lo, round((r[976] + sure) / n::DOUBLE, 6) AS hi FROM bs, al"""


def closure_tie_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the closure's ties; no SQL has its bound on values."""
    items = part_problems(spark, sf_dir)
    t = C.tie_null(S.closure_answers(items).join(items.select("id", "key", F.col("id").alias("number")), "id"), TIE_SEED)
    return t.select("n", "n_tied", *(F.round(c, 6).alias(c) for c in ("rule_rate", "expected_rate", "lo", "hi")))


def part_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item with equations for each part: a system, a line, an inequality, one equation of two variables; four options."""
    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    part = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("p"), (F.col("p_partkey") % 90 + 10).alias("n"), (F.col("p_partkey") % 4).cast("int").alias("kind"))
    say = lambda *xs: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs))
    p, n = F.col("p"), F.col("n")
    stems = F.array(say("If 2x + 3y = ", 2 * p + 3 * n, " and x - y = ", p - n, ", what is (x, y)?"), say("Solve 3x + 4 = ", 3 * p + 4, "."), say("Which pair satisfies y > 2x + ", p, "?"), say("If a + b = ", p + n, ", which (a, b) is right?"))
    pair = lambda x, y: say("(", x, ", ", y, ")")
    texts = F.array(
        F.array(pair(p, n), pair(n, p), say("x = ", p + 1, ", y = ", n), pair(p, n - 1)), F.array(say(p), say("x = ", p + 1), say("-", p), say(p, "/2")),
        F.array(pair(F.lit(1), p + 2), pair(F.lit(1), p + 3), pair(n, p), pair(F.lit(0), p)), F.array(pair(p, n), pair(p + 1, n), pair(n, p + 2), pair(p - 1, n)),
    )
    t = part.select("id", F.element_at(stems, F.col("kind") + 1).alias("stem"), F.element_at(texts, F.col("kind") + 1).alias("texts"))
    return t.select("id", "stem", F.array(*(F.struct(F.lit("ABCD"[i]).alias("letter"), F.get("texts", ((i + F.col("id")) % 4).cast("int")).alias("text")) for i in range(4))).alias("options"))


def equation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options put into the stems' equations: the only one that satisfies them, and what elimination gives."""
    t = Y.substitution(part_systems(spark, sf_dir))
    return t.select("id", "answer", "kind", "n_equations", F.array_join("hits", "").alias("hits"), F.round("solution.x", 6).alias("x"), F.round("solution.y", 6).alias("y"))


_SYSTEMS_SQL = """WITH i AS (SELECT p_partkey AS id, p_size::BIGINT AS p, p_partkey % 90 + 10 AS n, p_partkey % 4 AS kind FROM part),
o AS (SELECT *, unnest(range(4)) AS k FROM i), v AS (SELECT *, (k + id) % 4 AS j FROM o),
w AS (SELECT id, p, n, kind, 'ABCD'[k+1:k+1] AS letter, CASE kind WHEN 0 THEN [p, n, p + 1, p][(j + 1)::INT] WHEN 1 THEN [p, p + 1, -p, p / 2.0][(j + 1)::INT] WHEN 2 THEN [1, 1, n, 0][(j + 1)::INT] ELSE [p, p + 1, n, p - 1][(j + 1)::INT] END AS x,
 CASE kind WHEN 0 THEN [n, p, n, n - 1][(j + 1)::INT] WHEN 2 THEN [p + 2, p + 3, p, p][(j + 1)::INT] WHEN 3 THEN [n, n, p + 2, n][(j + 1)::INT] END AS y FROM v),
h AS (SELECT id, any_value(kind) AS kind, any_value(p) AS p, any_value(n) AS n, coalesce(list_sort(list(letter) FILTER (CASE kind WHEN 0 THEN 2 * x + 3 * y = 2 * p + 3 * n AND x - y = p - n WHEN 1 THEN 3 * x = 3 * p WHEN 2 THEN y > 2 * x + p ELSE x + y = p + n END)), []) AS hits FROM w GROUP BY id)
SELECT id, CASE WHEN len(hits) = 1 THEN hits[1] END AS answer, ['system', 'scalar', 'pair', 'pair'][(kind + 1)::INT] AS kind, CASE WHEN kind = 0 THEN 2 ELSE 1 END AS n_equations, array_to_string(hits, '') AS hits, CASE WHEN kind = 0 THEN p::DOUBLE END AS x, CASE WHEN kind = 0 THEN n::DOUBLE END AS y FROM h"""


def numeral_isomorphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every problem's options with redrawn numerals, in both arms, and what the redraw kept; the draws have no SQL."""
    items, out = stored(part_problems(spark, sf_dir).select("id", "options")), None  # read four times
    for arm in (N.KEPT, N.SCRAMBLED):
        told = stored(N.isomorphs(items, arm))
        texts = told.select("id", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"))
        t = N.checked(items, told).join(texts.hint("merge"), "id").withColumn("arm", F.lit(arm))
        out = t if out is None else out.unionByName(t)
    return out


def residual_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by kind, and how many of them neither the lower central value, the modal letter, the hub nor the longest option answers."""
    items = part_problems(spark, sf_dir)
    modal = items.join(R.modal_letters(items, ["claim"]).select("claim", F.col("letter").alias("answer")), "claim").select("id", "answer")
    o = F.transform("options", lambda x: F.struct(x["letter"].alias("letter"), T.option_number(T.clean_number(x["text"])).alias("v")))
    valued = once(items.select("id", "options"), o=F.filter(o, lambda x: x["v"].isNotNull()))
    lower = once(valued, answer=S.lower_central(F.col("o"))).select("id", "answer")
    longest = I.answers(items, ["longest-option"]).select("id", "answer")
    rest = R.residual_items(items, {"lower": lower, "modal": modal, "hub": S.hub(items), "longest": longest}).withColumn("rest", F.lit(1))
    return items.select("id", "claim").join(rest, "id", "left").groupBy("claim").agg(F.count("*").alias("n_items"), F.count("rest").alias("n_rest"))


_RESIDUAL_SQL = f"""WITH {PROBLEMS_SQL}, mc AS (SELECT claim, key, count(*) AS c FROM item GROUP BY ALL), mo AS (SELECT claim, arg_min(key, (-c, key)) AS modal FROM mc GROUP BY claim),
lg AS (SELECT id, arg_min(letter, (-len(t), letter)) AS longest FROM opt GROUP BY id), lo AS (SELECT id, list_sort(list({{'v': v, 'letter': letter}})) AS l FROM num GROUP BY id), lc AS (SELECT id, list_filter(l, lambda x: x.v = l[3].v)[1].letter AS central FROM lo),
j AS (SELECT claim, key IN (modal, longest, central) OR coalesce(key = hu.answer, false) AS hit FROM item JOIN mo USING (claim) JOIN lg USING (id) JOIN lc USING (id) LEFT JOIN hu USING (id))
SELECT claim, count(*) AS n_items, count(*) FILTER (NOT hit) AS n_rest FROM j GROUP BY claim"""

QUERIES = {"elimination": elimination, "elimination_shares": elimination_shares, "hub_answers": hub_answers, "strategy_channels": strategy_channels, "hub_tie_null": hub_tie_null, "closure_tie_null": closure_tie_null, "numeral_isomorphs": numeral_isomorphs, "equation_answers": equation_answers, "residual_problems": residual_problems}
ORACLES = {
    "elimination": f"WITH {PROBLEMS_SQL} SELECT id, answer, round(chance, 6) AS chance, 1 AS n_constraints, n_left, array_to_string(letters, '') AS letters FROM el",
    "elimination_shares": f"""WITH {PROBLEMS_SQL} SELECT authority, claim, count(*) AS n_items, round(avg(n_left), 6) AS mean_left, round(avg((n_left = 1)::INT), 6) AS one_left, round(avg(list_contains(letters, key)::INT), 6) AS key_left, 1.0::DOUBLE AS constrained,
 round(avg((n_left > 0 AND n_left < 5)::INT), 6) AS eliminated FROM el JOIN item USING (id) GROUP BY ALL HAVING count(*) >= 10""",
    "hub_answers": f"WITH {PROBLEMS_SQL} SELECT id, answer, CASE WHEN answer IS NULL THEN '' ELSE array_to_string(tied, '') END AS tied FROM item LEFT JOIN hu USING (id)",
    "strategy_channels": _CHANNELS_SQL,
    "hub_tie_null": _TIE_SQL,
    "equation_answers": _SYSTEMS_SQL,
    "residual_problems": _RESIDUAL_SQL,
}
