"""Items made of the order tables, and the scoring rules over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stored
from ..operators import items as I
from ..operators import programs as P
from ..operators import stats as ST


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over all tasks by a hash of ``key``: a small file is few tasks, however much is worked out for each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each order: its lines are the options, the dearest line is the key."""
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    price = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    line = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_quantity").cast("int").alias("q"), F.min(F.round(F.col("l_discount") * 100).cast("int")).alias("d"), price.alias("price"))
    line = line.join(part.select(F.col("p_partkey").alias("pk"), "p_name"), "pk", "left")
    extra = F.when(F.col("d") == 0, " always").when(F.col("d") == 1, " usually about").otherwise("")
    option = F.struct(F.chr(F.col("l_linenumber") + 64).alias("letter"), F.concat(F.col("q").cast("string"), F.lit(" "), F.coalesce("p_name", F.lit("")), extra).alias("text"), "price")
    options = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(option)).alias("o"))
    stem = F.concat(F.lit("Pick "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" of the "), F.element_at(F.array(*map(F.lit, STEMS)), (F.col("o_orderkey") % len(STEMS) + 1).cast("int")))
    orders = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("authority"), F.col("o_orderpriority").alias("claim"), stem.alias("stem"))
    dearest = F.array_max(F.transform("o", lambda x: x["price"]))
    key = F.get(F.filter("o", lambda x: x["price"] == dearest), F.lit(0))["letter"]
    return orders.join(options, "id").select("id", "authority", "claim", "stem", key.alias("key"), F.transform("o", lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"))).alias("options"))


#: Everyday words of part names, for the specificity of an option.
COMMON = ["red", "green", "blue", "small", "large", "widget", "ring", "bolt", "gear", "about", "always"]
STEMS = ("small rings or a", "green widget sold by an", "blue bolts", "large red gear and a", "shiny widget or bolts")

#: The same items for DuckDB: item (id, authority, claim, stem, key), opt (id, letter, text), one row for each option.
ITEMS_SQL = f"""
line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_quantity)::INT AS q, min(round(l_discount * 100)::INT) AS d, sum(round(l_extendedprice * 100)::BIGINT) AS price FROM lineitem GROUP BY ALL),
opt AS (SELECT l_orderkey AS id, chr(l_linenumber + 64) AS letter, q || ' ' || coalesce(p_name, '') || CASE WHEN d = 0 THEN ' always' WHEN d = 1 THEN ' usually about' ELSE '' END AS text, price
        FROM line LEFT JOIN part ON p_partkey = pk WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
item AS (SELECT o_orderkey AS id, o_orderstatus AS authority, o_orderpriority AS claim, 'Pick ' || (o_orderkey % 50) || ' of the ' || {list(STEMS)!r}[(o_orderkey % {len(STEMS)} + 1)::INT] AS stem, key
         FROM orders JOIN (SELECT id, arg_min(letter, (-price, letter)) AS key FROM opt GROUP BY id) ON id = o_orderkey),
tok AS (SELECT id, letter, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) >= 2) AS t FROM opt),
stok AS (SELECT id, list_filter(regexp_split_to_array(lower(stem), '[^a-z0-9]+'), lambda t: len(t) >= 4) AS st, regexp_extract_all(stem, '-?[0-9]+(?:[.,][0-9]+)?') AS sn FROM item),
elem AS (SELECT id, letter, list_distinct(CASE WHEN v = '' THEN t ELSE list_concat(t, ['num:' || v::DOUBLE, 'digits:' || regexp_replace(trim(text), '[^0-9-]', '', 'g')]) END) AS e
         FROM (SELECT *, regexp_extract(text, '^[^0-9-]*(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS v FROM tok))
"""

# one branch for each rule: (id, answer), only where it applies
_RULE_SQL = {
    "longest-option": "SELECT id, arg_min(letter, (-len(text), letter)) AS answer FROM opt GROUP BY id",
    "stem-option-overlap": "SELECT id, arg_min(letter, (-s, letter)) FROM (SELECT id, letter, len(list_filter(t, lambda x: list_contains(st, x))) AS s FROM tok JOIN stok USING (id)) GROUP BY id HAVING max(s) > 0",
    "option-repeating-stem-numbers": "SELECT id, min(letter) FROM opt JOIN stok USING (id) WHERE len(list_filter(sn, lambda k: contains(text, k))) > 0 GROUP BY id",
    "avoid-absolute-terms": "SELECT id, min(CASE WHEN NOT a THEN letter END) FROM (SELECT id, letter, regexp_matches(text, '(?i)\\b(always|never|all|none|only|every|impossible|certainly)\\b') AS a FROM opt) GROUP BY id HAVING count(*) FILTER (NOT a) = 1 AND count(*) FILTER (a) > 0",
    "middle-value-option": "SELECT id, min(letter) FROM (SELECT id, letter, v, list_sort(list(v) OVER (PARTITION BY id)) AS vs FROM (SELECT id, letter, regexp_extract(text, '^[^0-9-]*(-?[0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE AS v FROM opt)) WHERE len(vs) >= 3 AND v = vs[((len(vs) - 1) // 2 + 1)::INT] GROUP BY id",
    "position-c": "SELECT id, CASE WHEN list_contains(l, 'C') THEN 'C' ELSE l[((len(l) - 1) // 2 + 1)::INT] END FROM (SELECT id, list_sort(list(letter)) AS l FROM opt GROUP BY id)",
    "most-qualified-hedged-option": "SELECT id, max_by(letter, s) FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM (SELECT id, letter, len(regexp_extract_all(text, '(?i)\\b(sometimes|often|usually|generally|typically|seldom|rarely|occasionally|frequently|ordinarily|perhaps|possibly|probably|maybe|approximately|nearly|roughly|about|around|relatively|somewhat|mostly|likely|tends|tend|may|might|could|few|many|some|most)\\b')) AS s FROM opt)) WHERE s = m AND m > 0 GROUP BY id HAVING count(*) = 1",
    "convergence-option": "SELECT id, min(letter) FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM (SELECT a.id, a.letter, sum(CASE WHEN a.letter <> b.letter THEN len(list_intersect(a.e, b.e)) ELSE 0 END) AS s FROM elem a JOIN elem b USING (id) GROUP BY a.id, a.letter)) WHERE s = m AND m > 0 GROUP BY id HAVING count(*) = 1",
    "mean-of-other-options": "SELECT id, min(letter) FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM (SELECT id, letter, abs(v - (sum(v) OVER w - v) / (count(*) OVER w - 1)) AS d, count(*) OVER w AS n FROM (SELECT id, letter, regexp_extract(text, '^[^0-9-]*(-?[0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE AS v FROM opt) WINDOW w AS (PARTITION BY id)) WHERE n >= 3) WHERE d = m GROUP BY id HAVING count(*) = 1",
    "grammatical-fit-option": "SELECT id, min(CASE WHEN f THEN letter END) FROM (SELECT id, letter, (regexp_matches(trim(stem), '(?i)\\ban(\\s+_+)?\\s*$') AND regexp_matches(trim(text), '(?i)^[aeiou]')) OR (regexp_matches(trim(stem), '(?i)\\ba(\\s+_+)?\\s*$') AND regexp_matches(trim(text), '(?i)^[b-df-hj-np-tv-z]')) AS f FROM opt JOIN item USING (id)) GROUP BY id HAVING count(*) FILTER (f) = 1 AND count(*) > 1",
}
TRIALS_SQL = "trial AS (" + " UNION ALL ".join(f"SELECT id, '{k}' AS program, answer FROM ({v}) AS x(id, answer)" for k, v in _RULE_SQL.items()) + ")"
ORDER = list(_RULE_SQL)


def rule_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = order_items(spark, sf_dir)
    told = I.rule_chance(I.judged(items))
    return told.select("authority", "claim", "program", "n_scored", "n_correct", F.round("pass_rate", 6).alias("pass_rate"), F.round(F.coalesce("chance", F.lit(0.0)), 6).alias("chance"))


RULE_CHANCE_SQL = f"""WITH {ITEMS_SQL}, {TRIALS_SQL},
n AS (SELECT id, count(*) AS k FROM opt GROUP BY id), p AS (SELECT unnest({ORDER!r}) AS program)
SELECT authority, claim, p.program, count(answer) AS n_scored, count(*) FILTER (answer = key) AS n_correct, round(coalesce(avg(CASE WHEN answer IS NOT NULL THEN (answer = key)::INT END), 0)::DOUBLE, 6) AS pass_rate,
round(coalesce(avg(CASE WHEN answer IS NOT NULL THEN 1.0::DOUBLE / k END), 0), 6) AS chance
FROM item CROSS JOIN p JOIN n USING (id) LEFT JOIN trial t ON t.id = item.id AND t.program = p.program GROUP BY ALL"""


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = order_items(spark, sf_dir)
    return I.first_witness(I.judged(items), ORDER)


WITNESS_SQL = f"""WITH {ITEMS_SQL}, {TRIALS_SQL}
SELECT id, arg_min(program, list_position({ORDER!r}, program)) AS witness, count(*) AS n_witnesses FROM trial JOIN item USING (id) WHERE answer = key GROUP BY id"""


#: Binomial quantiles of distinct (n, c): the first count whose cumulated probability reaches the share.
INTERVAL_SQL = """nc AS (SELECT DISTINCT n, c FROM rated), term AS (SELECT n, c, unnest(range(n + 1)) AS k FROM nc WHERE c > 0 AND c < n),
cum AS (SELECT n, c, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(c::DOUBLE / n) + (n - k) * ln(1 - c::DOUBLE / n))) OVER (PARTITION BY n, c ORDER BY k) AS p FROM term),
bound AS (SELECT n, c, min(k) FILTER (p >= 0.025)::DOUBLE / n AS lo, min(k) FILTER (p >= 0.975)::DOUBLE / n AS hi FROM cum GROUP BY n, c UNION ALL SELECT n, c, c::DOUBLE / n, c::DOUBLE / n FROM nc WHERE c = 0 OR c = n)"""
#: Programs whose interval lies above chance in a cell, with ten answers or more.
GOOD_SQL = f"""rated AS (SELECT authority, claim, program, count(*) AS n, count(*) FILTER (answer = key) AS c, avg(1.0::DOUBLE / k) AS chance FROM trial JOIN item USING (id) JOIN n USING (id) WHERE answer IS NOT NULL GROUP BY ALL), {INTERVAL_SQL},
good AS (SELECT authority, claim, program FROM rated JOIN bound USING (n, c) WHERE n >= 10 AND lo > chance)"""


def _good(scored: DataFrame) -> DataFrame:
    """(authority, claim, program) of programs whose interval lies above chance, with ten answers or more."""
    return ST.with_interval(I.rule_chance(scored)).filter("n_scored >= 10 and lo > chance").select("authority", "claim", "program")


def eligible_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items answered by a program that beats chance in its cell, by the lower end of its interval and with at least ten trials: semi-join, then roll-up by cell."""
    items = stored(I.told(order_items(spark, sf_dir)))
    scored = I.trials(items)
    hit = scored.filter("correct").join(_good(scored), ["authority", "claim", "program"], "left_semi").select("id").distinct().withColumn("hit", F.lit(1))
    return items.select("id", "authority", "claim").join(hit.hint("merge"), "id", "left").groupBy("authority", "claim").agg(F.count("*").alias("items"), F.count("hit").alias("bypassed"), F.round(F.count("hit") / F.count("*"), 6).alias("bypass_rate"))


ELIGIBLE_SQL = f"""WITH {ITEMS_SQL}, {TRIALS_SQL}, n AS (SELECT id, count(*) AS k FROM opt GROUP BY id),
{GOOD_SQL},
hit AS (SELECT DISTINCT id FROM trial JOIN item USING (id) JOIN good USING (authority, claim, program) WHERE answer = key)
SELECT authority, claim, count(*) AS items, count(h.id) AS bypassed, round(count(h.id)::DOUBLE / count(*), 6) AS bypass_rate FROM item LEFT JOIN hit h USING (id) GROUP BY ALL"""


def option_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.features(order_items(spark, sf_dir), COMMON)
    return f.withColumn("distinctive", F.round("distinctive", 6)).withColumn("specificity", F.round("specificity", 6))


FEATURES_SQL = f"""WITH {ITEMS_SQL},
v AS (SELECT *, regexp_extract(text, '^[^0-9-]*(-?[0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE AS v, list_distinct(t) AS u FROM tok),
g AS (SELECT id, max(len(text)) AS top, list(v) AS vs, list_sort(list(v)) AS sv, list({{'letter': letter, 'u': u, 'n': len(text)}}) AS o FROM v GROUP BY id),
j AS (SELECT a.id, a.letter, sum(CASE WHEN a.letter <> b.letter THEN len(list_intersect(a.u, b.u))::DOUBLE / greatest(len(list_distinct(list_concat(a.u, b.u))), 1) ELSE 0 END) AS s, count(*) AS k FROM v a JOIN v b USING (id) GROUP BY ALL)
SELECT v.id, v.letter, (len(text) = top AND len(list_filter(o, lambda x: x.n = top)) = 1)::INT AS longest, (v.letter = 'C')::INT AS position_c, len(list_intersect(u, st))::INT AS overlap,
(len(list_filter(sn, lambda k: contains(text, k))) > 0)::INT AS num_repeat, (NOT regexp_matches(text, '(?i)\\b(always|never|all|none|only|every|impossible|certainly)\\b'))::INT AS no_absolute,
(len(sv) >= 2 AND v = sv[1] AND len(list_filter(vs, lambda x: x = sv[1])) = 1)::INT AS numeric_min,
(len(sv) >= 3 AND v = sv[((len(sv) - 1) // 2 + 1)::INT] AND len(list_filter(vs, lambda x: x = sv[((len(sv) - 1) // 2 + 1)::INT])) = 1)::INT AS numeric_med,
(len(sv) >= 2 AND v = sv[-1] AND len(list_filter(vs, lambda x: x = sv[-1])) = 1)::INT AS numeric_max,
round(len(list_intersect(u, {COMMON!r})) + len(u) * 0.1::DOUBLE, 6) AS specificity,
CASE WHEN regexp_matches(trim(stem), '(?i)\\ban(\\s+_+)?\\s*$') THEN regexp_matches(trim(text), '(?i)^[aeiou]')::INT WHEN regexp_matches(trim(stem), '(?i)\\ba(\\s+_+)?\\s*$') THEN regexp_matches(trim(text), '(?i)^[b-df-hj-np-tv-z]')::INT ELSE 0 END AS grammar_agree,
round(1 - CASE WHEN k > 1 THEN s / (k - 1) ELSE 0 END, 6) AS distinctive FROM v JOIN g USING (id) JOIN stok USING (id) JOIN item USING (id) JOIN j ON j.id = v.id AND j.letter = v.letter"""


def pair_programs() -> list[P.Program]:
    """Single features, their sums and their differences."""
    out = [P.Program(f, "w", {f: 1.0}) for f in _F]
    for a, b in combinations(_F, 2):
        out += [P.Program(f"{a}+{b}", "w", {a: 1.0, b: 1.0}), P.Program(f"{a}-{b}", "w", {a: 1.0, b: -1.0})]
    return out


def program_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on even ids, the twelve best programs with eight or more answers (ties by name), judged on odd ids."""
    feats = I.feature_arrays(order_items(spark, sf_dir), COMMON, ["key"])
    feats = feats.withColumn("features", F.transform("features", lambda x: x.withField("distinctive", F.round(x["distinctive"], 6)).withField("specificity", F.round(x["specificity"], 6))))
    told = P.tally(feats.withColumn("train", F.col("id") % 2 == 0), pair_programs(), ["train"])
    rates = told.groupBy("program").agg(*(F.sum(F.when(F.col("train") == on, F.col(c)).otherwise(0)).alias(f"{half}_{c}") for half, on in (("train", True), ("held", False)) for c in ("n", "ok")))
    rates = rates.filter("train_n >= 8").withColumn("train_rate", F.round(F.col("train_ok") / F.col("train_n"), 6)).withColumn("held_rate", F.round(F.try_divide("held_ok", "held_n"), 6))
    return rates.orderBy(F.desc("train_rate"), "program").limit(12).select("program", "train_n", "train_rate", "held_n", "held_rate")


_F = ["longest", "position_c", "overlap", "num_repeat", "no_absolute", "numeric_min", "numeric_med", "numeric_max", "specificity", "grammar_agree", "distinctive"]
SEARCH_SQL = f"""WITH RECURSIVE fx AS MATERIALIZED ({FEATURES_SQL.replace("WITH ", "WITH ", 1)}), {ITEMS_SQL},
fl AS (UNPIVOT (SELECT id, letter, {", ".join(f"{c}::DOUBLE AS {c}" for c in _F)} FROM fx) ON {", ".join(_F)} INTO NAME feature VALUE v),
nm AS (SELECT unnest({_F!r}) AS f, unnest(range({len(_F)})) AS i),
pr AS (SELECT f AS program, f AS feature, 1.0::DOUBLE AS weight FROM nm UNION ALL
 SELECT a.f || s || b.f, unnest([a.f, b.f]), unnest([1.0::DOUBLE, CASE s WHEN '+' THEN 1.0 ELSE -1.0 END]) FROM nm a JOIN nm b ON a.i < b.i CROSS JOIN (SELECT unnest(['+', '-']) AS s)),
sm AS (SELECT id, program, letter, sum(round(v * weight, 9)) AS s FROM fl JOIN pr USING (feature) WHERE v <> 0 GROUP BY ALL),
ba AS (SELECT id, program, max(s) AS top, max_by(letter, s) AS answer, count(*) FILTER (s = m) AS k FROM (SELECT *, max(s) OVER (PARTITION BY id, program) AS m FROM sm) GROUP BY ALL HAVING max(s) > 0 AND count(*) FILTER (s = m) = 1),
jd AS (SELECT program, id, (answer = key)::INT AS ok FROM ba JOIN item USING (id)),
rt AS (SELECT program, count(*) FILTER (id % 2 = 0) AS train_n, coalesce(sum(ok) FILTER (id % 2 = 0), 0) AS a, count(*) FILTER (id % 2 = 1) AS held_n, coalesce(sum(ok) FILTER (id % 2 = 1), 0) AS b FROM jd GROUP BY program)
SELECT program, train_n, round(a::DOUBLE / train_n, 6) AS train_rate, held_n, round(b::DOUBLE / nullif(held_n, 0), 6) AS held_rate FROM rt WHERE train_n >= 8 ORDER BY train_rate DESC, program LIMIT 12"""

QUERIES = {"rule_chance": rule_chance, "first_witness": witnesses, "eligible_bypass": eligible_bypass, "option_features": option_features, "program_search": program_search}
ORACLES = {"rule_chance": RULE_CHANCE_SQL, "first_witness": WITNESS_SQL, "eligible_bypass": ELIGIBLE_SQL, "option_features": FEATURES_SQL, "program_search": SEARCH_SQL}


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computation items made of parts: a stem of one of four kinds, four numbers to choose from."""
    part = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    part = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("p"), (F.col("p_partkey") % 90 + 10).alias("n"))
    kinds = [F.concat(F.lit(a), F.col(x).cast("string"), F.lit(b), F.col(y).cast("string"), F.lit(c)) for a, x, b, y, c in PART_STEMS]
    stem = F.element_at(F.array(*kinds), (F.col("id") % 4 + 1).cast("int"))
    cents = [F.col("p") * F.col("n"), F.col("n") * (100 - F.col("p")), F.col("p") * F.col("n") * 100, (F.col("p") + F.col("n")) * 50]
    text = lambda v: (v.cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string")
    options = F.array(*[F.struct(F.lit("ABCD"[i]).alias("letter"), text(v).alias("text")) for i, v in enumerate(cents)])
    return part.select("id", "p", "n", stem.alias("stem"), options.alias("options"))


PART_STEMS = [("What is ", "p", "% of ", "n", "?"), ("A discount of ", "p", "% on ", "n", " zeds"), ("The area of a rectangle, ", "p", " by ", "n", "."), ("The average of ", "p", " and ", "n", ".")]


def formula_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which option each formula rule gives, by kind of stem."""
    from ..functions import formulas

    items = part_items(spark, sf_dir)
    told = formulas.answers(F.col("stem"), F.col("options"))
    names = ["percent-of", "percent-change", "area-lw", "mean-of-listed-numbers"]
    rows = items.select((F.col("id") % 4).alias("kind"), F.explode(F.array(*[F.struct(F.lit(k).alias("program"), told[k].alias("answer")) for k in names])).alias("t"))
    return rows.select("kind", "t.*").filter("answer is not null").groupBy("kind", "program", "answer").agg(F.count("*").alias("n"))


FORMULA_SQL = """WITH i AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, p_size::DOUBLE AS p, (p_partkey % 90 + 10)::DOUBLE AS n FROM part),
o AS (SELECT *, [p * n / 100, n * (100 - p) / 100, p * n, (p + n) / 2] AS c, CASE WHEN p = n THEN NULL ELSE n END AS other FROM i),
v AS (SELECT kind, c, 'percent-of' AS program, p / 100 * other AS v FROM o WHERE kind IN (0, 1) UNION ALL SELECT kind, c, 'percent-change', other * (1 - p / 100) FROM o WHERE kind = 1
 UNION ALL SELECT kind, c, 'area-lw', p * n FROM o WHERE kind = 2 UNION ALL SELECT kind, c, 'mean-of-listed-numbers', (p + n) / 2 FROM o WHERE kind = 3),
h AS (SELECT kind, program, list_filter([1, 2, 3, 4], lambda k: abs(c[k] - v) <= 1e-4 * greatest(1, abs(c[k]), abs(v)) OR abs(c[k] - v) < 0.01)[1] AS k FROM v WHERE v IS NOT NULL)
SELECT kind, program, ['A', 'B', 'C', 'D'][k] AS answer, count(*) AS n FROM h WHERE k IS NOT NULL GROUP BY ALL"""


def transform_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees of options under numeric slips."""
    from ..operators import strategies

    return strategies.transform_edges(part_items(spark, sf_dir))


def _slips_sql(v: str, t: str) -> str:
    """The values that slips make of a number v written as t, as a list."""
    body, sign = f"regexp_replace({t}, '^-', '')", f"(CASE WHEN {t} LIKE '-%' THEN -1.0 ELSE 1.0 END)"
    d = f"replace({body}, '.', '')"
    written = f"pow(10.0, len(regexp_extract({t}, '\\.([0-9]+)', 1)))"
    swaps = f"list_transform(range(1, len({d})), lambda j: {sign} * ({d}[1:j-1] || {d}[j+1:j+1] || {d}[j:j] || {d}[j+2:])::DOUBLE / {written})"
    zero = f"CASE WHEN abs({v} - round_even({v}, 0)) < 1e-9 AND abs(round_even({v}, 0)) >= 10 AND round_even({v}, 0) % 10 = 0 THEN round_even({v}, 0) / 10 END, CASE WHEN {body} LIKE '%0' AND len({d}) >= 2 THEN {sign} * TRY_CAST(regexp_replace({body}, '0$', '') AS DOUBLE) END"
    plain = f"[{v} * 2, {v} / 2, {v} * 10, {v} / 10, {v} + 1, {v} - 1, -{v}, CASE WHEN {v} <> 0 THEN 1 / {v} END, {v} * {v}, CASE WHEN {v} >= 0 THEN sqrt({v}) END, {zero}, round_even({v} * 1.1 * {written}, 0) / {written}, round_even({v} * 0.9 * {written}, 0) / {written}]"
    return f"list_filter(list_concat({plain}, {swaps}), lambda x: x IS NOT NULL AND abs(x) <= 1e12)"


def edges_sql(options: str) -> str:
    """(id, letter, v, out_degree) of a table of numeric options (id, letter, v, t)."""
    return f"""sl AS MATERIALIZED (SELECT id, letter, v, {_slips_sql('v', 't')} AS made FROM {options}),
ed AS (SELECT a.id, a.letter, any_value(a.v) AS v, count(*) FILTER (a.letter <> b.letter AND len(list_filter(a.made, lambda x: abs(b.v - x) <= 1e-4 * greatest(1, abs(b.v), abs(x)) OR abs(b.v - x) < 0.01)) > 0)::INT AS out_degree FROM sl a JOIN sl b USING (id) GROUP BY a.id, a.letter)"""


HUB_SQL = f"""WITH i AS (SELECT p_partkey AS id, p_size AS p, p_partkey % 90 + 10 AS n FROM part),
o AS (SELECT id, unnest(['A', 'B', 'C', 'D']) AS letter, unnest([p * n, n * (100 - p), p * n * 100, (p + n) * 50]) AS c FROM i), w AS (SELECT id, letter, (c::DECIMAL(18, 2) / 100)::DECIMAL(18, 2)::VARCHAR AS t FROM o), q AS (SELECT *, t::DOUBLE AS v FROM w),
{edges_sql('q')} SELECT id, letter, out_degree FROM ed"""


def arithmetic_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the closure strategy by depth; its bound on values has no SQL."""
    from ..operators import strategies

    return strategies.closure_answers(part_items(spark, sf_dir)).groupBy("answer", "depth").agg(F.count("*").alias("n"))


QUERIES |= {"formula_rules": formula_rules, "transform_hub": transform_hub, "arithmetic_closure": arithmetic_closure}
ORACLES |= {"formula_rules": FORMULA_SQL, "transform_hub": HUB_SQL}

# fixed values: what a claim asks for, and what a program does without
OPERATIONS = {"1-URGENT": ["retrieve", "execute"], "2-HIGH": ["execute", "bind"], "3-MEDIUM": ["bind", "explain"], "5-LOW": ["retrieve", "transfer"]}
LACKS = {
    "longest-option": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "stem-option-overlap": ["bind", "distinguish", "explain"],
    "option-repeating-stem-numbers": ["bind", "distinguish", "explain"],
    "avoid-absolute-terms": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "middle-value-option": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "position-c": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "most-qualified-hedged-option": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "convergence-option": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "mean-of-other-options": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
    "grammatical-fit-option": ["retrieve", "execute", "bind", "distinguish", "explain", "transfer"],
}
# end of fixed values


def _census(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators import census as C

    items = stored(I.told(order_items(spark, sf_dir)))
    scored = I.trials(items)
    # a claim that is listed twice counts as it is listed first
    listed = [(a, c, ops) for a in "FOP" for c, ops in OPERATIONS.items()] + [("O", "1-URGENT", ["bind"])]
    claims = spark.createDataFrame([(*row, i) for i, row in enumerate(listed)], "authority string, code string, operations array<string>, place int")
    programs = spark.createDataFrame([(p, i, LACKS[p]) for i, p in enumerate(ORDER)], "program string, ord int, lacks array<string>")
    return items, C.cells(items, claims, scored, _good(scored), programs)


def census_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requirement matrix: a value and the first witness for each item and operation."""
    return _census(spark, sf_dir)[1]


def census_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import census as C

    t = C.comparisons(*_census(spark, sf_dir))
    return t.withColumn("bypass_rate", F.round("bypass_rate", 6))


_CELLS_SQL = f"""WITH {ITEMS_SQL}, {TRIALS_SQL}, n AS (SELECT id, count(*) AS k FROM opt GROUP BY id),
{GOOD_SQL},
ops AS ({" UNION ALL ".join(f"SELECT '{c}' AS claim, unnest({o!r}) AS operation" for c, o in OPERATIONS.items())}),
lacks AS ({" UNION ALL ".join(f"SELECT '{p}' AS program, {i} AS ord, unnest({LACKS[p]!r}) AS operation" for i, p in enumerate(ORDER))}),
w AS (SELECT id, operation, arg_min(program, ord) AS witness FROM trial JOIN item USING (id) JOIN good USING (authority, claim, program) JOIN lacks USING (program) WHERE answer = key GROUP BY ALL),
tried AS (SELECT id, max((answer IS NOT NULL)::INT) AS t FROM trial GROUP BY id),
cells AS (SELECT id, authority, claim, operation, CASE WHEN witness IS NULL THEN 1 ELSE 0 END AS value, witness, coalesce(t, 0) = 1 AS attempted FROM item JOIN ops USING (claim) LEFT JOIN w USING (id, operation) LEFT JOIN tried USING (id))"""
CENSUS_CELLS_SQL = f"{_CELLS_SQL} SELECT * FROM cells"
CENSUS_COMPARISONS_SQL = f"""{_CELLS_SQL}, b AS (SELECT id, count(*) FILTER (attempted) AS a, count(*) FILTER (attempted AND value = 0) AS z, min(value) AS low FROM cells GROUP BY id)
SELECT authority, claim, count(*) AS n_items, count(*) FILTER (a > 0) AS n_attempted, round(coalesce(sum(z)::DOUBLE / nullif(sum(a), 0), 0), 6) AS bypass_rate, coalesce(sum(z), 0)::BIGINT AS n_witnesses, count(*) FILTER (low = 1 AND a > 0) AS n_positive
FROM item LEFT JOIN b USING (id) GROUP BY ALL"""

QUERIES |= {"census_cells": census_cells, "census_comparisons": census_comparisons}
ORACLES |= {"census_cells": CENSUS_CELLS_SQL, "census_comparisons": CENSUS_COMPARISONS_SQL}
