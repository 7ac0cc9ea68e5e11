"""Searched cue programs over the items made of the order tables, with their random null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stored
from ..operators import items as I
from ..operators import programs as P
from .exam import _F, COMMON, FEATURES_SQL, INTERVAL_SQL, ITEMS_SQL, TRIALS_SQL, order_items

#: Directions of fitting: what programs are chosen on, and what they are judged on.
DIRECTIONS = {"open-to-rest": ("authority = 'O'", "authority <> 'O'", 20260916), "rest-to-open": ("authority <> 'O'", "authority = 'O'", 20260917)}
LETTERS = "ABCDEFG"


def _patterns(items: DataFrame, *by: str) -> DataFrame:
    """Distinct items by their options' features, in the six digits that DuckDB's rounding gives too."""
    return I.patterns(items, COMMON, by)


def _sql_programs(programs: list[P.Program]) -> str:
    rows = ", ".join(f"({i}, '{p.id}', {', '.join(str(p.weights.get(f, 0.0)) for f in _F)})" for i, p in enumerate(programs))
    return f"(SELECT * FROM (VALUES {rows}) AS v(ord, program, {', '.join(f'w{i}' for i in range(len(_F)))}))"


def _sql_picks(programs: list[P.Program], loose: bool = False) -> str:
    """(program, id, answer) of answered items; an item is one row with each letter's features, a program one row of weights."""
    n = range(len(_F))
    dot = lambda x: " + ".join(f"{x}{i} * w{i}" for i in n)
    out = []
    for some in ([p for p in programs if p.kind == "and"], [p for p in programs if p.kind != "and"]):
        if not some:
            continue
        score = lambda x: f"CASE WHEN {x}0 IS NULL THEN NULL WHEN {' AND '.join(f'(w{i} = 0 OR {x}{i} > 0)' for i in n)} THEN {dot(x)} ELSE 0 END" if some[0].kind == "and" else dot(x)  # noqa: B023, E731
        scores = f"SELECT program, id, {', '.join(f'{score(x)} AS s{x}' for x in LETTERS)} FROM wide CROSS JOIN {_sql_programs(some)}"
        top, count = f"greatest({', '.join(f's{x}' for x in LETTERS)})", " + ".join(f"coalesce((s{x} = top)::INT, 0)" for x in LETTERS)
        letter = "CASE " + " ".join(f"WHEN s{x} = top THEN '{x}'" for x in LETTERS) + " END"
        where = "" if loose else f" WHERE top > 0 AND {count} = 1"
        out.append(f"SELECT program, id, {letter} AS answer FROM (SELECT *, {top} AS top FROM ({scores})){where}")
    return " UNION ALL ".join(out)


_WIDE_SQL = f"""WITH fx AS MATERIALIZED ({FEATURES_SQL}), {ITEMS_SQL},
wide AS MATERIALIZED (SELECT id, {", ".join(f"max(CASE WHEN letter = '{x}' THEN round({f}::DOUBLE * 1000000) END) AS {x}{i}" for x in LETTERS for i, f in enumerate(_F))} FROM fx GROUP BY id)"""
EVERY = P.enumerate_programs(_F)


def program_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 1,562 programs over all items: answers and right ones on open orders and on the rest, with what their ids say."""
    side = F.when(F.col("authority") == "O", "open").otherwise("rest")
    told = P.tally(_patterns(order_items(spark, sf_dir).withColumn("side", side), "side"), EVERY, ["side"])
    t = told.groupBy("program").agg(*(F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s in ("open", "rest") for c in ("n", "ok")))
    parsed = P.parse_ids(t)
    return parsed.select("program", "kind", F.size("weights").alias("k"), F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x).alias("weight"), "open_n", "open_ok", "rest_n", "rest_ok")


PROGRAM_SPACE_SQL = f"""{_WIDE_SQL}, pick AS ({_sql_picks(EVERY)}),
c AS (SELECT program, count(*) FILTER (authority = 'O') AS open_n, count(*) FILTER (authority = 'O' AND answer = key) AS open_ok, count(*) FILTER (authority <> 'O') AS rest_n, count(*) FILTER (authority <> 'O' AND answer = key) AS rest_ok FROM pick JOIN item USING (id) GROUP BY program)
SELECT program, regexp_extract(program, '/([a-z]+):', 1) AS kind, (CASE WHEN program LIKE '%/w:%' THEN len(string_split(program, ',')) ELSE len(string_split(program, '+')) END)::INT AS k,
(CASE WHEN program LIKE '%/w:%' THEN list_sum(list_transform(regexp_extract_all(program, '[+-]1'), lambda x: x::DOUBLE)) ELSE len(string_split(program, '+')) END)::DOUBLE AS weight, open_n, open_ok, rest_n, rest_ok FROM c"""


def _fits(arrays: DataFrame) -> dict[str, tuple[list[P.Program], list[P.Program]]]:
    """By direction: the best programs of its training items, and its random ones."""
    out = {}
    for name, (train, _, seed) in DIRECTIONS.items():
        out[name] = P.top_programs(P.rates_of(arrays.filter(train))(EVERY), EVERY), P.random_programs(_F, seed)
    return out


def _judged_programs(arrays: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by.., direction, program, n, ok, chance) of the selected and of the random programs, on what their direction judges."""
    told = []
    for name, (selected, randoms) in _fits(arrays).items():
        t = P.tally(arrays.filter(DIRECTIONS[name][1]), selected + randoms, by)
        told.append(t.withColumn("direction", F.lit(name)))
    both = told[0].unionByName(told[1])
    random = F.col("program").contains("/random:")
    return both.filter(~random), both.filter(random)


def rule_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule, searched and random program by cell: rate, interval, random percentile, and whether its passes are claimed."""
    items = stored(order_items(spark, sf_dir))  # the rules read them, and the programs
    arrays = stored(_patterns(items, "authority", "claim"))
    selected, randoms = _judged_programs(arrays, ["authority", "claim"])
    rules = I.rule_chance(I.judged(items)).filter("n_scored > 0").select("authority", "claim", F.lit(None).cast("string").alias("direction"), "program", "n_scored", "n_correct", "chance")
    counted = selected.unionByName(randoms).select("authority", "claim", "direction", "program", F.col("n").alias("n_scored"), F.col("ok").alias("n_correct"), (F.col("chance") / F.col("n")).alias("chance"))
    t = P.eligibility(rules.unionByName(counted), randoms, ["authority", "claim"])
    for c in ("chance", "pass_rate", "lo", "hi", "p95"):
        t = t.withColumn(c, F.round(c, 6))
    return t.withColumn("direction", F.coalesce("direction", F.lit("none"))).select("authority", "claim", "direction", "program", "n_scored", "n_correct", "chance", "pass_rate", "lo", "hi", "beats", "p95", "eligible", "note")


def _fits_sql() -> str:
    """Trials of the selected and random programs of both directions: (direction, program, id, answer)."""
    every, parts = f"pick AS ({_sql_picks(EVERY)}), ord AS {_sql_programs(EVERY)}", []
    for i, (name, (train, judge, seed)) in enumerate(DIRECTIONS.items()):
        every += f", top{i} AS (SELECT program FROM (SELECT program, avg((answer = key)::INT) AS r FROM pick JOIN item USING (id) WHERE {train} GROUP BY program HAVING count(*) >= {P.LEAST_ANSWERS}) JOIN ord USING (program) ORDER BY r DESC, ord LIMIT {P.SELECTED})"
        every += f", rnd{i} AS ({_sql_picks(P.random_programs(_F, seed), loose=True)})"
        parts += [f"SELECT '{name}' AS direction, program, id, answer FROM {t} JOIN item USING (id) WHERE {judge}" for t in (f"(SELECT * FROM pick SEMI JOIN top{i} USING (program))", f"rnd{i}")]
    return f"{every}, fit AS ({' UNION ALL '.join(parts)})"


RULE_ELIGIBILITY_SQL = f"""{_WIDE_SQL}, {TRIALS_SQL}, {_fits_sql()}, sz AS (SELECT id, count(*) AS size FROM opt GROUP BY id),
every AS (SELECT 'none' AS direction, program, id, answer FROM trial WHERE answer IS NOT NULL UNION ALL SELECT * FROM fit),
rated AS (SELECT authority, claim, direction, program, count(*) AS n, count(*) FILTER (answer = key) AS c, avg(1.0::DOUBLE / size) AS chance FROM every JOIN item USING (id) JOIN sz USING (id) GROUP BY ALL),
{INTERVAL_SQL}, kk AS (SELECT *, CASE WHEN program LIKE '%/atom:%' THEN 1 WHEN program LIKE '%/and:%' THEN 2 WHEN program LIKE '%random:k%' THEN regexp_extract(program, 'random:k([0-9]+)', 1)::INT ELSE least(3, len(program) - len(replace(program, '+', '')) + 1) END AS k FROM rated),
p AS (SELECT authority, claim, direction, k, list_sort(list(c::DOUBLE / n)) AS r FROM kk WHERE program LIKE '%/random:%' AND n >= {P.LEAST_ANSWERS} GROUP BY ALL),
j AS (SELECT kk.*, lo, hi, lo > chance AS beats, CASE WHEN program LIKE 'search/%' THEN coalesce(r[ceil(0.95 * len(r))::INT], 1.0) ELSE 0.0 END AS p95 FROM kk JOIN bound USING (n, c) LEFT JOIN p USING (authority, claim, direction, k)),
e AS (SELECT *, beats AND n >= {P.LEAST_WITNESS} AND (program NOT LIKE 'search/%' OR c::DOUBLE / n >= p95) AND program NOT LIKE '%/random:%' AS eligible FROM j)
SELECT authority, claim, direction, program, n AS n_scored, c AS n_correct, round(chance, 6) AS chance, round(c::DOUBLE / n, 6) AS pass_rate, round(lo, 6) AS lo, round(hi, 6) AS hi, beats, round(p95::DOUBLE, 6) AS p95, eligible,
CASE WHEN eligible THEN 'eligible' WHEN beats AND n < {P.LEAST_WITNESS} THEN 'too few' WHEN beats AND program LIKE 'search/%' AND c::DOUBLE / n < p95 THEN 'below random p95' WHEN beats THEN 'random baseline' ELSE 'does not beat chance' END AS note FROM e"""


def random_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random programs' pass rates by direction, claim and number of features: how many, and four order statistics."""
    arrays = stored(_patterns(order_items(spark, sf_dir), "authority", "claim"))  # read for both directions
    told = [P.tally(arrays.filter(judge), P.random_programs(_F, seed), ["claim"]).withColumn("direction", F.lit(name)) for name, (_, judge, seed) in DIRECTIONS.items()]
    r = F.col("rates")
    t = P.random_rates(told[0].unionByName(told[1]), ["direction", "claim"])
    return t.select("direction", "claim", "k", F.size(r).cast("long").alias("n"), *(F.round(v, 6).alias(c) for c, v in {"low": F.get(r, F.lit(0)), "median": P.rank_value(r, 0.5), "p95_upper": P.rank_value(r, 0.95), "p95_lower": P.rank_value(r, 0.95, False)}.items()))


RANDOM_NULL_SQL = f"""{_WIDE_SQL}, {", ".join(f"rnd{i} AS ({_sql_picks(P.random_programs(_F, s), loose=True)})" for i, (_, _, s) in enumerate(DIRECTIONS.values()))},
t AS ({" UNION ALL ".join(f"SELECT '{d}' AS direction, claim, program, avg((answer = key)::INT) AS r FROM rnd{i} JOIN item USING (id) WHERE {j} GROUP BY ALL HAVING count(*) >= {P.LEAST_ANSWERS}" for i, (d, (_, j, _)) in enumerate(DIRECTIONS.items()))}),
g AS (SELECT direction, claim, regexp_extract(program, 'random:k([0-9]+)', 1)::INT AS k, list_sort(list(r)) AS r FROM t GROUP BY ALL)
SELECT direction, claim, k, len(r) AS n, round(r[1], 6) AS low, round(r[ceil(0.5 * len(r))::INT], 6) AS median, round(r[ceil(0.95 * len(r))::INT], 6) AS p95_upper, round(r[least(len(r), floor(0.95 * len(r))::INT + 1)], 6) AS p95_lower FROM g"""


def search_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fit by direction (twelve best, a greedy and an evolved program), judged on the other side; no SQL walks so."""
    arrays, told = stored(_patterns(order_items(spark, sf_dir), "authority")), None  # each step of a search is a job over them
    for name, (train, judge, seed) in DIRECTIONS.items():
        selected, _ = P.fit_search(arrays.filter(train), _F, seed)
        t = P.tally(arrays.filter(judge), selected, []).withColumn("direction", F.lit(name))
        told = t if told is None else told.unionByName(t)
    return told.select("direction", "program", "n", "ok", F.round(F.col("ok") / F.col("n"), 6).alias("rate"))


QUERIES = {"program_space": program_space, "rule_eligibility": rule_eligibility, "random_null": random_null, "search_fit": search_fit}
ORACLES = {"program_space": PROGRAM_SPACE_SQL, "rule_eligibility": RULE_ELIGIBILITY_SQL, "random_null": RANDOM_NULL_SQL}
