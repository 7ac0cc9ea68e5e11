"""Relational and statistical queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import text as T
from ..operators import relational as R
from ..operators import stats as S
from .exam import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


@query(f"""WITH l AS (SELECT lang, doc_id, toxic FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL),
v AS (SELECT lang, list(toxic ORDER BY doc_id) AS vs, count(*) AS n FROM l GROUP BY lang),
b AS (SELECT lang, vs, n, unnest(range(0, 200)) AS b FROM v), i AS (SELECT lang, vs, n, b, unnest(range(0, n)) AS i FROM b),
d AS (SELECT lang, n, b, vs[(floor({rng.sql('1', '(b * n + i + 1)')} * n) + 1)::INT] AS x FROM i),
m AS (SELECT lang, b, sum(x)::DOUBLE / n AS m FROM d GROUP BY lang, n, b), s AS (SELECT lang, list_sort(list(m)) AS ms FROM m GROUP BY lang)
SELECT lang, n, round(list_sum(vs)::DOUBLE / n, 6) AS rate, round(ms[6], 6) AS lo, round(ms[196], 6) AS hi FROM v JOIN s USING (lang)""")
def bootstrap_ci_mulberry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic-label rate by language with a 95% percentile bootstrap of 200 replicates."""
    rows = read(spark, sf_dir, "labels").filter("toxic is not null").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    t = S.bootstrap_ci(rows, ["lang"], "toxic", ["doc_id"])
    return t.select("lang", "n", _r("rate").alias("rate"), _r("lo").alias("lo"), _r("hi").alias("hi"))


@query(f"""WITH c AS (SELECT event_type, date_trunc('day', ts) AS day, sum(round(value * 100)::BIGINT)::BIGINT AS s, count(*) AS n FROM events GROUP BY ALL),
v AS (SELECT event_type, list(s ORDER BY day) AS ss, list(n ORDER BY day) AS ns, count(*) AS k FROM c GROUP BY event_type),
i AS (SELECT event_type, ss, ns, k, b, unnest(range(0, k)) AS i FROM (SELECT *, unnest(range(0, 100)) AS b FROM v)),
d AS (SELECT event_type, b, (floor({rng.sql('7', '(b * k + i + 1)')} * k) + 1)::INT AS pos, ss, ns FROM i),
m AS (SELECT event_type, b, sum(ss[pos])::DOUBLE / sum(ns[pos]) / 100 AS m FROM d GROUP BY ALL), s AS (SELECT event_type, list_sort(list(m)) AS ms FROM m GROUP BY event_type)
SELECT event_type, k AS clusters, round(list_sum(ss)::DOUBLE / list_sum(ns) / 100, 6) AS rate, round(ms[3], 6) AS lo, round(ms[98], 6) AS hi FROM v JOIN s USING (event_type)""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value with a bootstrap over days: clusters are summed first, then drawn."""
    day = read(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"), F.count("*").alias("n"))
    v = day.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", "s", "n"))).alias("c")).withColumn("k", F.size("c").cast("long"))
    b = v.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    x = F.get("c", F.floor(rng.mulberry32(F.lit(7), F.col("b") * F.col("k") + F.col("i") + 1) * F.col("k")).cast("int"))
    m = b.groupBy("event_type", "b").agg((F.sum(x["s"]).cast("double") / F.sum(x["n"]) / 100).alias("m")).groupBy("event_type").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    total = lambda f: F.aggregate("c", F.lit(0).cast("long"), lambda a, y: a + y[f])
    return v.join(m, "event_type").select("event_type", F.col("k").alias("clusters"), _r(total("s").cast("double") / total("n") / 100).alias("rate"), _r(F.get("ms", F.lit(2))).alias("lo"), _r(F.get("ms", F.lit(97))).alias("hi"))


@query("""WITH k AS (SELECT o_orderpriority || '/' || year(o_orderdate) AS test, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS k FROM orders GROUP BY o_orderpriority, year(o_orderdate)),
t AS (SELECT test, least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE)))) AS p FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM k) GROUP BY test),
r AS (SELECT test, round(p, 9) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY round(p, 9), test) - 1 AS rank FROM t)
SELECT test, p, m, rank, max((p > 0.05 / (m - rank))::INT) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING) = 0 AS holm, p <= 0.05 / m AS bonferroni FROM r""")
def holm_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down and plain correction over a family of tests: is a priority's share of open orders in a year over one half?"""
    t = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("k")).withColumn("half", F.lit(0.5))
    t = S.binomial_sf(t, "k", "n", "half").select(F.concat("o_orderpriority", F.lit("/"), F.col("y").cast("string")).alias("test"), _r("tail", 9).alias("p"))
    return S.holm(t, "p", ties=["test"]).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), n AS (SELECT sum(c)::BIGINT AS n, sum(CASE WHEN a = b THEN c ELSE 0 END)::DOUBLE / sum(c) AS o FROM c),
e AS (SELECT coalesce(sum(x.s::DOUBLE * y.s), 0) AS s FROM (SELECT a AS k, sum(c) AS s FROM c GROUP BY a) x JOIN (SELECT b AS k, sum(c) AS s FROM c GROUP BY b) y USING (k))
SELECT n, round(o, 6) AS observed, round(s / (n::DOUBLE * n), 6) AS expected, round((o - s / (n::DOUBLE * n)) / (1 - s / (n::DOUBLE * n)), 6) AS kappa FROM n, e""")
def kappa_quality_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.kappa(read(spark, sf_dir, "labels"), "quality", "toxic")
    return t.select("n", _r("observed").alias("observed"), _r("expected").alias("expected"), _r("kappa").alias("kappa"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic <> 1) AS n10, count(*) FILTER (quality <> 1 AND toxic = 1) AS n01, count(*) FILTER (quality <> 1 AND toxic <> 1) AS n00 FROM labels)
SELECT *, round((n10 - n01)::DOUBLE * (n10 - n01) / nullif(n10 + n01, 0), 6) AS chi2 FROM c""")
def mcnemar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.mcnemar(read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return t.withColumn("chi2", _r("chi2"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE AS ra, n,
rank() OVER (PARTITION BY c_nationkey ORDER BY n) + (count(*) OVER (PARTITION BY c_nationkey, n) - 1) / 2.0::DOUBLE AS rb,
least(4, floor(4 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1)::DOUBLE / count(*) OVER (PARTITION BY c_nationkey)) + 1)::INT AS q
FROM (SELECT c_custkey, c_nationkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL))
SELECT c_nationkey, count(*) AS n, count(*) FILTER (q = 1) AS q1, count(*) FILTER (q = 4) AS q4, round(CASE WHEN count(*) >= 3 THEN corr(ra, rb) END, 6) AS spearman FROM r GROUP BY c_nationkey""")
def rank_quartiles_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance against number of orders, by nation: quartile sizes and the correlation of average ranks."""
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_nationkey", "c_acctbal", F.coalesce("n", F.lit(0)).alias("orders"))
    by = ["c_nationkey"]
    x, y = S.value_ranks(c, by, "c_acctbal"), S.value_ranks(c, by, "orders")
    # how many of a value's places lie in the first and in the last quarter of the ranks
    within = lambda lo, hi: F.sum(F.greatest(F.lit(0), F.least(F.col("before") + F.col("c"), hi) - F.greatest("before", lo)))
    first, last = F.ceil(F.col("n") / 4), F.ceil(3 * F.col("n") / 4)
    sizes = x.groupBy("c_nationkey").agg(F.max("n").alias("n"), within(F.lit(0), first).alias("q1"), within(last, F.col("n")).alias("q4"))
    r = c.join(x.select("c_nationkey", "c_acctbal", F.col("rank").alias("ra")), ["c_nationkey", "c_acctbal"]).join(y.select("c_nationkey", "orders", F.col("rank").alias("rb")), ["c_nationkey", "orders"])
    told = r.groupBy("c_nationkey").agg(_r(F.when(F.count("*") >= 3, F.corr("ra", "rb"))).alias("spearman"))
    return sizes.join(told, "c_nationkey").select("c_nationkey", "n", "q1", "q4", "spearman")


@query("""WITH o AS (SELECT l_orderkey AS id, l_linenumber AS k, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v, k) AS r, count(*) OVER (PARTITION BY id) AS m, avg(v) OVER (PARTITION BY id) AS a FROM o)
SELECT id, min(CASE WHEN r = (m - 1) // 2 + 1 THEN k END) AS lower_central, min(CASE WHEN r = m // 2 + 1 THEN k END) AS upper_central, min(CASE WHEN r = 1 THEN k END) AS smallest, min(CASE WHEN r = m THEN k END) AS largest FROM s WHERE m >= 3 GROUP BY id""")
def numeric_order_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of an order's line prices: one sorted array for each order, of at most as many as it has lines."""
    o = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k")).agg(F.min("l_extendedprice").alias("v"))
    g = o.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("v", "k"))).alias("s")).filter(F.size("s") >= 3)
    at = lambda i: F.get("s", F.floor(i).cast("int"))["k"]
    m = F.size("s")
    return g.select("id", at((m - 1) / 2).alias("lower_central"), at(m / 2).alias("upper_central"), at(F.lit(0)).alias("smallest"), at(m - 1).alias("largest"))


@query("""SELECT o_custkey, max(n) AS best, CASE WHEN count(*) FILTER (n = m) = 1 THEN max(CASE WHEN n = m THEN o_orderpriority END) END AS answer
FROM (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS m FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) GROUP BY o_custkey""")
def unique_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's most frequent priority, or null on a tie."""
    c = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return R.unique_argmax(c, ["o_custkey"], "o_orderpriority", "n")


@query("""SELECT o_orderstatus, year(o_orderdate)::INT AS y, min(o_orderpriority) FILTER (n = m) AS modal, max(n) AS votes FROM (SELECT *, max(n) OVER (PARTITION BY o_orderstatus, y) AS m FROM (SELECT o_orderstatus, o_orderpriority, o_orderdate, year(o_orderdate) AS y, count(*) OVER (PARTITION BY o_orderstatus, year(o_orderdate), o_orderpriority) AS n FROM orders)) GROUP BY o_orderstatus, year(o_orderdate)""")
def mode_tie_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modal priority, the smallest on a tie."""
    c = read(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.count("*").alias("n"))
    return c.groupBy("o_orderstatus", "y").agg(F.min_by("o_orderpriority", F.struct((-F.col("n")).alias("n"), "o_orderpriority")).alias("modal"), F.max("n").alias("votes"))


@query("""WITH b AS (SELECT CASE WHEN year(o_orderdate) <= 1995 THEN 'to 1995' WHEN year(o_orderdate) <= 1998 THEN '1996-1998' WHEN year(o_orderdate) <= 2000 THEN '1999-2000' ELSE 'after' END AS bucket, min(year(o_orderdate)) AS y, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1)
SELECT bucket, n, rate, coalesce(lag(rate) OVER (ORDER BY y) > rate, true) AS falls FROM b""")
def year_bucket_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate by recency bucket, and whether it falls from the bucket before."""
    o = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    b = o.groupBy(T.year_bucket(F.col("y")).alias("bucket")).agg(F.min("y").alias("y"), F.count("*").alias("n"), _r(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("rate"))
    return b.select("bucket", "n", "rate", F.coalesce(F.lag("rate").over(W.orderBy("y")) > F.col("rate"), F.lit(True)).alias("falls"))


@query("""WITH r AS (SELECT event_type, value, dense_rank() OVER (ORDER BY date_trunc('day', ts)) AS d, (SELECT count(DISTINCT date_trunc('day', ts)) FROM events) AS k FROM events)
SELECT event_type, CASE WHEN d <= greatest(1, k // 2) THEN 'train' ELSE 'late' END AS half, count(*) AS n, round(avg((value > 10)::INT), 6) AS rate FROM r GROUP BY ALL""")
def temporal_split_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First half of the days against the second: days are numbered in their own small table, then joined."""
    e = read(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    halves = R.temporal_halves(e, "day")
    return e.join(halves, "day").groupBy("event_type", "half").agg(F.count("*").alias("n"), _r(F.avg((F.col("value") > 10).cast("int"))).alias("rate"))


@query("""SELECT event_type, count(*) AS pending FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 3 = 0 AND d.user_id = e.user_id AND d.event_type = e.event_type) GROUP BY event_type""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append-only log still lacks: pairs of user and type that no logged event has."""
    e = read(spark, sf_dir, "events")
    return R.pending(e, e.filter("event_id % 3 = 0"), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("pending"))


@query("""SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1""")
def dedup_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, with their first id."""
    return read(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text, the first by source and id, as a combinable minimum: no group is gathered or sorted."""
    return R.keep_first(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), ["text"], ["source", "doc_id"]).select("doc_id", "lang", "source")


@query("""WITH f AS (SELECT c_mktsegment, o_orderkey, o_totalprice, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(lower(o_orderpriority), 'high') OR o_totalprice > 400000)
SELECT o_orderkey, c_mktsegment, o_totalprice, o_orderpriority, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def paged_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 of a filtered list, with the filtered total."""
    f = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).filter(F.lower("o_orderpriority").contains("high") | (F.col("o_totalprice") > 400000))
    f = f.select("o_orderkey", "c_mktsegment", "o_totalprice", "o_orderpriority")
    return R.page(f, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25)


@query("""SELECT 'priority' AS facet, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM orders""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by priority, by status and overall in one pass, by grouping sets."""
    return R.facets(read(spark, sf_dir, "orders"), {"priority": "o_orderpriority", "status": "o_orderstatus"})


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL""")
def semi_join_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    l = read(spark, sf_dir, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL""")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events, cut where six hours pass."""
    return R.sessionize(read(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], 6 * 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, max_by(text, turn) FILTER (role = 'assistant') AS last_text FROM conversations GROUP BY conv_id""")
def transcript_last_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.max(said)["text"].alias("last_text"))


@query("""SELECT page_id, count(h) AS links, count(DISTINCT h) AS distinct_links, min(h) AS first_link, count(h) FILTER (regexp_matches(h, '(?i)en|de')) AS keyword_links FROM (SELECT page_id, unnest(CASE WHEN len(hs) = 0 THEN [NULL] ELSE hs END) AS h FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS hs FROM pages)) GROUP BY page_id""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, those that hold a keyword counted; pages without links keep a row."""
    h = read(spark, sf_dir, "pages").select("page_id", F.explode_outer(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return h.groupBy("page_id").agg(F.count("h").alias("links"), F.count_distinct("h").alias("distinct_links"), F.min("h").alias("first_link"), F.count_if(F.col("h").rlike("(?i)en|de")).alias("keyword_links"))


@query("""SELECT doc_id, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS phone, contains(text, '@') AS mail, regexp_matches(text, '(?i)license') AS license, regexp_matches(text, '([!%#$&*])\\1\\1') AS junk, len(text) > 20000 AS long,
NOT (regexp_matches(text, '[0-9]{3}-[0-9]{4}') OR contains(text, '@') OR regexp_matches(text, '(?i)license') OR len(text) > 20000) AS clean FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""".replace("regexp_matches(text, '([!%#$&*])\\1\\1')", "regexp_matches(text, '!!!|%%%|###|[$][$][$]|&&&|[*][*][*]')"))
def option_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a text, and whether it has none of those that spoil it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    flags = {"phone": t.rlike("[0-9]{3}-[0-9]{4}"), "mail": t.contains("@"), "license": t.rlike("(?i)license"), "junk": t.rlike(r"!!!|%%%|###|[$][$][$]|&&&|[*][*][*]"), "long": F.length(t) > 20000}
    d = read(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])
    return d.withColumn("clean", ~(F.col("phone") | F.col("mail") | F.col("license") | F.col("long")))


@query("""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[$€£]\\s*[0-9][0-9,]*(?:\\.[0-9]+)?', '[Q]', 'g'), '[0-9]+(?:\\.[0-9]+)?\\s*%', '[Q]', 'g'), '[0-9]+\\s*/\\s*[0-9]+', '[Q]', 'g'), '[0-9]{1,2}:[0-9]{2}', '[Q]', 'g'), '-?[0-9]+(?:[.,][0-9]+)*', '[Q]', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS masked_md5, (len(t) - len(replace(t, '[Q]', ''))) // 3 AS masks FROM m""")
def mask_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select("doc_id", T.mask_quantities(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("masked_md5"), F.floor((F.length("t") - F.length(F.replace("t", F.lit("[Q]"), F.lit("")))) / 3).cast("long").alias("masks"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: len(t) >= 6)) AS t FROM documents), b AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: len(t) >= 6)) AS t FROM benchmark),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM w JOIN b USING (t) GROUP BY ALL) SELECT doc_id, arg_min(item_id, (-shared, item_id)) AS item_id, max(shared) AS shared FROM s GROUP BY doc_id""")
def tokenize_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item that shares most long words with a document, the first on a tie."""
    words = lambda t, k: read(spark, sf_dir, t).select(k, F.array_distinct(T.tokens(F.col("text"), 6)).alias("tokens"))
    return R.shared_tokens(words("documents", "doc_id"), "doc_id", words("benchmark", "item_id"), "item_id", best=True).select("doc_id", "item_id", "shared")


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: len(t) >= 2)) AS t FROM benchmark)
SELECT a.item_id, round(1 - avg(len(list_intersect(a.t, b.t))::DOUBLE / greatest(len(list_distinct(list_concat(a.t, b.t))), 1)), 6) AS distinctive FROM t a JOIN t b ON a.item_id <> b.item_id GROUP BY a.item_id""")
def jaccard_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How little an item shares with all others: one less its mean Jaccard similarity, over the pairs that share a word."""
    t = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("tokens"))
    pairs = R.shared_tokens(t, "item_id", t.withColumnRenamed("item_id", "other"), "other").filter("item_id <> other")
    like = pairs.groupBy("item_id").agg(F.sum(F.col("shared") / (F.col("n_row") + F.col("n_item") - F.col("shared"))).alias("s"))
    n = t.agg(F.count("*").alias("n"))
    return t.select("item_id").join(like, "item_id", "left").crossJoin(n).filter("n > 1").select("item_id", _r(1 - F.coalesce("s", F.lit(0.0)) / (F.col("n") - 1)).alias("distinctive"))  # n is one row


@query("""WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: len(t) >= 2)) AS t FROM documents), b AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) >= 2)) AS t FROM benchmark),
dc AS (SELECT doc_id, t, count(*) AS c FROM d GROUP BY ALL), bc AS (SELECT item_id, t, count(*) AS c FROM b GROUP BY ALL), dn AS (SELECT doc_id, sum(c) AS n FROM dc GROUP BY doc_id), bn AS (SELECT item_id, sum(c) AS n FROM bc GROUP BY item_id),
x AS (SELECT doc_id, item_id, sum(least(dc.c, bc.c)) AS i FROM dc JOIN bc USING (t) GROUP BY ALL)
SELECT doc_id, item_id, i::BIGINT AS shared, round(i::DOUBLE / bn.n, 6) AS recall, round(i::DOUBLE / dn.n, 6) AS precision, round(2.0::DOUBLE * i / (bn.n + dn.n), 6) AS f1 FROM x JOIN dn USING (doc_id) JOIN bn USING (item_id)""")
def multiset_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token precision, recall and F1 on multisets, every document that shares a token with an item, every item."""
    words = lambda t, k: read(spark, sf_dir, t).select(k, T.tokens(F.col("text")).alias("tokens"))
    return R.multiset_f1(R.shared_tokens(words("documents", "doc_id"), "doc_id", words("benchmark", "item_id"), "item_id"), "doc_id", "item_id")


@query("""WITH d AS (SELECT DISTINCT doc_id, toxic, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: len(t) >= 3)) AS t FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
c AS (SELECT t, count(*) FILTER (toxic = 1 AND doc_id % 2 = 0) AS k, count(*) FILTER (toxic = 0 AND doc_id % 2 = 0) AS n FROM d GROUP BY t), v AS (SELECT sum(k) AS sk, sum(n) AS sn, count(*) FILTER (k + n > 0) AS v FROM c),
w AS (SELECT t, round(ln((k + 1.0::DOUBLE) / (sk + v)) - ln((n + 1.0::DOUBLE) / (sn + v)), 9) AS w FROM c, v WHERE k + n > 0)
SELECT doc_id, round(sum(w), 4) AS score, sum(w) > 0 AS predicted FROM d JOIN w USING (t) WHERE doc_id % 2 = 1 GROUP BY doc_id""")
def ngram_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word log-ratios with add-one smoothing, counted on even ids and summed over odd ids."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").filter("toxic is not null"), "doc_id").select("doc_id", "toxic", F.explode(F.array_distinct(T.tokens(F.col("text"), 3))).alias("t"))
    return R.log_ratio_scores(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "doc_id", "t", F.col("toxic") == 1)


@query("""SELECT l_orderkey, count(*) AS n, round(sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100, 6) AS mean, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, round(median(l_extendedprice), 3) AS median, count(*) FILTER (l_discount < 0.02) AS near_ties FROM lineitem GROUP BY l_orderkey""")
def margin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "l_extendedprice"
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), _r(F.sum(F.round(F.col(x) * 100).cast("long")).cast("double") / F.count("*") / 100).alias("mean"), _r(F.min(x), 2).alias("low"), _r(F.max(x), 2).alias("high"), _r(F.median(x), 3).alias("median"), F.count_if(F.col("l_discount") < 0.02).alias("near_ties"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH j AS (SELECT c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey), p AS (SELECT unnest({PRIORITIES!r}) AS p UNION SELECT o_orderpriority FROM j)
SELECT s AS c_mktsegment, coalesce(p, 'none') AS priority, count(j.o_orderpriority) AS n FROM (SELECT DISTINCT c_mktsegment AS s FROM j) CROSS JOIN p LEFT JOIN j ON j.c_mktsegment = s AND j.o_orderpriority IS NOT DISTINCT FROM p WHERE p IS NOT NULL GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every pair of segment and priority, zeros where a pair never stands together."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return S.confusion(o, "c_mktsegment", "o_orderpriority", PRIORITIES).withColumnRenamed("o_orderpriority", "priority")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS yes_yes, count(*) FILTER (quality = 0 AND toxic = 0) AS no_no, count(*) FILTER (quality = 1 AND toxic = 0) AS yes_no, count(*) FILTER (quality = 0 AND toxic = 1) AS no_yes FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT *, round((yes_yes + no_no)::DOUBLE / n, 6) AS agreement FROM c""")
def binary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two yes-or-no judgments of the same rows: the four cells and the share on which they agree."""
    t = S.binary_agreement(read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return t.withColumn("agreement", _r("agreement"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer)
SELECT s_suppkey, arg_min(c_custkey, (abs(c_acctbal - s_acctbal), c_custkey)) AS nearest, round(min(abs(c_acctbal - s_acctbal)), 2) AS distance FROM s JOIN c ON s_nationkey = c_nationkey AND abs(c_acctbal - s_acctbal) <= 500 GROUP BY s_suppkey""")
def nearest_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer of a supplier's nation with the nearest balance, at most 500 away."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("x"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("y"))
    t = R.nearest(s, c, ["nation"], "x", "y", 500.0, ["s_suppkey"], "c_custkey")
    return t.select("s_suppkey", F.col("c_custkey").alias("nearest"), _r("distance", 2).alias("distance"))


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM (SELECT c_custkey, upper(c_name) AS c_mktsegment, NULL::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 10 = 0) n FULL JOIN (SELECT * FROM customer WHERE c_custkey % 20 <> 0) o USING (c_custkey)""")
def overlay_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later table's values over an earlier one's, by key, rows of either kept."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    new = c.filter("c_custkey % 10 = 0").select("c_custkey", F.upper("c_name").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return R.overlay(c.filter("c_custkey % 20 <> 0").drop("c_name"), new, ["c_custkey"])


@query("""SELECT * FROM (SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'left', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'right', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)) WHERE n > 0""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of an intersection and both differences from one full join."""
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")).distinct().withColumn("b", F.lit(1))
    part = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "left").otherwise("right")
    return a.join(b, "k", "full").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 5""")
def capped_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most active users of each event type."""
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.first_n(c, ["event_type"], [F.desc("n"), F.col("user_id")], 5)


@query("""SELECT t AS k, p_name, count(*) AS n, levenshtein(p_name, p_brand)::DOUBLE / greatest(len(p_name), 1) AS cer FROM (SELECT p_name, p_brand, p_size % 3 AS t FROM part) GROUP BY t, p_name, p_brand""")
def character_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.groupBy((F.col("p_size") % 3).alias("k"), "p_name", "p_brand").agg(F.count("*").alias("n")).select("k", "p_name", "n", T.character_error_rate(F.col("p_name"), F.col("p_brand")).alias("cer"))


@query("""SELECT user_id, round(avg(v), 6) AS min_k FROM (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= ceil(n * 20 / 100.0) GROUP BY user_id""")
def min_k_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the lowest fifth of a user's values."""
    t = S.lowest_mean(read(spark, sf_dir, "events"), ["user_id"], "value", 0.2)
    return t.select("user_id", _r("mean").alias("min_k"))


@query("""SELECT o_orderpriority, s AS stage, count(*) AS n, round(avg(ok::INT), 6) AS rate FROM (SELECT o_orderpriority, unnest([CASE WHEN o_orderstatus = 'F' THEN 'final' END, CASE WHEN o_totalprice > 250000 THEN 'dear' END, 'any']) AS s, o_custkey % 2 = 0 AS ok FROM orders) WHERE s IS NOT NULL GROUP BY ALL""")
def pooled_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping groups: a row counts in each that it belongs to."""
    labels = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "final"), F.when(F.col("o_totalprice") > 250000, "dear"), F.lit("any")))
    o = read(spark, sf_dir, "orders").select("o_orderpriority", F.explode(labels).alias("stage"), (F.col("o_custkey") % 2 == 0).cast("int").alias("ok"))
    return o.groupBy("o_orderpriority", "stage").agg(F.count("*").alias("n"), _r(F.avg("ok")).alias("rate"))


@query("""WITH t AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, 1 / 3.0::DOUBLE AS p FROM orders GROUP BY o_orderpriority),
i AS (SELECT *, unnest(range(k, n + 1)) AS i FROM t)
SELECT o_orderpriority, k, n, round(p, 6) AS p, round(least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))), 6) AS tail FROM i GROUP BY ALL""")
def binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided binomial tail of each priority's share of final orders against a third."""
    t = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n")).withColumn("p", F.lit(1 / 3))
    return S.binomial_sf(t).select("o_orderpriority", "k", "n", _r("p").alias("p"), _r("tail").alias("tail"))
