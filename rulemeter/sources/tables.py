"""Sources and sinks: JSON lines under explicit schemas, wrapped JSON files, CSV options, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = """id string, corpus string, authority string, claim string, stem string, choices map<string,string>, key string, responseType string,
figure struct<kind:string,transcription:string>, clusterId string, percentCorrect double, sourceUrl string, licenseNote string, contentDomain string, grade string, year string,
figureDependent boolean, transcriptionMethod string, pagePointer string, officialTag string, role string, stemRestored boolean, restorationNote string, split string"""
CLAIM = "authority string, code string, text string, operationalization string, operations array<string>, sourceUrl string"
RULE = "id string, channel string, description string, citation string, lacks array<string>, appliesTo array<string>"
TRIAL = "trialId string, itemId string, programId string, channel string, answer string, correct boolean, skipped boolean, skipReason string, trace array<string>, timestamp string"
SCHEMAS = {"item": ITEM, "claim": CLAIM, "rule": RULE, "trial": TRIAL}
#: Columns that no row may leave empty, and the key that no two rows share.
REQUIRED = {"item": ["id", "corpus", "authority", "claim", "stem", "key", "responseType", "sourceUrl", "licenseNote"], "claim": ["authority", "code"], "rule": ["id", "citation"], "trial": ["itemId", "programId"]}
KEYS = {"item": ["id"], "claim": ["authority", "code"], "rule": ["id"], "trial": ["itemId", "programId"]}
CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a kind; a line that is no JSON object has its text in ``_corrupt`` and nulls beside it."""
    schema = T.StructType.fromDDL(SCHEMAS[kind]).add(CORRUPT, T.StringType())
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_items(spark: SparkSession, path: str, pool: bool = False) -> DataFrame:
    """Whole items, without those of the retrieval pool unless asked for; corrupt lines are left to quarantine()."""
    rows = read_lines(spark, path, "item").filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return rows if pool else rows.filter(~F.col("role").eqNullSafe("retrieval-pool"))


def quarantine(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(line): the corrupt lines of a file."""
    schema = T.StructType.fromDDL(SCHEMAS[kind]).add(CORRUPT, T.StringType())
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).filter(F.trim("value") != "").select("value", parsed[CORRUPT].alias("bad")).filter("bad is not null").select(F.col("value").alias("line"))


def read_wrapped(spark: SparkSession, path: str, kind: str, field: str) -> DataFrame:
    """A file that holds an array of rows, or an object with the array in ``field``."""
    row = T.StructType.fromDDL(SCHEMAS[kind])
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    bare = F.from_json("v", T.ArrayType(row))
    held = F.from_json("v", T.StructType([T.StructField(field, T.ArrayType(row))]))[field]
    return whole.select(F.explode(F.when(F.startswith("v", F.lit("[")), bare).otherwise(held)).alias("r")).select("r.*")


def read_json_or_lines(spark: SparkSession, path: str, kind: str, field: str) -> DataFrame:
    """Chosen by the suffix: lines for .jsonl, else an array, wrapped or not."""
    return read_lines(spark, path, kind).drop(CORRUPT) if path.endswith(".jsonl") else read_wrapped(spark, path, kind, field)


def read_csv_options(spark: SparkSession, path: str, key: str, options: list[str], letters: str = "ABCDEFGH") -> DataFrame:
    """A CSV whose columns ``options`` are the choices and whose column ``key`` is the number of the right one, from 0."""
    t = spark.read.option("header", True).csv(path)
    names = F.array(*[F.lit(letters[i]) for i in range(len(options))])
    return t.withColumn("choices", F.map_from_arrays(names, F.array(*[F.col(f"`{c}`") for c in options]))).withColumn("key", F.get(names, F.col(f"`{key}`").try_cast("int")))


def violations(rows: DataFrame, kind: str) -> DataFrame:
    """(key, violation): empty required values, selected items with fewer than two choices, rates out of range, repeated keys."""
    told = F.concat_ws("/", *KEYS[kind])
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.concat(F.lit("empty "), F.lit(c))) for c in REQUIRED[kind]]
    if kind == "item":
        size = F.coalesce(F.size("choices"), F.lit(0))
        empty.append(F.when((F.col("responseType") == "selected") & (size < 2), "fewer than two choices"))
        empty.append(F.when(~F.col("responseType").isin("selected", "numeric", "griddable", "matching", "constructed"), "unknown response type"))
        empty.append(F.when((F.col("percentCorrect") < 0) | (F.col("percentCorrect") > 100), "percentCorrect out of range"))
    found = rows.select(told.alias("key"), F.explode(F.array_compact(F.array(*empty))).alias("violation"))
    again = rows.groupBy(*KEYS[kind]).agg(F.count("*").alias("n")).filter("n > 1").select(told.alias("key"), F.lit("repeated key").alias("violation"))
    return found.unionByName(again)


def lettered(items: DataFrame) -> DataFrame:
    """Items with their choices as an array of (letter, text) in letter order, as the scoring rules take them."""
    o = F.transform(F.array_sort(F.map_entries("choices")), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text")))
    return items.withColumn("options", F.coalesce(o, F.array().cast("array<struct<letter:string,text:string>>")))


def split_capped(rows: DataFrame, split: str, order: list[str], caps: dict[str, int]) -> DataFrame:
    """The first rows of each split, as many as its cap; a cap is the feature here."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(split).orderBy(*order)))
    cap = F.coalesce(*[F.when(F.col(split) == k, F.lit(n)) for k, n in caps.items()], F.lit(0))
    return ranked.filter(F.col("_n") <= cap).drop("_n")


def train_and_hold(rows: DataFrame, split: str, order: str, train: int = 1500, hold: int = 400, least: int = 32) -> DataFrame:
    """``rows`` with part: the first ``train`` rows of split train, and as hold the first ``hold`` of test, validation and dev; if
    those are fewer than ``least``, hold is topped up with the first rows of any split but train, which may count twice.

    ``order`` is a column that tells the rows' order. Caps are the feature here; ranks are taken by partial limits."""

    def first(t: DataFrame, n: int, part: str) -> DataFrame:
        return t.orderBy(order).limit(n).withColumn("part", F.lit(part))

    held = first(rows.filter(F.col(split).isin("test", "validation", "dev")), hold, "hold")
    told = first(rows.filter(F.col(split) == "train"), train, "train").unionByName(held)
    n = held.count()  # at most ``hold``
    if n < least:
        told = told.unionByName(first(rows.filter(~F.col(split).eqNullSafe("train")), hold - n, "hold"))
    return told


def append_new(rows: DataFrame, path: str, kind: str = "trial") -> int:
    """Append the rows whose key the log at ``path`` lacks, one for each key, and return how many there were."""
    spark, keys = rows.sparkSession, KEYS[kind]
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
    known = spark.read.schema(rows.schema).parquet(path)
    before = known.count()
    rows.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti").select(*rows.columns).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count() - before


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``base`` whose key it lacks."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_batches(rows: DataFrame, path: str, order: list[str], size: int = 50) -> None:
    """JSON files by batch of ``size`` rows. The numbering orders all rows: it is meant for packets that people read."""
    rows.withColumn("batch", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / size)).write.partitionBy("batch").mode("overwrite").json(path)


def blinded(items: DataFrame, seed: str = "1") -> DataFrame:
    """(id, opaqueId, letterMap, shuffledKey, shuffled): options in an order fixed by a hash, the key moved along."""
    turned = F.array_sort(F.transform("options", lambda o: F.struct(F.sha2(F.concat(F.lit(seed + ":"), F.col("id"), F.lit(":"), o["letter"]), 256).alias("h"), o["letter"].alias("old"), o["text"].alias("text"))))
    t = items.withColumn("_t", turned).withColumn("letterMap", F.map_from_arrays(F.transform("_t", lambda o: o["old"]), F.transform("options", lambda o: o["letter"])))
    return t.select("id", F.substring(F.sha2("id", 256), 1, 12).alias("opaqueId"), "letterMap", F.try_element_at("letterMap", "key").alias("shuffledKey"), F.transform("_t", lambda o, i: F.struct(F.get("options", i)["letter"].alias("letter"), o["text"].alias("text"))).alias("shuffled"))
