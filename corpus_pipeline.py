"""The corpus pipeline: five stages from raw documents to token-ID files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemeter.llm import decontaminate, mixing, near_copies, simhash, token_ids, toxicity
from rulemeter.llm.common import fresh_path, materialize, table
from rulemeter.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; the score is fitted on the labels, by the operator's folds."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of SimHash or of near copies make.

    SimHash with three differing bits, op5's operator, is the stage's method. Texts whose five-word shingles have a Jaccard
    similarity of 0.8 mostly differ in more bits, and an exact check adds their links."""
    links = simhash.near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    return near_copies.keep_first(docs, materialize(links))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats written out; documents of which it takes none go."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files in the shared folder, and what they say of each document."""
    return token_ids.token_ids(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can express neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
