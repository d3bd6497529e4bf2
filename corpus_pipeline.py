"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
stage's result as Parquet to the shared folder and rereads it as the next one's input, and deletes the one before.

Defined results, for all stages: an empty table gives an empty table; null identifiers, languages and sources are kept as
they are; rows alike in identifier and text share their fate, but for the join, of which one stays; texts of any length
are worked on whole; columns other than the five of documents don't come in. Per stage, see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import bpe, langid, line_dedup, mixing, neardup, queries
from orefield.llm.common import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text that a task encodes at once; executors are as full here as the stages before have made them.
TEXT_AT_ONCE = 8 << 20
#: Batches between Spark and Python, unless the session says otherwise: each worker holds one and what it makes of it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bound_batches(spark: SparkSession) -> None:
    """A stage's result is worked out after it has returned, so this stays set."""
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which replaces the label; those without a letter, and so null and empty texts, go.

    Of languages alike in likelihood the first by alphabet is taken.
    """
    bound_batches(spark)
    found = langid.identify(docs, queries.language_model(docs))
    kept = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later three-line windows repeat; those with nothing left go.

    The first occurrence is that of the least identifier; documents of fewer than three lines stay as they are.
    """
    cut = line_dedup.dedup_lines(docs)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least identifier.

    Blank texts are near nothing and stay; rows alike in all count once.
    """
    bound_batches(spark)
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics; texts without words stay."""
    bound_batches(spark)
    return mixing.mix(docs, queries.MIX_TARGETS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; a null text has none, and counts as empty."""
    bound_batches(spark)
    coded = bpe.encode_documents(docs, queries.BYTE_BPE, decoded="decoded", at_once=TEXT_AT_ONCE)
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The language model, the forest and the token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
