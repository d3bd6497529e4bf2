"""The queries of the training-data operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import bpe, centroids, html_text, langid, line_dedup, media, mixing, neardup, quality, secrets, sketch_dedup, spelling, sstable

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_digest(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, BYTE_BPE, decoded="decoded", drop_text=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.judge(docs).drop("text", "lang")
    return found.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)
    return found.select("doc_id", "ordinal", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op4_sstable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sstable.read_shards(sstable.write_shards(docs, WORD_BPE, end_id=1))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(~langid.held_out(F.col("doc_id"))))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.drop("lang"), language_model(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.map_entries("lang_shares").alias("lang_shares"))


#: Powers that flatten the present shares of each margin.
MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, MIX_TARGETS, keep_text=False).select("doc_id", "source", "lang", "mix_probability", "mix_weight")


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "class_id", "exact_id", "n_links", "copies")


def op8_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.digest(media.describe(media.stored(docs)))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op10_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


def op12_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sketch_dedup.near_duplicates(docs)


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", id_digest("centroid").alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_codec": op1_bpe_codec,
        "op2_divergence_rules": op2_divergence_rules,
        "op3_secret_forest": op3_secret_forest,
        "op4_sstable_ids": op4_sstable_ids,
        "op5_language_mixture": op5_language_mixture,
        "op6_raked_mixture": op6_raked_mixture,
        "op7_minhash_forest": op7_minhash_forest,
        "op8_media_archive": op8_media_archive,
        "op9_line_windows": op9_line_windows,
        "op10_page_difference": op10_page_difference,
        "op11_errata_trie": op11_errata_trie,
        "op12_fast_sketch": op12_fast_sketch,
        "op13_delta_lloyd": op13_delta_lloyd,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_divergence_rules": quality.ORACLE, "op7_minhash_forest": neardup.ORACLE, "op9_line_windows": line_dedup.ORACLE, "op11_errata_trie": spelling.ORACLE, "op12_fast_sketch": sketch_dedup.ORACLE, "op13_delta_lloyd": centroids.oracle()}
