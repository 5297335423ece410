"""The queries of this subpackage: each applies an operator to its whole table and digests what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import chat, chosen_path, decontam, fingerprints, hard_negatives, jaccard_join, join_oracles, langid, lm_scoring, mixing, oracles, pii, quantize, secrets, sharding, vector_oracles
from larkspan.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [secrets.of_kind(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_sql(F.col("base")), 256).alias("base_sha256"), secrets.spans_sql(F.col("spans")).alias("spans"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(table(spark, sf_dir, "documents"))
    first = F.round(F.get("passes", F.lit(0))["position"], 9).alias("first_position")
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.size("passes").alias("n_passes"), first).orderBy("first_position", "doc_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes = fingerprints.near_duplicates(docs).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return fingerprints.fingerprint_documents(docs, classes)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_sql(F.col("base")), 256).alias("base_sha256"), secrets.spans_sql(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group_documents(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = chat.format_conversations(turns.unionByName(extra))
    back = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), F.array_join(chat.learned(F.col("formatted"), F.col("loss")), "").alias("learned"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compressed_codes(table(spark, sf_dir, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_compression": op12_vector_compression,
    "op13_minhash_dedup": op13_minhash_dedup,
}
ORACLE_SQL = oracles.ORACLE_SQL | join_oracles.ORACLE_SQL | vector_oracles.ORACLE_SQL
