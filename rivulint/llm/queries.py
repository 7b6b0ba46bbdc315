"""The registered queries of the operators: each over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.llm import (contamination, conversation_repair, divergence_rules, feast_whitening,
                          itq_neighbours, language_centroids, line_templates, packing, sharding,
                          simhash_groups, sql, token_records, toxicity_cnn, url_rules)

VOCABULARY, END_ID = "word_bpe_49k.json", 2
SHARDS = 24
URL_RULES = [
    url_rules.Rule("block", "net", "/"),
    url_rules.Rule("allow", "example.net", "/en/"),
    url_rules.Rule("block", "example.com", "/de/"),
    url_rules.Rule("allow", "org", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.encoded_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path(VOCABULARY), END_ID,
    ).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "matched", "size", "containment")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text) + sharding.OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_neighbours.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_centroids.identified(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        public_tokenizers.path(VOCABULARY), END_ID, 4096)


def op11_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judged(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", *divergence_rules.BASE_COUNTS, "base_failed", "kept")


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Beyond a long the exact deviation is null; the operator itself has 38 digits.
    return feast_whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation as long)"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversations, conversation_repair.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_templates, op2_token_records, op3_contamination, op4_simhash_groups,
        op6_shuffled_shards, op7_near_vectors, op5_toxicity, op8_url_verdicts, op9_language, op10_curve_packing,
        op11_divergence_rules, op12_feast_whitening, op13_conversation_repair)
}
ORACLES: dict[str, str] = {
    "op1_line_templates": sql.OP1, "op3_contamination": sql.OP3, "op8_url_verdicts": sql.OP8,
    "op11_divergence_rules": sql.OP11, "op13_conversation_repair": sql.OP13}
