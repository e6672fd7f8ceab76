"""Registry of this subpackage's queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.llm import ann, bin_packing, chat_template, divergence, hard_negatives, license_scan, line_dedup, mixing, packing, ppm, quality_rules, sharding, simhash
from wickflow.llm.common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("lines").cast("long").alias("n_lines"),
        F.col("kept_lines").cast("long").alias("n_kept"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "unit", "place", F.round("dice", 6).alias("dice"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "cast(turn as long) turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{said}' text")
    return chat_template.digests(chat_template.format_turns(turns.unionByName(extra)))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bin_packing.pack_whole(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 100 = 0")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_simhash,
            op2_sharding,
            op3_line_dedup,
            op4_license_scan,
            op5_mixing,
            op6_quality_rules,
            op7_ppm,
            op8_ann,
            op9_packing,
            op10_chat_template,
            op11_best_fit,
            op12_source_divergence,
            op13_hard_negatives,
        )
    }


#: The default template's fixed characters around a turn, and its escapes, in SQL.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '(\\|\[/?(?:INST|SYS|ROLE)\]|</?s>)', '#\1', 'g')) AS n,
         length(regexp_replace(role, '(\\|\[/?(?:INST|SYS|ROLE)\]|</?s>)', '#\1', 'g')) AS m
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 13 ELSE 18 + m END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def oracle_sql() -> dict:
    return {
        "op10_chat_template": CHAT_SQL,
        "op12_source_divergence": divergence.oracle_sql(),
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
        "op3_line_dedup": line_dedup.oracle_sql(),
        "op4_license_scan": f"SELECT doc_id, license, unit, place, round(dice, 6) AS dice FROM ({license_scan.oracle_sql()})",
        "op5_mixing": mixing.oracle_sql(),
    }
