"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import compression_quality, license_digest, line_rules, line_templates, mixing, oracles, phrase_index, secret_scan, simhash, token_files, warc
from tessera.llm.workers import spread
from tessera.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    known = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = compression_quality.fit(docs, known)
    found = compression_quality.score(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.assess(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(f"rules.{c}" for c in names), "rules.n_bad_lines", "rules.n_lost_words")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(spread(table(spark, sf_dir, "documents")), license_digest.license_texts(spark))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.dropped_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"), F.array_join("repeated", ",").alias("repeated"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_compression_quality, op2_source_mixing, op3_quality_rules, op4_license_scan, op5_token_files, op6_warc, op7_benchmark_decontamination, op8_line_dedup, op9_secret_scan, op10_simhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
