"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's ``docs``. Null and empty texts fail the quality
rules, so later stages see texts with words; every stage keeps the columns of
``documents``, extra ones included, but for the last, which returns doc_id,
start, n_tokens and ids_crc32 as read back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_rules, mixing, phrase_index, simhash, token_files
from tessera.plans.session import table
from tessera.plans.storage import concluded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from a text, documents that lose too much go whole."""
    return line_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of a benchmark item go."""
    return phrase_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back."""
    return token_files.read_files(token_files.write_files(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID files", token_ids),
]

#: SQL can express neither XXH64 fingerprints nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; a stage's result is deleted once the next one's is written."""

    def result(k: int) -> DataFrame:
        if k < 0:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[k]
        return concluded(spark, "stage-" + name.split()[0].lower(), lambda: stage(spark, result(k - 1), sf_dir))

    return result(len(STAGES) - 1)
