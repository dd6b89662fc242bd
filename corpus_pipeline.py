"""Documents to packed sequences: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all rows that the one before has kept and is written before the next reads it. A null
or empty text fails the quality rules, so later stages see none unless they are run by themselves: it is
then a copy of other empty texts, holds no benchmark window and no secret, and packs as its end id alone.
A null doc_id stays null; rows that repeat stay in the stages that judge texts and are copies in the second.
Very long texts go whole through every stage. An empty table stays empty. Columns with any other name are
carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echograph.llm import decontam, packing, quality, secret_scan, simhash
from echograph.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; common lines of a host go from those that stay."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the five-word shingles) stays: the least doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by the name of their kind."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, cached_units=200_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: SimHash, trigram search and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
