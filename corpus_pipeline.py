"""From raw documents to a mixed training order, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.llm import pfair, randomness, seeds, simhash, toxicity
from statewise.llm.common import numbered, table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine accepts."""
    return toxicity.accepted(docs, toxicity.machine(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles, 0.8 similar or more."""
    return simhash.first_of_groups(docs, shingle=5, similarity=0.8)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return seeds.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced; n_chars follows the text."""
    safe = randomness.redact(docs)
    return safe.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot in the mixture of sources."""
    return pfair.exactly_mixed(docs, pfair.tempered(docs))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("secrets", without_secrets),
    ("mixing", in_mixed_order),
]

ORACLE_SQL = None  # learned scores and fingerprints have no SQL form; tests hold each stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
