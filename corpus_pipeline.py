"""The corpus pipeline: what is fit to train on, of the table documents.

Each stage takes (spark, docs, sf_dir) and gets the rows that the stage before kept, written as
Parquet and read again. All but the last return the columns of documents.

A null or empty text fails the quality rules. Repeated rows, and copies, leave the one of the least
doc_id; of rows that repeat that id all stay. Texts are worked on whole, however long. Extra columns
pass through all stages, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm import bpe, decontaminate, minhash, rules, secrets
from folia.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or are outliers of their language and source go."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id stays."""
    return minhash.deduplicated(docs, size=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, in the text and so in n_chars; no row goes."""
    return secrets.cleaned(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.tokenized(docs, *bpe.public_ranks())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("tokenization", tokenization),
]

#: SQL can express neither the outlier estimates nor the merges; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
