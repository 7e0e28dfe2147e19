"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. The first four return the columns of documents
with their decisions in effect: rejected and repeated documents are gone, repeated runs of lines and secrets are cut from the
texts (and n_chars follows). The last one returns the packing.

Nulls, empty and repeated rows: as each operator's docstring says. Documents whose text becomes empty stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.llm.common import with_length
from evgraph.llm.line_dedup import dedup_lines
from evgraph.llm.packing import pack_documents
from evgraph.llm.quality_rules import keep_good
from evgraph.llm.queries import tokenizer_file
from evgraph.llm.secrets import redact
from evgraph.llm.simhash import keep_one
from evgraph.session import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut from the texts."""
    return with_length(dedup_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return with_length(redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of token sequences."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer and the hashes cannot be written in SQL; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
