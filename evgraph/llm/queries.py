"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm.bpe import encode_digests
from evgraph.llm.exact_dedup import exact_dedup
from evgraph.llm.language import identify
from evgraph.llm.line_dedup import dedup_lines
from evgraph.llm.packing import pack_documents
from evgraph.llm.quality_rules import score_documents
from evgraph.llm.repetition import repetition_rules
from evgraph.llm.secrets import scan_digests
from evgraph.llm.simhash import near_groups
from evgraph.llm.spelling import spelling_variants
from evgraph.llm.token_files import read_files, token_files
from evgraph.llm.url_filter import judge_urls
from evgraph.llm.whitening import whitened_rows
from evgraph.session import importable_by_workers, shared_dir


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digests(_docs(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_docs(spark, sf_dir)).drop("worst_share")


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), _docs(spark, sf_dir))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"), removed_col="removed_lines").select("doc_id", "removed_lines", "text")


def op8_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_docs(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-files")
    ranks = token_files(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), out, end_id=2)
    return read_files(spark, out, ranks)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir))


#: Fixed values of the contract: verdict, host, path.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_simhash": op1_simhash,
        "op2_secret_scan": op2_secret_scan,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_repetition_rules": op4_repetition_rules,
        "op5_language_fusion": op5_language_fusion,
        "op6_rule_ensemble": op6_rule_ensemble,
        "op7_line_dedup": op7_line_dedup,
        "op8_rank_bpe": op8_rank_bpe,
        "op9_exact_dedup": op9_exact_dedup,
        "pipeline": pipeline,
        "op10_token_files": op10_token_files,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_url_filter": op12_url_filter,
        "op13_embedding_whitening": op13_embedding_whitening,
    }

    def ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable_by_workers(spark)
            return f(spark, sf_dir)

        return run

    return {name: ready(f) for name, f in found.items()}
