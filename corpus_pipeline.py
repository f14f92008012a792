"""From raw documents to packed training sequences: five stages, each a written table for the next.

Each stage takes (spark, docs, sf_dir). All but the last return rows of docs with the columns of docs:
documents that the quality classifier or the quality rules reject go, of each group of near-duplicates
one document stays, and documents that hold a benchmark passage go. The last stage packs what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportlens.llm import decontaminate, neardup, packing, quality_rules, resampling
from reportlens.llm.tokens import tokenizer_path
from reportlens.session import shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resampling.keep_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def adaptive_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", adaptive_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", best_fit),
]

# Tokenizers, MinHash signatures and packing have no SQL; a brute-force version tests the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir/documents.parquet; every stage is written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
