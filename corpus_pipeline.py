"""From raw documents to packed token rows: five stages, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tableload.llm.common import staged
from tableload.llm.decontaminate import drop_contaminated
from tableload.llm.mixing import mixed_documents
from tableload.llm.ngram_join import one_of_each
from tableload.llm.packing import pack_documents
from tableload.llm.quality import keep_good
from tableload.llm.queries import RANKS, quality_model


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels, does not reject."""
    return keep_good(docs, quality_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more."""
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    return mixed_documents(docs)


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids that hold every document taken."""
    return pack_documents(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("token_id_output", pack_rows),
]

# Compression, signatures and tokens have no SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Every stage's rows are written as Parquet in the shared
    folder and read again, so a lost executor repeats no earlier stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
