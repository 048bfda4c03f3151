"""A corpus from raw documents to packed sequences: five stages, each on all that the one before it kept.

Quality rules drop bad documents and boilerplate lines; the n-gram Jaccard join keeps one document of each group of near
copies; suffix-array dedup cuts out repeated passages; decontamination cuts out benchmark passages; packing lays out token
sequences. Each stage's output is written as Parquet and read again as the next one's documents.

Defined results: documents with null, empty or short texts fail the quality rules and go; of exact copies and rows of equal ids
and texts one row stays; extra columns pass by up to packing; a missing or empty benchmark item matches nothing; an empty table
gives no rows. A text of any length is one block of each kernel, so a single very long one needs a worker of that size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galleria.llm import decontaminate, ngram_join, packing, quality_rules, suffix_dedup
from galleria.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(docs, suffix_dedup.PASSAGES)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenisation, suffix arrays and components have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; the rows of the last."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
