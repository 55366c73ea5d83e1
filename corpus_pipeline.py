"""From raw documents to packed sequences: five stages, each one operator of maskwright.llm.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one returns the pieces of
the packed sequences. ``run`` writes each stage's result as Parquet into the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.llm import exact_dedup, language_id, mixing, ngram_join, packing
from maskwright.llm.common import release_sent, staged
from maskwright.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go: no language can be told."""
    release_sent()
    trees = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return language_id.keep_identified(docs, trees)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    release_sent()
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similar word shingles the one with the smallest id stays."""
    release_sent()
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document comes as often as it is taken."""
    release_sent()
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, every window mixed like the whole; the pieces carry their token ids."""
    release_sent()
    return packing.pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack),
]

#: The sample and the packing order are hashed and the trees trained, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
