"""Exact duplicates by two passes over a Bloom filter.

The first pass marks, in a bit table of fixed size, the positions that two or more rows hit. The second pass tests every
row against it: a row with a position hit only once has no equal, and passes straight through. Only the other rows meet
their equals in a shuffle, by SHA-256 of the text. The table decides who shuffles, never the result: where it fills up,
more rows shuffle.

Defined results: a null text counts as empty; empty texts are equal to each other. Rows with equal texts form a group,
``group_size`` counts its rows, and its largest id stays; a null id stays only where the whole group has null ids. Rows
that repeat the same id and text are one document: all of them are marked as kept by ``duplicate_report``, and
``drop_duplicates`` returns one of them. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskwright.llm import bloom
from maskwright.llm.common import free_name, staged, text_or_empty


def _winners(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """One row per text that occurs more than once. Partial sums come first, so a text with very many copies is cheap."""
    return staged(rows.groupBy(digest).agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
                  "exact-dedup-groups")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = bloom.LOG2_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    rows = staged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                              F.xxhash64(text).alias("h")), "exact-dedup-hashes")
    table = bloom.table_of(rows.select("h"), True, log2_bits)
    rows = rows.withColumn("maybe", bloom.maybe(docs.sparkSession, F.col("h"), table, log2_bits))
    found = rows.where("maybe")
    found = found.join(_winners(found.select("sha", "doc_id"), "sha", "doc_id"), "sha", "left")
    alone = rows.where("not maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    out = alone.select("doc_id", "sha", "keep_id", "group_size").unionByName(
        found.select("doc_id", "sha", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                     F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")))
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = bloom.LOG2_BITS) -> DataFrame:
    """The documents that stay, with all their columns. Whole rows shuffle only where the text may be repeated."""
    text = text_or_empty(text_col)
    table = bloom.table_of(docs.select(F.xxhash64(text).alias("h")), True, log2_bits)
    maybe, digest = free_name(docs, "_maybe"), free_name(docs, "_digest")
    flagged = docs.withColumn(maybe, bloom.maybe(docs.sparkSession, F.xxhash64(text), table, log2_bits))
    alone = flagged.where(~F.col(maybe)).drop(maybe)
    found = flagged.where(maybe).drop(maybe).withColumn(digest, F.sha2(text, 256))
    groups = _winners(found.select(F.col(digest).alias("sha"), F.col(f"`{id_col}`").alias("id")), "sha", "id").alias("g")
    found = found.alias("d")
    mine = F.col(f"d.`{id_col}`")
    copies = found.join(groups, F.col(f"d.{digest}") == F.col("g.sha"), "left").where(
        F.col("g.sha").isNull() | mine.eqNullSafe(F.col("g.keep_id"))).select("d.*")
    return alone.unionByName(copies.dropDuplicates([digest, id_col]).drop(digest))
