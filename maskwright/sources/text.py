"""Reading texts and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole UTF-8 files as rows: (path, text). Each file is one text, so rules may span its lines."""
    return (spark.read.text(paths, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


ROWS_PER_TASK = 100_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK, by: str | None = None) -> DataFrame:
    """Use all cores, and tasks of some seconds, when a scan yields fewer partitions than that (few files, or compact rows) or uneven ones.

    Matching is bound by CPU, so moving the compact rows pays off; an input that has enough even partitions is left as it is. Only partitions
    that hold rows count: a Parquet file is split by bytes, but a row group's rows all go to one split, and the others are empty.
    The rows are counted by partition, which for Parquet reads only the footers of its files. With ``by`` rows always move, those of one key to
    one task, so that later joins and groups by that key need not move them again.
    """
    sizes = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // rows_per_task))
    uneven = max(sizes, default=0) * wanted > 2 * sum(sizes)
    if by:
        return df.repartition(wanted, by)
    return df.repartition(wanted) if len(sizes) < wanted or uneven else df


def require_text(df: DataFrame, text_col: str) -> DataFrame:
    """Fail before any job runs when there is no text to read."""
    if text_col not in df.columns:
        raise ValueError(f"No input provided: column {text_col!r} not found among {', '.join(df.columns)}")
    return df


def write_clean(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Masked texts, one row per input row; spans and originals are not written."""
    df.select(*keys, "clean_text").write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Reports go to their own place, apart from the data."""
    df.select(*keys, "report.*").write.mode(mode).parquet(path)
