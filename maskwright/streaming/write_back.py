"""Write-back of masked texts exactly once, and counts of masked values by event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.plans.sanitize import Rules, with_spans
from maskwright.streaming.watch import POLL_INTERVAL


# ------------------------------------------------------------------ write-back
def start_write_back(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write every micro-batch under its number, and then its number into a ledger.

    A batch that fails halfway has no ledger entry, so nobody reads what it left; the engine runs it again under the same number and it
    replaces that. A batch that was written but not yet noted by the checkpoint is run again, too, and replaces itself. So readers
    of ``written`` see every batch once, whole.
    """
    def write(batch: DataFrame, number: int) -> None:
        _write_batch(batch, path, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL_INTERVAL)).start()


def _write_batch(batch: DataFrame, path: str, number: int) -> None:
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
    spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")


def written(spark: SparkSession, path: str) -> DataFrame:
    """All rows of batches that are in the ledger, with the number of their batch."""
    ledger = spark.read.parquet(f"{path}/ledger").select("batch")
    return spark.read.option("mergeSchema", "false").parquet(f"{path}/data").join(F.broadcast(ledger.distinct()), "batch", "left_semi")


def current_texts(spark: SparkSession, path: str, keys: Sequence[str], seq: str) -> DataFrame:
    """The last text written for each key: what a keyed table holds after all batches were put into it in order."""
    last = Window.partitionBy(*keys).orderBy(F.desc(seq), F.desc("batch"))
    return written(spark, path).withColumn("_mw_turn", F.row_number().over(last)).where("_mw_turn = 1").drop("_mw_turn", "batch")


# ------------------------------------------------------------------ event time
def masked_by_window(df: DataFrame, time_col: str, text_col: str, rules: Rules = None, width: str = "1 day", slide: str | None = None,
                     delay: str | None = None, by: Sequence[str] = (), gap: str | None = None) -> DataFrame:
    """Masked values by label in windows of event time: (window_start, window_end, by..., category, label, n).

    For a stream give ``delay``: windows close when the latest event is that much past their end. Rows that come later than in the micro-batch
    after that are dropped, and counted by ``late_rows``. ``gap`` makes session windows instead, which last until nothing happened for that long. Texts are
    reduced to labels before the shuffle. Rows without a time are in no window.
    """
    rows = df.withWatermark(time_col, delay) if delay else df
    spans = with_spans(rows, text_col, rules, into="_mw_spans")
    found = spans.select(F.col(time_col).alias("_mw_time"), *by, F.explode("_mw_spans").alias("s")).where(F.col("_mw_time").isNotNull())
    place: Column = F.session_window("_mw_time", gap) if gap else F.window("_mw_time", width, slide)
    counts = found.groupBy(place.alias("w"), *by, F.col("s.category").alias("category"), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "category", "label", "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, over all micro-batches still in the query's progress."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
