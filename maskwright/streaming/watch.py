"""Sanitize on change: per session, mask a text when it differs from the last one.

The original polls one clipboard and remembers the last text. Here every session has its own
memory. After a text is processed the memory is its *masked* form, so masked output coming back is
not processed again; after an unchanged or empty text the memory is that text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from maskwright.functions.expr import free_for, ident, valid_utf8
from maskwright.operators.redact import apply_replacements
from maskwright.plans.sanitize import Rules, with_spans

POLL_INTERVAL = "500 milliseconds"  # fixed value: the polling period


def watched(df: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """Only sessions whose watch mode is on, from a settings table ``(key, watch_mode)``."""
    return df.join(settings.where("watch_mode").select(key), key, "left_semi")


def _masked(df: DataFrame, text_col: str, rules: Rules) -> DataFrame:
    """Add _now (the text as valid UTF-8; a missing one counts as empty), clean_text and total_matches."""
    texts = free_for(df, "clean_text", "total_matches").withColumn(
        "_now", F.coalesce(F.expr(valid_utf8(ident(text_col))), F.lit("")))
    return (with_spans(texts, "_now", rules, into="_spans")
            .withColumn("clean_text", apply_replacements("_now", "_spans"))
            .withColumn("total_matches", F.expr("bigint(size(_spans))")).drop("_spans"))


# ------------------------------------------------------------------ streaming
def watch_stream(df: DataFrame, key: str, seq: str, text_col: str, rules: Rules = None) -> DataFrame:
    """The texts a stream had to mask: (key, seq, text, clean_text, total_matches).

    Masking is a stateless projection on the JVM. All events travel to the stateful step, since each may
    be the memory of the next one; it keeps one string per session. Within a micro-batch a session's
    events are held by one task and taken in ``seq`` order, equal ones in order of arrival. Bound a
    micro-batch with the source's rate options.
    """
    types = dict(df.dtypes)
    out_schema = (f"`{key}` {types[key]}, `{seq}` {types[seq]}, `{text_col}` STRING, clean_text STRING,"
                  " total_matches BIGINT")

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else ("",)
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        changed = []
        for text, clean in zip(rows["_now"], rows["clean_text"]):
            new = bool(text) and text != last
            changed.append(new and clean != text)
            last = clean if new else text
        state.update((last,))
        yield rows[changed][[key, seq, "_now", "clean_text", "total_matches"]].rename(columns={"_now": text_col})

    masked = _masked(df, text_col, rules).select(key, seq, "_now", "clean_text", "total_matches")
    return masked.groupBy(key).applyInPandasWithState(step, out_schema, "last STRING", "append", "NoTimeout")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Watcher(StatefulProcessor):
    """The last text of a session, on disk, which leaves the state when nothing came for ``idle`` milliseconds."""

    def __init__(self, columns: list[str], text_col: str, idle: int | None):
        self.columns, self.text_col, self.idle = columns, text_col, idle

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "last STRING", self.idle)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:  # a session that is only in the initial state
            return
        last = self.last.get()[0] if self.last.exists() else ""
        events = pd.concat(frames).sort_values(self.columns[1], kind="stable")
        changed = []
        for text, clean in zip(events["mw_now"], events["clean_text"]):
            new = bool(text) and text != last
            changed.append(new and clean != text)
            last = clean if new else text
        self.last.update((last,))
        yield events[changed][[*self.columns, "mw_now", "clean_text", "total_matches"]].rename(columns={"mw_now": self.text_col})

    def handleInitialState(self, key, initial, timer_values) -> None:
        self.last.update((initial["last"].iloc[0] or "",))

    def close(self) -> None:
        pass


def watch_stream_idle(df: DataFrame, key: str, seq: str, text_col: str, rules: Rules = None, idle_ms: int | None = None,
                      initial: DataFrame | None = None) -> DataFrame:
    """``watch_stream`` with state in RocksDB that ends: a session idle for ``idle_ms`` is forgotten, and its next text counts as new.

    ``initial`` is a table ``(key, last)`` of what sessions held before the stream began, one row each: the ``clean_text`` of their last event
    in ``watch_table``. The state store must be ``ROCKSDB``, set in the session before the stream starts. With ``idle_ms`` there is always a next
    micro-batch to look for state that ended, so run it polled; ``available_now`` would not come to an end.
    """
    spark, types = df.sparkSession, dict(df.dtypes)
    if spark.conf.get(_STORE) != ROCKSDB:
        raise ValueError(f"set {_STORE} to {ROCKSDB}")
    out_schema = (f"`{key}` {types[key]}, `{seq}` {types[seq]}, `{text_col}` STRING, clean_text STRING,"
                  " total_matches BIGINT")
    masked = _masked(df, text_col, rules).select(key, seq, F.col("_now").alias("mw_now"), "clean_text", "total_matches")
    before = initial.select(key, F.coalesce("last", F.lit("")).alias("last")).groupBy(key) if initial is not None else None
    return masked.groupBy(key).transformWithStateInPandas(
        _Watcher([key, seq], text_col, idle_ms), out_schema, "append", "processingTime" if idle_ms else "none", initialState=before)


def start_watch(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write masked texts as they come. The file sink commits each micro-batch once, so a failed write
    is retried from the checkpoint without duplicates."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime=POLL_INTERVAL)).start()


def on_demand(df: DataFrame, text_col: str, rules: Rules = None) -> DataFrame:
    """Mask whatever text is there, clean or not, changed or not; empty texts give nothing."""
    return _masked(df.where(F.col(text_col) != ""), text_col, rules).drop("_now")


# ------------------------------------------------------------------ batch
def watch_table(df: DataFrame, key: str, seq: str, text_col: str, rules: Rules = None,
                bucket_width: int | None = None) -> DataFrame:
    """The same over a table: every event with ``processed`` and ``masked`` flags.

    Whether an event is processed depends on the one before only through one bit (was that one
    processed?), because the memory is either its text or its masked text. So each event maps that
    bit to its own: to a constant, to itself, or to its opposite. The flag is the last constant
    before it, flipped once per opposite since: running window functions instead of a loop.

    Texts are compared by hashes, and the windows carry those. Two events of a session with one ``seq``
    are an error, as their order would be left to chance; give the arrival order in ``seq``.

    A numeric ``seq`` can be cut into buckets of ``bucket_width``: windows then run per (session,
    bucket), each bucket is summed up in one row, and only those rows are scanned per session. No
    session, however hot, passes through one task, and the result is the same for any width. Without a
    width a session passes through one task. The masking is done twice then, once for hashes only.
    """
    events = (_masked(df, text_col, rules).withColumn("_h", F.unhex(F.md5("_now")))
              .withColumn("_hc", F.unhex(F.md5("clean_text"))).withColumn("_some", F.col("_now") != ""))
    if bucket_width is None:
        order = Window.partitionBy(key).orderBy(seq)
        bits = _bits(_in_order(events, order, seq), F.lag("_h").over(order), F.lag("_hc").over(order))
        flagged = _follow(bits, order).withColumn("processed", F.col("_if_off"))
    else:
        flagged = _by_bucket(events, key, seq, bucket_width)
    return (flagged.withColumn("masked", F.col("processed") & (F.col("clean_text") != F.col("_now")))
            .select(*df.columns, "clean_text", "total_matches", "processed", "masked"))


def _in_order(events: DataFrame, order, seq: str) -> DataFrame:
    """Fail where two events of a session have one place."""
    tied = F.lag(seq).over(order).eqNullSafe(F.col(seq)) & (F.row_number().over(order) > 1)
    return events.withColumn("_some", F.when(tied, F.raise_error(F.concat(
        F.lit("two events of one session at "), F.col(seq).cast("string"))).cast("boolean")).otherwise(F.col("_some")))


def _bits(events: DataFrame, before, before_clean) -> DataFrame:
    """``_on``/``_off``: is the event processed if the one before was / was not?"""
    nothing = F.unhex(F.md5(F.lit("")))
    return (events.withColumn("_before", F.coalesce(before, nothing))
            .withColumn("_before_clean", F.coalesce(before_clean, nothing))
            .withColumn("_on", F.col("_some") & (F.col("_h") != F.col("_before_clean")))
            .withColumn("_off", F.col("_some") & (F.col("_h") != F.col("_before")))
            .drop("_before", "_before_clean"))


def _follow(bits: DataFrame, order) -> DataFrame:
    """``_if_on``/``_if_off``: the flag after each event, if the bit before the first was set / not."""
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flip, constant = ~F.col("_on") & F.col("_off"), F.col("_on") == F.col("_off")
    flipped = bits.withColumn("_flips", F.sum(flip.cast("bigint")).over(upto))
    anchor = F.when(constant, F.struct(F.col("_on").alias("bit"), F.col("_flips").alias("n")))
    anchored = flipped.withColumn("_anchor", F.last(anchor, ignorenulls=True).over(upto))
    odd = (F.col("_flips") - F.coalesce(F.col("_anchor.n"), F.lit(0))) % 2 == 1
    return (anchored.withColumn("_if_on", F.coalesce(F.col("_anchor.bit"), F.lit(True)) != odd)
            .withColumn("_if_off", F.coalesce(F.col("_anchor.bit"), F.lit(False)) != odd)
            .drop("_on", "_off", "_flips", "_anchor"))


def _by_bucket(events: DataFrame, key: str, seq: str, width: int) -> DataFrame:
    # Within a bucket: follow the flags from the bucket's first event, whose own flag is open.
    order = Window.partitionBy(key, "_bucket").orderBy(seq)
    first = F.row_number().over(order) == 1
    bucketed = _in_order(events.withColumn("_bucket", F.floor(F.col(seq) / width)), order, seq)
    local = _bits(bucketed, F.lag("_h").over(order), F.lag("_hc").over(order))
    local = _follow(local.withColumn("_first", first)
                    .withColumn("_on", F.col("_on") | F.col("_first"))
                    .withColumn("_off", F.col("_off") & ~F.col("_first")), order)

    # One row per bucket: its first text, its last event, and the flag of its last event.
    buckets = local.groupBy(key, "_bucket").agg(
        F.min_by(F.struct("_h", "_some"), seq).alias("_head"),
        F.max_by(F.struct("_h", "_hc", "_if_on", "_if_off"), seq).alias("_tail")).select(key, "_bucket", "_head.*", "_tail")
    chain = Window.partitionBy(key).orderBy("_bucket")
    entry = _bits(buckets, F.lag("_tail._h").over(chain), F.lag("_tail._hc").over(chain))

    def through(bit: str):  # the bucket as one event: entry flag, then its inner flags
        return F.when(F.col(bit), F.col("_tail._if_on")).otherwise(F.col("_tail._if_off"))

    after = _follow(entry.withColumn("_open_on", F.col("_on")).withColumn("_open_off", F.col("_off"))
                    .withColumn("_on", through("_open_on")).withColumn("_off", through("_open_off")), chain)
    carried = F.coalesce(F.lag("_if_off").over(chain), F.lit(False))
    opened = (after.withColumn("_carried", carried)
              .select(key, "_bucket", F.when(F.col("_carried"), F.col("_open_on"))
                      .otherwise(F.col("_open_off")).alias("_opens")))

    return (local.join(opened, [key, "_bucket"])
            .withColumn("processed", F.when(F.col("_opens"), F.col("_if_on")).otherwise(F.col("_if_off"))))
