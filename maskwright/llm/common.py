"""Helpers shared by the operators: intermediate tables in the shared folder, free column names, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Bytes of rows that go to a Python worker at once, in place of Spark's larger default: two copies in the JVM and two in the worker
#: for every running task would otherwise be the largest part of an executor's memory.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a session in one process (master ``local`` or ``local[n]``) may go without: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks, not the work before. Files go when the JVM ends. ``parts`` is the
    number of tasks that its size is worth, where that is known; more partitions than that are put together.
    """
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if parts:
        df = df.coalesce(parts)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def pieces(frames: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column of strings holds at most ``most`` bytes, or one row: bounds what an operator unpacks at once."""
    for b in frames:
        if b.num_rows == 0:
            yield b
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(start, end - start)
            start = end
    release_memory()


def handed_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, and memory given back when it has ended and nothing of it is held any more."""
    def wrapped(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(frames)
        finally:
            release_memory()
    return wrapped


_SENT: list[tuple[SparkContext, Broadcast]] = []


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast ``value``; ``release_sent`` frees the executors of it."""
    sent = spark.sparkContext.broadcast(value)
    _SENT.append((spark.sparkContext, sent))
    return sent


def done_with(sent: Broadcast) -> None:
    """Drop what was sent, from the driver too; nothing that is still to run may need it."""
    _SENT[:] = [(context, other) for context, other in _SENT if other is not sent]
    sent.destroy()


def release_sent() -> None:
    """Drop what was sent from the executors; what is still needed they fetch again."""
    while _SENT:
        context, sent = _SENT.pop()
        if context._jsc is not None:  # the session may have ended
            sent.unpersist()


def release_memory() -> None:
    """Give memory that a task's arrays have left back to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch in one array, and where each text begins (one more entry at the end).

    Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sample_by_hash(rows: DataFrame, hash_column: str, most: int) -> DataFrame:
    """The ``most`` rows with the lowest hashes (64 bits, any sign), without ordering or moving many more than those."""
    n = rows.count()
    share = (most + 6 * most**0.5 + 16) / max(n, 1)
    if share < 1:
        rows = rows.where(F.col(hash_column) < F.lit(int(share * 2.0**64) - 2**63))
    return rows.orderBy(hash_column, *[c for c in rows.columns if c != hash_column]).limit(most)


def least_count(counted: DataFrame, column: str, most: int) -> int:
    """The least count such that at most ``most`` rows have it or more. The driver gets a histogram of the counts."""
    histogram = counted.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc(column)).collect()
    least, kept = (histogram[0][0] if histogram else 0) + 1, 0
    for value, n in histogram:
        kept += n
        if kept > most:
            break
        least = value
    return least
