"""Bloom filters of a fixed size, built by tasks and merged by segment.

A row has two positions, one in each half of the table. Tasks emit the positions of their rows, tasks that own a segment merge
them, and the driver broadcasts the packed bits: 2**27 bits are 16 MB, whatever the input. A full table only lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskwright.llm.common import handed_back, send

LOG2_BITS = 27
SEGMENT_BITS = 23
FLUSH_ROWS = 500_000


def _positions(h: np.ndarray, log2_bits: int) -> np.ndarray:
    """Two positions of each 64-bit hash: those in the first half of the table, then those in the second."""
    half = np.uint64(1 << (log2_bits - 1))
    u = h.astype(np.int64).view(np.uint64)
    return np.concatenate([u % half, half + ((u >> np.uint64(32)) ^ (u * np.uint64(0x9E3779B97F4A7C15))) % half])


def _partial(log2_bits: int):
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        """Positions of some rows by segment: all of them, and those hit more than once."""
        at, n = np.unique(_positions(np.concatenate(held), log2_bits), return_counts=True)
        segment = (at >> np.uint64(SEGMENT_BITS)).astype(np.int32)
        offset = (at & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u4")
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        ends = np.append(cuts[1:], len(at))
        return pa.RecordBatch.from_arrays([
            pa.array(segment[cuts], pa.int32()),
            pa.array([offset[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            pa.array([offset[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        ], names=["segment", "hit", "hit_again"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in frames:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)
    return run


def _merge(repeated: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of the segments that fell to this task: positions hit at all, or by two rows or more."""
        once: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for b in frames:
            for segment, hit, more in zip(*(c.to_pylist() for c in b.columns)):
                if segment not in once:
                    once[segment] = np.zeros(1 << SEGMENT_BITS, bool)
                    again[segment] = np.zeros(1 << SEGMENT_BITS, bool)
                at, twice = np.frombuffer(hit, "<u4"), np.frombuffer(more, "<u4")
                again[segment][at[once[segment][at]]] = True
                again[segment][twice] = True
                once[segment][at] = True
        for segment, bits in (again if repeated else once).items():
            if bits.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])
    return run


def table_of(hashes: DataFrame, repeated: bool = False, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """Packed bits for a table with one long column. ``repeated``: only positions hit by two rows or more."""
    segments = max(1, 1 << (log2_bits - SEGMENT_BITS))
    merged = (
        hashes.mapInArrow(handed_back(_partial(log2_bits)), "segment int, hit binary, hit_again binary")
        .repartition(segments, "segment").coalesce(segments)
        .mapInArrow(handed_back(_merge(repeated)), "segment int, bits binary")
    )
    table = np.zeros(segments << (SEGMENT_BITS - 3), np.uint8)
    for segment, bits in merged.collect():
        start = segment << (SEGMENT_BITS - 3)
        table[start : start + len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def found(table: np.ndarray, h: np.ndarray, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """Whether both positions of each hash are set: always for rows of the table's input."""
    at = _positions(h, log2_bits).astype(np.int64).reshape(2, -1)
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def maybe(spark: SparkSession, hash_column: Column, table: np.ndarray, log2_bits: int = LOG2_BITS) -> Column:
    """``found`` as a column."""
    shared = send(spark, table)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(found(shared.value, h.to_numpy(zero_copy_only=False), log2_bits))

    return test(hash_column)
