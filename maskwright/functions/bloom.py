"""Bloom filters over 64-bit hashes: built by a grouped aggregate on the cluster, tested in Arrow batches.

The table has a fixed size, ``1 << LOG2_BITS`` bits or 16 MB, whatever the input; a fuller one only lets more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOG2_BITS = 27
HASHES = 3


def _positions(h: np.ndarray, log2_bits: int) -> np.ndarray:
    """Bit numbers of each hash, from consecutive pieces of it."""
    u = h.astype(np.int64).view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([(u + np.uint64(i) * step) & np.uint64((1 << log2_bits) - 1) for i in range(HASHES)]).astype(np.int64)


def build(hashes: DataFrame, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """The words of the bit table, for a table with one column ``h``. Bits are united by tasks; the driver gets at most 16 MB of them."""
    # (u + i * step) in wrapping arithmetic, as in _positions; try_add would turn an overflow into null, xor and masks do not
    mask = (1 << log2_bits) - 1
    low = f"(h & {mask})"
    step = f"((shiftrightunsigned(h, 32) | 1) & {mask})"
    bits = hashes.select(F.expr(f"explode(transform(sequence(0, {HASHES - 1}), i -> ({low} + i * {step}) & {mask}))").alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits")).toPandas()
    table = np.zeros(1 << max(0, log2_bits - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def found(table: np.ndarray, h: np.ndarray, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """Whether all bits of each hash are set: always for those that were put in."""
    at = _positions(h, log2_bits)
    return ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=0)


def maybe_each(spark: SparkSession, hashes: Column, table: np.ndarray, log2_bits: int = LOG2_BITS) -> Column:
    """For an array of hashes the array of ``found``."""
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("array<boolean>")
    def test(arrays: pa.Array) -> pa.Array:
        flat = pa.array(found(shared.value, arrays.flatten().to_numpy(zero_copy_only=False), log2_bits))
        offsets = np.concatenate([[0], np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, flat)

    return test(hashes)
