"""Overlap resolution over a findings table: the same greedy choice as in ``resolve``, by windows and blocks.

For findings of many tools, or of texts too large for a row. Findings of a text are cut into blocks where nothing reaches across, by
a running maximum of ends; blocks are independent, so they go to tasks on their own. Inside a block, findings come sorted by rank and
are kept where they overlap nothing kept before, which one pass with a sorted list of kept spans tells.

No text is ever in one task: the running maximum is taken per stretch of ``width`` places, and only one row per stretch is scanned per text.
Findings are written once to the shared folder, as their places are read twice. In a text none of whose findings leaves its stretch, the
stretches are the blocks, and no maximum is needed.
Within a block a task holds the spans it keeps, which are disjoint; the findings themselves stream through in sort order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from maskwright.functions.expr import free_for
from maskwright.sources.scratch import shared_folder

WIDTH = 100_000  # places (characters) per stretch


class _Kept:
    """Disjoint spans kept so far, in text order, and empty ones."""

    def __init__(self):
        self.starts, self.ends, self.empty = [], [], []

    def take(self, start: int, end: int) -> bool:
        """Keep the span unless it overlaps one kept before; touching is no overlap."""
        if start == end:
            at = bisect_left(self.starts, start)
            if at and self.ends[at - 1] > start:
                return False
            self.empty.insert(bisect_left(self.empty, start), start)
            return True
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        inside = bisect_right(self.empty, start)
        if inside < len(self.empty) and self.empty[inside] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _greedy(n_keys: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, then rank. The first columns are keys and block, then start and end."""
        now, kept = None, _Kept()
        for b in frames:
            keep = np.zeros(b.num_rows, bool)
            names = [c.to_pylist() for c in b.columns[: n_keys + 1]]
            start, end = (b.column(n_keys + 1 + k).to_pylist() for k in (0, 1))
            for i, (*block, s, e) in enumerate(zip(*names, start, end)):
                if block != now:
                    now, kept = block, _Kept()
                keep[i] = kept.take(s, e)
            yield b.filter(pa.array(keep))
    return run


def with_blocks(findings: DataFrame, keys: Sequence[str], width: int = WIDTH, into: str = "block") -> DataFrame:
    """Add the start of the block each finding belongs to. Findings of different blocks never overlap."""
    stretch = findings.withColumn("_mw_stretch", F.floor(F.col("start") / width))
    near = Window.partitionBy(*keys, "_mw_stretch").orderBy("start", "end")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    reach = stretch.withColumn("_mw_reach", F.max("end").over(before))

    # one row per stretch: what earlier stretches reach, and whether any block begins in this one
    chain = Window.partitionBy(*keys).orderBy("_mw_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = stretch.groupBy(*keys, "_mw_stretch").agg(F.max("end").alias("_mw_end"))
    carried = ends.select(*[F.col(k).alias(f"_mw_key_{i}") for i, k in enumerate(keys)], F.col("_mw_stretch").alias("_mw_at"),
                          F.max("_mw_end").over(chain).alias("_mw_carried"))

    def same(left: str, right: str):
        condition = F.col(left) == F.col(right)
        for i, k in enumerate(keys):
            condition = condition & F.col(k).eqNullSafe(F.col(f"_mw_key_{i}"))
        return condition

    names = [f"_mw_key_{i}" for i in range(len(keys))]
    met = reach.join(carried, same("_mw_stretch", "_mw_at")).drop(*names, "_mw_at")
    first = F.col("start") >= F.coalesce(F.greatest("_mw_reach", "_mw_carried"), F.col("start"))
    opened = met.withColumn("_mw_open", F.when(first, F.col("start"))).withColumn(
        "_mw_own", F.last("_mw_open", ignorenulls=True).over(near))  # with its peers, of which only one is the first
    last = opened.groupBy(*keys, "_mw_stretch").agg(F.max("_mw_open").alias("_mw_last"))
    handed = last.select(*[F.col(k).alias(f"_mw_key_{i}") for i, k in enumerate(keys)], F.col("_mw_stretch").alias("_mw_at"),
                         F.last("_mw_last", ignorenulls=True).over(chain).alias("_mw_handed"))
    out = opened.join(handed, same("_mw_stretch", "_mw_at")).drop(*names, "_mw_at")
    return out.withColumn(into, F.coalesce("_mw_own", "_mw_handed")).drop(
        "_mw_stretch", "_mw_reach", "_mw_carried", "_mw_open", "_mw_own", "_mw_handed")


def resolve_findings(findings: DataFrame, keys: Sequence[str], rank: str | None = None, width: int = WIDTH) -> DataFrame:
    """The findings that survive greedy resolution within each text, with all their columns.

    ``keys`` name the text; ``start`` and ``end`` are places in it, end exclusive. The surest come first, then the earliest, the longest, and
    the lowest ``rank`` (a column; without it, equal findings are taken in the order of their other columns). Findings without a place
    or confidence, or that end before they start, are left out. Null keys are a text of their own.
    """
    columns = list(findings.columns)
    usable = free_for(findings, "block").where("start IS NOT NULL AND end IS NOT NULL AND confidence IS NOT NULL AND end >= start")
    rest = [c for c in columns if c not in (*keys, "start", "end")]
    usable = usable.withColumn("block", F.floor(F.col("start") / width) * width).select(*keys, "block", "start", "end", *rest)
    path = shared_folder(findings.sparkSession, "findings")
    usable.write.parquet(path)
    rows = findings.sparkSession.read.schema(usable.schema).parquet(path)
    crossed = rows.where(F.col("end") > F.col("block") + width).select(*[F.col(k).alias(f"_mw_key_{i}") for i, k in enumerate(keys)]).distinct()
    if not crossed.isEmpty():
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_mw_key_{i}")) for i, k in enumerate(keys)])
        cut = with_blocks(rows.join(crossed, same, "left_semi").drop("block"), keys, width).select(*rows.columns)
        rows = rows.join(crossed, same, "left_anti").unionAll(cut)
    ties = [rank] if rank else [c for c in rest if c != "confidence" and findings.schema[c].dataType.typeName() not in ("map", "variant")]
    order = [F.desc("confidence"), F.asc("start"), F.desc("end"), *ties]
    tasks = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block", *order)
    return tasks.mapInArrow(_greedy(len(keys)), rows.schema).select(*columns)
