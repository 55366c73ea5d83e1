"""Result rows of operators that find spans in texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import handed_back

Span = tuple[int, int, int]  # start, number of the kind, end: in code points, end exclusive


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_in_texts(docs: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...], base_kinds: int,
                  start: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]]) -> DataFrame:
    """One row per text: id, n_<kind> of base spans, base_sha256, spans.

    ``start()`` is called once per task and gives a function from a text to (base spans, further spans).
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"))
    counts = [f"n_{k}" for k in kinds[:base_kinds]]
    schema = (f"`{id_col}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts)
              + ", base_sha256 string, spans string")
    nothing = hashlib.sha256(b"").hexdigest()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = start()
        for b in frames:
            n = [[0] * b.num_rows for _ in counts]
            digest, spans = [nothing] * b.num_rows, [""] * b.num_rows
            for i, value in enumerate(b.column(1)):
                text = value.as_py()
                if not text:
                    continue
                base, more = find(text)
                if base:
                    for _, k, _ in base:
                        n[k][i] += 1
                    digest[i] = hashlib.sha256(joined(base, kinds).encode()).hexdigest()
                if base or more:
                    spans[i] = joined(base + more, kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in n], pa.array(digest), pa.array(spans)],
                                             names=[id_col, *counts, "base_sha256", "spans"])

    return rows.mapInArrow(handed_back(run), schema)
