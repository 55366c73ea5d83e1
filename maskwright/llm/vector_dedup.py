"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of the vectors serves as reference points (pivots). Every vector is described by its ``NEAREST`` nearest
pivots. Inverted lists, one per label and pivot, hold the vectors that count it among theirs; vectors that share at least
``SHARED`` pivots are candidates, and their cosine decides. A pair that meets in several lists counts in the list of the
lowest pivot that the two share; that is never among the last ``SHARED - 1`` pivots of a vector, in which it is not listed.

Equal vectors are one class from the start. Lists are cut into blocks of ``BLOCK`` classes, and a task compares two blocks of one
list by matrix products, so a list of any length is spread over tasks of bounded size, and no pair is written: a block gives, for
each class, the number of vectors linked in it, and the links of a spanning forest.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with
nothing and are their own component. Vectors of different length do not link; more than ``MOST_SIZES`` lengths are an error. Rows that repeat an id are vectors of their own; where
a component holds null ids, its smallest non-null id names it. Links of exactly the limit count. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import handed_back, sample_by_hash, send, staged
from maskwright.llm.components import components

LIMIT = 0.93
PIVOTS = 256
NEAREST = 8
SHARED = 2
BLOCK = 512
MOST_SIZES = 64


def _valid(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector, label) with vectors as bytes of doubles, or null if they cannot link."""
    for b in frames:
        sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
        starts = np.cumsum(sizes) - sizes
        out = np.full(b.num_rows, None, object)
        for size in np.unique(sizes[sizes > 0]):
            own = np.flatnonzero(sizes == size)
            x = flat[starts[own][:, None] + np.arange(size)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            own, x = own[good], x[good]
            # scaling by a power of two is exact and keeps squares in range
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) + 0.0
            out[own] = [r.tobytes() for r in x]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], names=["vec_id", "v", "label"])


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in rows])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(shared, nearest: int, listed: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings: each class under its pivots, with all its pivots."""
        by_size = {size: _unit(rows) for size, rows in shared.value.items()}
        for b in frames:
            vectors = b.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                pivots = by_size[size]
                x = _unit([vectors[i] for i in own])
                near = np.sort(np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest].astype("<i4"), axis=1)
                take = pa.array(np.repeat(own, min(listed, near.shape[1])))
                kept = b.take(take)
                described = [r.tobytes() for r in near]
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(near[:, :listed].ravel().astype(np.int32)), pa.array(np.repeat(np.array(described, object), min(listed, near.shape[1])), pa.binary())],
                    names=["cid", "label", "v", "n", "pivot", "near"])
    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place, by the symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        lower = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, lower)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(limit: float, shared_pivots: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One list, two blocks (or one with itself): what each class links to here, and a forest of the links."""
        table = table.sort_by("cid")
        cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
        block, pivot = table["block"].to_numpy(), key[1].as_py()
        x = _unit(table["v"].to_pylist())
        near = np.stack([np.frombuffer(r, "<i4") for r in table["near"].to_pylist()])
        flags = np.zeros((len(cid), int(near.max()) + 1), np.float32)
        flags[np.arange(len(cid))[:, None], near] = 1
        pairs = flags @ flags.T >= shared_pivots
        pairs &= flags[:, :pivot] @ flags[:, :pivot].T == 0  # this is the lowest pivot that the two share
        if key[2].as_py() != key[3].as_py():
            pairs &= block[:, None] != block[None, :]
        np.fill_diagonal(pairs, False)
        linked = pairs & (x @ x.T >= limit)
        root = _forest(linked)
        return pa.table({"cid": cid, "links": linked @ n, "root": cid[root]}).filter(pa.array(linked.any(axis=1)))
    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = LIMIT,
                 n_pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked), component_id (smallest id reachable), kept (id is component_id)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = staged(rows.mapInArrow(handed_back(_valid), f"vec_id {types['vec_id']}, v binary, label {types['label']}"), "vectors")
    alone = F.col("v").isNull() | F.col("label").isNull()
    linkable = rows.where(~alone)
    classes = staged(linkable.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
                     .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    # pivots: of each length of vector, those with the lowest hashes
    sizes = [r.d for r in classes.groupBy(F.length("v").alias("d")).count().select("d").limit(MOST_SIZES + 1).collect()]
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"vectors of more than {MOST_SIZES} different lengths")
    hashed = classes.groupBy("v").agg(F.xxhash64("v").alias("h"))
    pivots = {d: [bytes(r.v) for r in sample_by_hash(hashed.where(F.length("v") == d), "h", n_pivots).collect()] for d in sizes}
    listed = nearest - shared + 1
    call = _lists(send(vectors.sparkSession, pivots), nearest, listed)
    postings = staged(classes.select("cid", "label", "v", "n").mapInArrow(
        handed_back(call), f"cid long, label {types['label']}, v binary, n long, pivot int, near binary"), "vector-lists")
    size = F.length("v")
    lists = postings.groupBy("label", "pivot", size.alias("d")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = postings.join(staged(lists, "vector-list-sizes").withColumnsRenamed({"label": "l", "pivot": "p"}),
                        (F.col("label") == F.col("l")) & (F.col("pivot") == F.col("p")) & (size == F.col("d")))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("label", "pivot", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "d", "cid", "v", "n", "near", "block")
    found = staged(paired.groupBy("label", "pivot", "b1", "b2", "d").applyInArrow(_compare(limit, shared), "cid long, links long, root long"), "vector-links")
    totals = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = staged(components(found, "cid", "root", "vector-components").withColumnsRenamed({"node": "cid", "component": "comp"}), "vector-groups")
    named = classes.select("cid", "label", "v", "n", "first_id").join(totals, "cid", "left").join(groups, "cid", "left")
    named = named.withColumn("comp", F.coalesce("comp", "cid"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(names, "comp").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-named")
    own = F.col("r.vec_id")
    joined = rows.where(~alone).alias("r").join(named.alias("c"), (F.col("r.label") == F.col("c.label")) & (F.col("r.v") == F.col("c.v"))).select(own, "n_links", "component_id")
    out = joined.unionByName(rows.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
