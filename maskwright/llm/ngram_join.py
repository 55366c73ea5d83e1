"""Exact Jaccard join on word shingles through a token-group matrix.

Texts with equal sets are one class. Classes that are similar are partitioned into groups: each class is compared with the leaders
of its rarest shared tokens, where a token's leader is the class that has the fewest rarer ones, as the original of many copies
has, and what is linked forms a group. The matrix of tokens by groups holds, for each group, the union of its members' tokens. A class is compared with a group only if the matrix shows overlap
enough for a link: with the limit t, a link of sets of sizes m and n needs ``t / (1 + t) * (m + n)`` common tokens, so that of any
``k`` of them one is among the first ``m - needed + k`` tokens of a set, under any order of tokens common to all. Only such
prefixes are indexed, with frequent tokens last; a class must share ``k`` indexed tokens with a group's union, at places that leave
enough to come and with a size that fits. Qualifying groups are opened: their members are compared exactly. As members of a group
are connected already, only pairs of different groups matter, and a group of many near copies costs no pairs within itself.

The order of tokens affects speed only: those of ``HOT_LEAST`` classes or more go last, by frequency, ``HOT`` of them at most. Sets are compared by hashes of 40 bits within a pair, of 64 bits as classes.

Defined results: a null text counts as empty; texts without words have an empty set and link with nothing. Rows that repeat an id
are documents of their own; where a component holds null ids, its smallest non-null id names it. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskwright.llm import bloom
from maskwright.llm.common import free_name, handed_back, least_count, pieces, send, staged, text_buffer, text_or_empty
from maskwright.llm.components import components
from maskwright.llm.shingles import shingle_sets

LIMIT = 80  # hundredths
HOT = 1 << 20
HOT_LEAST = 6
FLUSH = 1_000_000  # tokens held by a task
BUCKET_BYTES = 1 << 22  # bytes of text per bucket of tokens
BUCKETS_PER_TASK = 8
NEAR = 6  # shared tokens of a class whose leaders it is compared with
PROBE = 16  # shared tokens of a class that are tried against the leader of another group
PART = 1024  # pairs of one class that a task compares
PAIRS_PER_TASK = 10_000
ROWS_PER_TASK = 500_000


def _slack(n):
    """How many common tokens are asked for in prefixes of a set of n tokens: k above."""
    return 1 + n // 32


def _at_least(n, limit: int):
    """Common tokens that a link needs, at least, of a set of n."""
    return (limit * n + 99) // 100


def prefix_length(n: int, limit: int) -> int:
    return min(n, n - _at_least(n, limit) + _slack(n))


def _class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _keys(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and 32 more of its bits."""
    return (tokens & np.uint64(buckets - 1)).astype(np.int32), ((tokens >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[pa.Array, list[pa.Array]]:
    """Buckets that occur, and for each column the values of each bucket as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cuts[1:], len(bucket)]
    return pa.array(bucket[cuts], pa.int32()), [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for c in (c[order] for c in columns)]


# ------------------------------------------------------------------ first pass: classes and frequent tokens
def _first(buckets: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text (id, n, cid), and rows of tokens to be counted, by bucket."""
        names = ["doc_id", "n", "cid", "bucket", "tokens"]
        held, seen, size, id_type = [], set(), 0, None

        def flush():
            bucket, short = _keys(np.concatenate(held), buckets)
            bucket, (tokens,) = _by_bucket(bucket, [short])
            m = len(bucket)
            return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), bucket, tokens], names=names)

        for b in pieces(frames, "text"):
            id_type = b.schema.field(0).type
            n, cid = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, None, object)
            for i, tokens in enumerate(shingle_sets(*text_buffer(b.column(1)))):
                if len(tokens):
                    n[i], cid[i] = len(tokens), _class_id(tokens)
                    if cid[i] not in seen:
                        seen.add(cid[i])
                        held.append(tokens)
                        size += len(held[-1])
                        if size >= FLUSH:
                            yield flush()
                            held, size = [], 0
                            seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(cid, pa.int64()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
        if size:
            yield flush()
    return run


def _frequent(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole: tokens of HOT_LEAST classes or more."""
    for bucket, (tokens,) in _whole(frames, ["<u4"]):
        token, n = np.unique(tokens, return_counts=True)
        often = n >= HOT_LEAST
        yield pa.RecordBatch.from_arrays([pa.array((token[often].astype(np.int64) << 24) | bucket), pa.array(n[often])], names=["token", "n"])


def _whole(frames: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of blobs, sorted by bucket, as whole buckets."""
    def joined(held):
        return [np.frombuffer(b"".join(h[k] for h in held), kind) for k, kind in enumerate(kinds)]
    now, held = None, []
    for b in frames:
        for bucket, *blobs in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now:
                if held:
                    yield now, joined(held)
                now, held = bucket, []
            held.append(blobs)
    if held:
        yield now, joined(held)


def _to_buckets(df: DataFrame, buckets: int) -> DataFrame:
    tasks = max(1, buckets // BUCKETS_PER_TASK)
    return df.repartition(tasks, "bucket").coalesce(tasks).sortWithinPartitions("bucket")


def frequent_tokens(first: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the most frequent tokens, sorted, and their ranks: at most HOT of them come to the driver."""
    sent = _to_buckets(first.where("bucket is not null").select("bucket", "tokens"), buckets)
    counted = staged(sent.mapInArrow(handed_back(_frequent), "token long, n long"), "ngram-frequent", max(1, buckets // BUCKETS_PER_TASK))
    top = counted.where(F.col("n") >= least_count(counted, "n", HOT)).toPandas().sort_values(["n", "token"])
    key, rank = top["token"].to_numpy(np.int64), np.arange(len(top))
    order = np.argsort(key)
    return key[order], rank[order]


# ------------------------------------------------------------------ second pass: prefixes, by token
def _ordered(tokens: np.ndarray, length: int, hot: np.ndarray, rank: np.ndarray, buckets: int) -> np.ndarray:
    """The first tokens of a set: others by hash, then frequent ones by rank."""
    if not len(hot):
        return tokens[:length]
    for most in (min(len(tokens), 2 * length + 8), len(tokens)):  # nearly always the first ones are enough
        bucket, short = _keys(tokens[:most], buckets)
        key = (short.astype(np.int64) << 24) | bucket
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        often = hot[at] == key
        cold = tokens[:most][~often][:length]
        if len(cold) == length:
            return cold
    return np.concatenate([cold, tokens[often][np.argsort(rank[at[often]], kind="stable")][: length - len(cold)]])


def _prefixes(shared, limit: int, buckets: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        parts: list[tuple] = []
        seen: set[int] = set()
        size = 0

        def flush():
            bucket, short = _keys(np.concatenate([p[0] for p in parts]), buckets)
            lengths = [len(p[0]) for p in parts]
            cid, n = (np.repeat(np.array([p[k] for p in parts], t), lengths) for k, t in ((1, "<i8"), (2, "<i4")))
            place = np.concatenate([np.minimum(np.arange(m), 65535) for m in lengths]).astype("<u2")
            bucket, columns = _by_bucket(bucket, [short, cid, n, place])
            return pa.RecordBatch.from_arrays([bucket, *columns], names=["bucket", "token", "cid", "n", "place"])

        for b in pieces(frames, "text"):
            for tokens in shingle_sets(*text_buffer(b.column(0))):
                n = len(tokens)
                if not n or (cid := _class_id(tokens)) in seen:
                    continue
                seen.add(cid)
                parts.append((_ordered(tokens, prefix_length(n, limit), hot, rank, buckets), cid, n))
                size += len(parts[-1][0])
                if size >= FLUSH:
                    yield flush()
                    parts.clear()
                    seen.clear()
                    size = 0
        if parts:
            yield flush()
    return run


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole: the entries whose token has two classes or more."""
    for bucket, (token, cid, n, place) in _whole(frames, ["<u4", "<i8", "<i4", "<u2"]):
        order = np.lexsort((cid, token))
        token, cid, n, place = token[order], cid[order], n[order], place[order]
        own = np.ones(len(token), bool)
        own[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid, n, place = token[own], cid[own], n[own], place[own]
        shared = np.zeros(len(token), bool)
        shared[1:] = token[1:] == token[:-1]
        shared[:-1] |= shared[1:]
        key = (token[shared].astype(np.int64) << 24) | bucket
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid[shared]), pa.array(n[shared]), pa.array(place[shared].astype(np.int32))],
                                         names=["token", "cid", "n", "place"])


def _trimmed(runs: DataFrame, limit: int) -> DataFrame:
    """Runs without classes that share too few indexed tokens for any link, then without tokens that are no longer shared."""
    parts = 8 + runs.count() // ROWS_PER_TASK
    needed = 1 + F.floor(F.ceil(F.first("n") * limit / 100) / 32)
    enough = staged(runs.groupBy("cid").agg(F.count("*").alias("k"), needed.alias("needed")).where("k >= needed").select("cid"), "ngram-enough", parts)
    kept = staged(runs.join(enough, "cid"), "ngram-kept", parts)
    shared = staged(kept.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "ngram-shared", parts)
    turn = F.row_number().over(Window.partitionBy("cid").orderBy("place", "token"))
    return staged(kept.join(shared, "token").withColumn("turn", turn), "ngram-trimmed", parts)


# ------------------------------------------------------------------ exact comparison
def _sets_of(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the texts whose id may be wanted: class, and the low 40 bits of its tokens."""
        for b in pieces(frames, "text"):
            wanted = bloom.found(shared.value, b.column(0).to_numpy(zero_copy_only=False))
            cids, sets = [], []
            for tokens in shingle_sets(*text_buffer(b.column(1).filter(pa.array(wanted)))):
                if len(tokens):
                    cids.append(_class_id(tokens))
                    short = np.sort(tokens & np.uint64((1 << 40) - 1)).astype("<u8")
                    sets.append(short.view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "tokens"])
    return run


def _widen(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _verify(limit: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by class a: its own set first, then those of its candidates."""
        now, own = None, None
        for b in frames:
            out = []
            for a, other, packed in zip(*(b.column(c).to_pylist() for c in ("a", "b", "tokens"))):
                if other is None:
                    now, own = a, _widen(packed)
                    continue
                if a != now:
                    raise RuntimeError("a class without its set")
                tokens = _widen(packed)
                both = np.concatenate([own, tokens])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= limit * (len(both) - common):
                    out.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def compare(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked. The pairs of one class are split over tasks, PART to each."""
    pairs = staged(pairs, "ngram-pairs", 64)
    tasks = 8 + pairs.count() // PAIRS_PER_TASK
    parts = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "ngram-parts", tasks)
    right = (pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
             .join(sets.withColumnRenamed("cid", "b"), "b").select("a", "part", "b", "tokens"))
    left = (parts.join(sets.withColumnRenamed("cid", "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("a", "part", F.lit(None).cast("long").alias("b"), "tokens"))
    rows = left.unionByName(right).repartition(tasks, "a", "part").coalesce(tasks).sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return staged(rows.select("a", "b", "tokens").mapInArrow(handed_back(_verify(limit)), "a long, b long"), "ngram-links", tasks)


def _fits(m: Column, n: Column, limit: int) -> Column:
    return (F.least(m, n) * 100 >= F.greatest(m, n) * limit)


def _pairs(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _groups(links: DataFrame) -> DataFrame:
    return staged(components(links, "a", "b", "ngram-groups").withColumnRenamed("node", "cid"), "ngram-members", 64)


def _mixed(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Runs with the group of each class, of the tokens that several groups share."""
    named = staged(runs.join(groups, "cid", "left").withColumn("g", F.coalesce("component", "cid")).drop("component"), "ngram-named")
    several = staged(named.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("token"), "ngram-several", 64)
    return staged(named.join(several, "token"), "ngram-mixed")


def _leaders(runs: DataFrame) -> DataFrame:
    """For each token the class that comes to it first, with the fewest rarer tokens."""
    return runs.groupBy("token").agg(F.min(F.struct(*[c for c in ("place", "cid", "n", "g") if c in runs.columns])).alias("x"))


def group_classes(runs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Classes that are linked to others, with their component: (cid, component)."""
    # groups: each class with the leaders of its first shared tokens
    first = staged(_leaders(runs), "ngram-leaders")
    tried = runs.where(F.col("turn") <= NEAR).join(first, "token").where(_fits(F.col("n"), F.col("x.n"), limit))
    links = compare(_pairs(F.col("cid"), F.col("x.cid"), tried), sets, limit)

    # the leader of one other group for each of some tokens: joins what is alike but has no leader in common
    mixed = _mixed(runs, _groups(links))
    first = staged(_leaders(mixed), "ngram-leaders")
    second = staged(_leaders(mixed.join(first, "token").where(F.col("g") != F.col("x.g")).drop("x")).withColumnRenamed("x", "y"), "ngram-leaders")
    other = F.when(F.col("g") != F.col("x.g"), F.col("x")).otherwise(F.col("y"))
    probed = (mixed.where(F.col("turn") <= PROBE).join(first.join(second, "token"), "token").withColumn("o", other)
              .where(_fits(F.col("n"), F.col("o.n"), limit)))
    links = staged(links.union(compare(_pairs(F.col("cid"), F.col("o.cid"), probed), sets, limit)), "ngram-links", 64)

    # the matrix: tokens by groups, and what a class can have in common with a group at most
    groups = _groups(links)
    mixed = _mixed(runs, groups)
    matrix = staged(mixed.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("place")), "ngram-matrix")
    q, s = mixed.alias("q"), matrix.alias("s")
    n = F.col("q.n")
    smallest = F.greatest(F.col("s.least"), F.ceil(n * limit / 100))  # of a set in the group that may be linked
    needed = F.ceil((n + smallest) * F.lit(limit) / F.lit(100 + limit)) - F.floor(n / 32)
    hits = q.join(s, (F.col("q.token") == F.col("s.token")) & (F.col("q.g") < F.col("s.g"))
                  & (n * 100 >= F.col("s.least") * limit) & (F.col("s.most") * 100 >= n * limit)
                  & (n - F.col("q.place") >= needed) & (F.col("s.most") - F.col("s.place") >= needed))
    bound = (hits.groupBy(F.col("q.cid").alias("cid"), n.alias("n"), F.col("s.g").alias("g"))
             .agg(F.count("*").alias("hits"), F.min("s.least").alias("least")))
    open_ = staged(bound.where(F.col("hits") >= 1 + F.floor(F.least("n", F.greatest("least", F.ceil(F.col("n") * limit / 100))) / 32)), "ngram-open", 64)
    members = staged(mixed.select("g", F.col("cid").alias("m"), F.col("n").alias("mn")).distinct(), "ngram-open-members", 64)
    opened = open_.join(members, "g").where(_fits(F.col("n"), F.col("mn"), limit))
    more = compare(_pairs(F.col("cid"), F.col("m"), opened), sets, limit)
    return groups if more.isEmpty() else _groups(links.union(more))


# ------------------------------------------------------------------ the operator
def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept (id is component_id)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 << min(20, max(3, math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))

    first = staged(texts.mapInArrow(handed_back(_first(buckets)), f"doc_id {kind}, n int, cid long, bucket int, tokens binary"), "ngram-first")
    rows = first.where("bucket is null").select("doc_id", "n", "cid")
    hot = send(spark, frequent_tokens(first, buckets))
    prefixes = texts.select("text").mapInArrow(handed_back(_prefixes(hot, limit, buckets)), "bucket int, token binary, cid binary, n binary, place binary")
    runs = staged(_to_buckets(prefixes, buckets).mapInArrow(handed_back(_runs), "token long, cid long, n int, place int"), "ngram-runs")
    runs = _trimmed(runs, limit)

    wanted = staged(runs.select("cid").distinct(), "ngram-wanted", 64)
    ids = rows.join(wanted, "cid").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    table = send(spark, bloom.table_of(ids.select(F.xxhash64("doc_id"))))
    sets = texts.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(handed_back(_sets_of(table)), "cid long, tokens binary")
    sets = staged(sets.dropDuplicates(["cid"]), "ngram-sets")

    groups = group_classes(runs, sets, limit)
    named = staged(rows.where("cid is not null").join(groups, "cid", "left").select("doc_id", "n", F.coalesce("component", "cid").alias("c")), "ngram-documents")
    names = staged(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "ngram-names")
    out = named.join(names, "c").select("doc_id", "n", "component_id").unionByName(
        rows.where("cid is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns. Documents without an id stay.

    A document is named by its id and the hash of its text, so that rows of other texts under its id don't go with it; of different
    texts that share the smallest id of their component the one with the smallest hash stays. Rows that repeat id and text are
    one name, and stay or go together. Only rows whose name may be one to drop meet those names in a join; the others pass straight
    through.
    """
    key, h = F.col(f"`{id_col}`"), F.xxhash64(text_or_empty(text_col))
    named = docs.select(F.when(key.isNotNull(), F.struct(key.alias("id"), h.alias("h"))).alias("name"), text_or_empty(text_col).alias("text"))
    report = join_report(named, "name", "text", limit).where("not kept and name is not null")
    ids, texts = free_name(docs, "gone"), free_name(docs, "gone_text")
    gone = staged(report.select(F.col("name.id").alias(ids), F.col("name.h").alias(texts)).distinct(), "ngram-gone")
    table = bloom.table_of(gone.select(F.xxhash64(ids, texts)))
    hit = bloom.maybe(docs.sparkSession, F.xxhash64(key, h), table)
    checked = docs.where(hit).join(gone, (key == F.col(ids)) & (h == F.col(texts)), "left_anti")
    return docs.where(~hit).unionByName(checked)
