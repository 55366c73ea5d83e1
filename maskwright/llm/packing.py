"""Mixture-controlled packing by deficit round robin over source queues.

Every source is a queue of its documents' tokens. A window of ``SIZE`` tokens owes each source its share of all tokens; a source's
deficit is what windows so far owe it beyond what it got. Sources are served in turn when their deficit reaches ``LEAST`` tokens,
up to the deficit; if none reaches it, the one with the largest gets ``LEAST`` in advance, so that pieces stay long. Documents are
cut where that or the window ends. As shares are those of the corpus, all queues run out together and every token is placed once.

Blocks of ``WINDOWS`` windows are packed in parallel. Where a block begins in a queue follows from the shares by rounding their
running sums down, so that a block holds exactly its number of tokens and the deficit it hands on to the next one, in whichever
partition that is, stays below one token per source. A document's place in its queue comes from sums by (partition, source), so no
source is ever in one task. The tokens that remain after the last full window are cut into sequences whose lengths are powers of
two, which need no padding.

Defined results: a null text counts as empty; every document has at least its end token. A null source is a source, the last.
Rows that repeat an id are documents of their own. Without rows there are no sequences. Other columns may have any names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from maskwright.llm.common import handed_back, pieces, staged

SIZE = 2048
LEAST = 64
WINDOWS = 512
BLOCKS_PER_TASK = 8
END_ID = 1
#: The pattern that cuts texts into pieces before byte pairs are merged; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: tiktoken's matcher keeps a state for each character of a run of white space and panics beyond about a million.
LONGEST_BLANK = 100_000
_BLANK = re.compile(r"\s+")


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, others moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE file of the tokenizers library; read once in a Python worker.

    Texts of Latin letters go through tiktoken, which gives the same ids for them several times faster; others, and those with a
    run of more than ``LONGEST_BLANK`` blanks, through tokenizers.
    """
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def tokenizer() -> Tokenizer:
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def blank(text: str) -> bool:
        return len(text) > LONGEST_BLANK and any(m.end() - m.start() > LONGEST_BLANK for m in _BLANK.finditer(text))

    def encode(text: str) -> np.ndarray:
        if latin(text) and not blank(text) and not any(s in text for s in special):
            return np.array(fast.encode_ordinary(text), np.uint32)
        return np.array(tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)
    return encode


def _tokenize(path: str, kind: np.dtype, end_id: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token ids of each text, and its place among the texts of its source in this partition."""
        encode = encoder(path)
        part, reached = TaskContext.get().partitionId(), {}
        for b in pieces(frames, "text"):
            sources, n, at, ids = b.column(1).to_pylist(), [], [], []
            for source, value in zip(sources, b.column(2)):
                text = value.as_py()
                own = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype(kind)
                at.append(reached.get(source, 0))
                n.append(len(own))
                reached[source] = at[-1] + len(own)
                ids.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([part] * b.num_rows, pa.int32()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "n", "at", "ids"])
    return run


def _reached(window: int, low: int, high: int, total: int, size: int) -> int:
    """Tokens that a queue, which takes part [low, high) of all ``total``, has given before a window."""
    placed = min(window * size, total)
    return placed * high // total - placed * low // total


def _split(size: int, windows: int, width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut documents where blocks begin."""
        for b in pieces(frames, "ids"):
            rows, out = b.to_pydict(), {k: [] for k in ("row", "block", "queue", "place", "start", "length", "ids")}
            for i, (n, at, ids, low, high, total) in enumerate(zip(*(rows[k] for k in ("n", "at", "ids", "low", "high", "total")))):
                block = max(0, at * total // max(1, (high - low) * size * windows) - 1)
                done = 0
                while done < n:
                    end = _reached((block + 1) * windows, low, high, total, size)
                    take = min(n, end - at) - done
                    if take > 0:
                        for k, v in zip(out, (i, block, low, at + done, done, take, ids[done * width : (done + take) * width])):
                            out[k].append(v)
                        done += take
                    block += 1
            row = np.array(out.pop("row"), np.int64)
            types = {"block": pa.int64(), "queue": pa.int64(), "place": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()}
            kept = b.select(["doc_id", "source", "n"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(out[k], t) for k, t in types.items()]],
                                             names=["doc_id", "source", "doc_tokens", *types])
    return run


class Queues:
    """Queues of a block: for each source its pieces (row, start, length)."""

    def __init__(self, queues: list[list[tuple[int, int, int]]], size: int, least: int):
        self.queues, self.size, self.least = [q[::-1] for q in queues], size, least
        totals = [sum(p[2] for p in q) for q in queues]
        self.total = sum(totals)
        self.share = [t / self.total for t in totals]

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Contents of each window: (row, start, length)."""
        deficit, turn, left, n = [0.0] * len(self.queues), 0, self.total, len(self.queues)
        while left:
            room = min(self.size, left)
            for s, share in enumerate(self.share):
                deficit[s] += share * room
            content = []
            left -= room
            while room:
                for step in range(n):
                    s = (turn + step) % n
                    if self.queues[s] and deficit[s] >= self.least:
                        break
                else:
                    s = max((s for s in range(n) if self.queues[s]), key=lambda s: deficit[s])
                turn = (s + 1) % n
                due = min(room, max(int(deficit[s]), self.least))
                if room - due < 16:  # not a scrap at the window's end
                    due = room
                got = 0
                while got < due and self.queues[s]:
                    row, start, length = self.queues[s].pop()
                    take = min(length, due - got)
                    content.append((row, start, take))
                    if take < length:
                        self.queues[s].append((row, start + take, length - take))
                    got += take
                deficit[s] -= got
                room -= got
            yield content


def _powers(content: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut one short window into sequences whose lengths are powers of two, longest first."""
    left, content = sum(p[2] for p in content), content[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            row, start, length = content.pop()
            take = min(room, length)
            out.append((row, start, take))
            if take < length:
                content.append((row, start + take, length - take))
            room -= take
        yield out


def _fill(size: int, least: int, windows: int, kind: np.dtype, with_ids: bool):
    def pack(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        queue, start, length = (rows[k].to_numpy() for k in ("queue", "start", "length"))
        ids = [np.frombuffer(x, kind) for x in rows["ids"].to_pylist()]
        cuts = np.flatnonzero(np.diff(queue, prepend=-1))
        queues = [[(i, 0, int(length[i])) for i in range(a, b)] for a, b in zip(cuts, [*cuts[1:], len(queue)])]
        sequence, out, values = block * windows, [], []
        for content in Queues(queues, size, least).windows():
            short = sum(p[2] for p in content) < size
            for sequence_content in _powers(content) if short else [content]:
                offset = 0
                for i, first, n in sequence_content:
                    piece = ids[i][first : first + n].astype("<u4")
                    out.append((i, start[i] + first, n, zlib.crc32(piece.tobytes()), sequence, offset))
                    if with_ids:
                        values.append(piece)
                    offset += n
                sequence += 1
        columns = [np.array(c, np.int64) for c in zip(*out)]
        kept = rows.select(["doc_id", "source", "doc_tokens"]).take(pa.array(columns[0])).combine_chunks().to_batches()[0]
        more = [pa.array(values, pa.list_(pa.int32()))] if with_ids else []
        return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, columns[1:]), *more],
                                          names=["doc_id", "source", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come whole, one after the other, each by queue and place."""
        now, held = None, []
        for b in frames:
            blocks = b.column(b.schema.get_field_index("block")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for x, y in zip(edges, edges[1:]):
                if y > x:
                    if blocks[x] != now:
                        if held:
                            yield pack(now, held)
                        now, held = int(blocks[x]), []
                    held.append(b.slice(x, y - x))
        if held:
            yield pack(now, held)
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: int = SIZE,
         least: int = LEAST, windows: int = WINDOWS, end_id: int = END_ID, id_bytes: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, source, doc_tokens, start, length, ids_crc32, sequence_id, offset, and the ids.

    ``tokenizer`` is the path of the vocabulary file, to be read by every task; ids fit in ``id_bytes`` bytes.
    """
    kind = np.dtype(f"<u{id_bytes}")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    key = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string"
    tokens = staged(rows.mapInArrow(handed_back(_tokenize(tokenizer, kind, end_id)), f"{key}, part int, n long, at long, ids binary"), "packing-tokens")

    # where each (partition, source) begins in its queue, and which part of all tokens each queue is
    parts = staged(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-parts")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = parts.groupBy("source").agg(F.sum("n").alias("n"))
    shares = staged(sums.select("source", F.sum("n").over(order).alias("high"), (F.sum("n").over(order) - F.col("n")).alias("low"),
                                F.sum("n").over(Window.partitionBy()).alias("total")), "packing-shares")
    places = staged(parts.alias("p").join(shares.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
                    .select("p.part", F.col("p.source").alias("name"), "base", "low", "high", "total"), "packing-places")
    placed = tokens.alias("t").join(places.alias("p"), (F.col("t.part") == F.col("p.part")) & F.col("t.source").eqNullSafe(F.col("p.name"))).select(
        "doc_id", "source", "n", (F.col("at") + F.col("base")).alias("at"), "ids", "low", "high", "total")
    cut = placed.mapInArrow(handed_back(_split(size, windows, id_bytes)), f"{key}, doc_tokens long, block long, queue long, place long, start long, length long, ids binary")
    blocks = (shares.agg(F.max("total")).first()[0] or 0) // (size * windows) + 1
    ordered = cut.repartition(-(-blocks // BLOCKS_PER_TASK), "block").sortWithinPartitions("block", "queue", "place")
    out = ordered.mapInArrow(handed_back(_fill(size, least, windows, kind, with_ids)), f"{key}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, "
                             "offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("doc_id", id_col)
