"""Chat formatting by columnar byte assembly.

A turn becomes ``<|role|>``, newline, text, ``<|end|>``, newline; a conversation is its turns in order. Inside roles and texts
the three bytes that markers and escapes are made of are replaced by two: a backslash by ``\\b``, ``<`` by ``\\l``, ``>`` by
``\\g``. A formatted text thus holds ``<`` and ``>`` only in markers, and every backslash begins an escape, so that it reads
back exactly. The loss mask covers the escaped text of assistant turns.

A batch is assembled at once: segment lengths give cumulative offsets, offsets give scatter indices, and headers and contents are
copied into one buffer that is the values of the resulting Arrow column.

Turns are formatted where they are read. Only digests need a conversation in order: rows are sorted by conversation and turn
within tasks and streamed, so a conversation of any length takes constant memory, though one task, as its hash is one chain.

Defined results: null roles and texts count as empty; a null conversation is a conversation; null turns come first, and equal
turns by their formatted text. Repeated rows are repeated turns. A role is the assistant's if it is ``assistant`` exactly. Other
columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import handed_back, text_buffer

ASSISTANT = "assistant"
OPEN, CLOSE, END = b"<|", b"|>\n", b"<|end|>\n"
ESCAPES = {"\\": "\\b", "<": "\\l", ">": "\\g"}

_CODE = np.zeros(256, np.uint8)  # second byte of an escape, 0 where none is needed
for _byte, _escape in ESCAPES.items():
    _CODE[ord(_byte)] = ord(_escape[1])


class _Segment:
    """A column of strings to be escaped into a buffer."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffer(column)
        code = _CODE[self.data]
        self.where = np.flatnonzero(code)
        self.codes = code[self.where]
        extra = np.concatenate([np.zeros(1, np.int64), np.cumsum(code > 0)])
        self.extra = extra[:-1]  # escapes before each byte
        self.at_row = extra[self.offsets]
        self.lengths = np.diff(self.offsets) + np.diff(self.at_row)

    def copy_to(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Scatter each row's bytes so that it begins at ``starts``."""
        shift = np.repeat(starts - self.offsets[:-1] - self.at_row[:-1], np.diff(self.offsets))
        to = np.arange(len(self.data)) + self.extra + shift
        out[to] = self.data
        out[to[self.where]] = ord("\\")
        out[to[self.where] + 1] = self.codes


def _fill(out: np.ndarray, starts: np.ndarray, piece: bytes) -> None:
    for k, byte in enumerate(piece):
        out[starts + k] = byte


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted turns, and where the escaped text begins and ends in each, in code points."""
    roles, texts = _Segment(role), _Segment(text)
    lengths = len(OPEN) + roles.lengths + len(CLOSE) + texts.lengths + len(END)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    at = offsets[:-1]
    out = np.empty(offsets[-1], np.uint8)
    _fill(out, at, OPEN)
    at = at + len(OPEN)
    roles.copy_to(out, at)
    at = at + roles.lengths
    _fill(out, at, CLOSE)
    begin = at + len(CLOSE)
    texts.copy_to(out, begin)
    finish = begin + texts.lengths
    _fill(out, finish, END)
    formatted = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(out))
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    rows = points[offsets[:-1]]
    return formatted.cast(pa.string()), pa.array(points[begin] - rows), pa.array(points[finish] - rows)


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conversation, turn, formatted, loss_start, loss_end (code points in ``formatted``; equal: no loss)."""
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                                F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            role = b.column(2)
            formatted, start, end = assemble(role, b.column(3))
            learnt = np.array([r == ASSISTANT for r in role.to_pylist()], bool)
            start = start.to_numpy()
            end = np.where(learnt, end.to_numpy(), start)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), formatted, pa.array(start), pa.array(end)],
                                             names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])
    return rows.mapInArrow(handed_back(run), f"conv_id {types['conv_id']}, turn {types['turn']}, formatted string, loss_start long, loss_end long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted turns joined: conv_id, formatted, and the loss mask as (loss_start, loss_end) pairs in order."""
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("late"), "turn", "formatted", "loss_start", "loss_end"))).alias("t"))
    return parts.selectExpr(
        "conv_id", "concat_ws('', t.formatted) AS formatted",
        """aggregate(t, named_struct('at', 0L, 'mask', cast(array() AS array<struct<loss_start: bigint, loss_end: bigint>>)),
             (a, x) -> named_struct('at', a.at + length(x.formatted), 'mask', if(x.loss_end > x.loss_start,
               concat(a.mask, array(named_struct('loss_start', a.at + x.loss_start, 'loss_end', a.at + x.loss_end))), a.mask)),
             a -> a.mask) AS loss""")


def unescape(piece: str) -> str:
    return piece.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, body = formatted.removeprefix(OPEN.decode()).split(CLOSE.decode(), 1)
    return unescape(head), unescape(body.removesuffix(END.decode()))


def digest(turns: DataFrame) -> DataFrame:
    """Read formatted turns back: one row per conversation with the digests of its turns and of the text under the loss mask."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")
    ordered = ordered.select("conv_id", "formatted", "loss_start", "loss_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, begun = None, False
        turns_hash = loss_hash = None
        n = loss = chars = 0
        for b in frames:
            conv_type = b.schema.field(0).type
            for conv, formatted, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or conv != now:
                    if begun:
                        done.append((now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
                    now, begun, n, loss, chars = conv, True, 0, 0, 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(formatted)
                turns_hash.update(f"{role}\n{text}\n".encode())
                masked = unescape(formatted[start:end])
                loss_hash.update(masked.encode())
                n, loss, chars = n + 1, loss + len(masked), chars + len(formatted)
            if done:
                yield _table(done, conv_type, names)
                done = []
        if begun:
            yield _table([(now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars)], conv_type, names)
    return ordered.mapInArrow(handed_back(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _table(rows: list[tuple], conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
