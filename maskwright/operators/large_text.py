"""Masking texts that are larger than a row: files of any size, read in ranges, with the result of masking them whole.

Spark's reader gives the lines of a file by byte ranges. Lines are put together to chunks, and a chunk may end only after a line end that
no match can cross: of the rules' patterns it is known how often a match can go on after blanks over line ends, so that many
non-blank lines around a place tell whether any match that begins before it ends behind it. Where a range of the file ends at a place
that is not safe, the chunks on both sides are put together. Within such chunks every rule finds what it finds in the whole text.
Detection cuts them further, after lines whose last character no match has before a line end.

Rules that hold any number of lines between a head and a tail, such as private keys, are not bound by that. They leave in each chunk a
summary for either case, no match being open at its beginning or one: what is found, and whether one is open at its end. A walk
over one small row per chunk and file then tells which case holds, and joins heads to tails.

Findings get places in the whole text, overlaps are resolved in the findings table (``resolve_table``), and each chunk is written with its
part of the spans: a span over several chunks is replaced where it begins and removed from the others.

Limits: a line is a row of Spark's reader. Rules that hold line ends otherwise, look for the beginning or end of the text, or may match
nothing, are refused with ``Unbounded``, and so are detectors and rule tables. Text that no safe place cuts stays one chunk. A byte order mark is no part of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskwright.functions.dialect import can_match_empty
from maskwright.functions.expr import valid_utf8
from maskwright.functions.lines import Bracket, Unbounded, before_line_ends, bracket, joins
from maskwright.operators.resolve_table import resolve_findings
from maskwright.plans.sanitize import Rules, raw_findings
from maskwright.rules import Rule, RuleSet
from maskwright.sources.scratch import shared_folder

CHUNK = 1 << 20  # characters of a chunk, about

_CHUNKS = "path STRING, block LONG, n INT, text STRING, bytes LONG, size LONG, head STRING, tail STRING"
_SPAN = "STRUCT<start: BIGINT, end: BIGINT>"


def _split(rules: list[Rule]) -> tuple[list[Rule], list[tuple[Rule, Bracket]], int]:
    """Rules for chunks, rules with open parts, and the lines around a place that tell whether it is safe."""
    inside, brackets, most = [], [], 0
    for r in rules:
        if can_match_empty(r.pattern):
            raise Unbounded(f"{r.pattern!r} may match nothing, which has no place of its own")
        try:
            most = max(most, joins(r.pattern))
            inside.append(r)
        except Unbounded:
            brackets.append((r, bracket(r.pattern)))
    return inside, brackets, most + 1


# ------------------------------------------------------------------ chunks
def crosses(patterns: list[re.Pattern], before: str, after: str) -> bool:
    """Whether any match that begins in ``before`` ends in ``after``, whatever was matched before it."""
    text, at = before + after, len(before)
    return any(m.end(1) > at for p in patterns for m in p.finditer(text, 0) if m.start() < at)


def _anywhere(rules: list[Rule]) -> list[re.Pattern]:
    """Patterns that find a match at every place, overlapping ones too; only of rules that can cross a line end."""
    out = []
    for r in rules:
        if joins(r.pattern):
            flags = re.match(r"\(\?[a-zA-Z]+\)", r.pattern)
            body = r.pattern[flags.end():] if flags else r.pattern
            out.append(re.compile(f"{flags.group() if flags else ''}(?=({body}))"))
    return out


def _around(lines: list[str], count: int, step: int) -> str:
    """The first (step 1) or last (step -1) lines that hold ``count`` non-blank ones."""
    out, full = [], 0
    for line in lines[::step]:
        out.append(line)
        full += bool(line.strip())
        if full >= count:
            break
    return "".join(out[::step])


def _chunker(rules: list[Rule], lines_around: int, size: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of one range after the other, in order, to chunks."""
        patterns = _anywhere(rules)
        names = [f.split()[0] for f in _CHUNKS.split(", ")]

        def chunk(key, n, lines):
            text = "".join(lines)
            row = (key[0], key[1], n, text, sum(raws), key[2], _around(lines, lines_around, 1) if n == 0 else None, _around(lines, lines_around, -1))
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, row)}, pa.schema([
                ("path", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("text", pa.string()), ("bytes", pa.int64()), ("size", pa.int64()),
                ("head", pa.string()), ("tail", pa.string())]))

        now, n, lines, raws, length, due = None, 0, [], [], 0, size
        for b in frames:
            for *key, value, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != now:
                    if lines:
                        yield chunk(now, n, lines)
                    now, n, lines, raws, length, due = key, 0, [], [], 0, size
                lines.append(value + "\n")
                raws.append(raw + 1)
                length += len(value) + 1
                while length >= due:
                    at = _safe_place(lines, lines_around, patterns)
                    if not at:
                        due = 2 * length
                        break
                    rest, rest_raws = lines[at:], raws[at:]
                    del lines[at:], raws[at:]
                    yield chunk(now, n, lines)
                    n, lines, raws, due = n + 1, rest, rest_raws, size
                    length = sum(map(len, lines))
        if lines:
            yield chunk(now, n, lines)
    return run


def _safe_place(lines: list[str], count: int, patterns: list[re.Pattern]) -> int:
    """The number of lines before the last safe place that has enough lines on both sides within reach; 0 if there is none."""
    full, at = 0, len(lines)
    while at > 1 and full < count:
        at -= 1
        full += bool(lines[at].strip())
    for place in range(at, max(0, at - 64), -1) if full >= count else ():
        if not patterns or not crosses(patterns, _around(lines[:place][-4096:], count, -1), _around(lines[place:], count, 1)):
            return place
    return 0


def read_chunks(spark: SparkSession, paths: str | list[str], rules: list[Rule], chunk: int = CHUNK) -> DataFrame:
    """Files as chunks (path, block, n, text), in order by block and n, that end where no match can cross. Written to the shared folder."""
    inside, _, around = _split(rules)
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.expr(valid_utf8("value")).alias("value"), F.octet_length("value").alias("raw"))
    path = shared_folder(spark, "large-chunks")
    raw.mapInArrow(_chunker(inside, around, chunk), _CHUNKS).write.parquet(path)
    chunks = spark.read.parquet(path)

    # seams between ranges: one light row per chunk, none of its text
    light = chunks.select("path", "block", "n", "bytes", "size", "head", "tail", F.length("text").cast("long").alias("chars"))
    order = Window.partitionBy("path").orderBy("block", "n")
    patterns = _anywhere(inside)

    @F.pandas_udf("boolean")
    def unsafe(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([bool(b) and bool(a) and crosses(patterns, b, a) for b, a in zip(before, after)])

    ends = Window.partitionBy("path")
    seams = light.withColumn("before", F.lag("tail").over(order)).withColumn("total", F.sum("bytes").over(ends)).withColumn(
        "last", F.lead("n").over(order).isNull())
    few = f"size(filter(split(tail, '\\n'), l -> trim(l) <> '')) < {around}"  # a chunk too short to tell: with its neighbour
    joined = seams.withColumn("joined", F.when(F.col("n") == 0, F.coalesce(unsafe("before", "head"), F.lit(False)) | (F.col("before").isNotNull() & (
        F.expr(few) | F.expr(few.replace("tail", "before"))))).otherwise(F.lit(False)))
    named = joined.withColumn("first", F.when(~F.col("joined"), F.struct("block", "n"))).withColumn(
        "first", F.last("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the last line end is not in the file where the lines have a byte more than it; a byte order mark is three less
    several = F.count("*").over(Window.partitionBy("path", "first")) > 1
    cut = named.withColumn("several", several).withColumn("bare", F.col("last") & (F.col("total") - F.col("size")).isin(1, -2)).select(
        "path", "block", "n", F.col("first.block").alias("to_block"), F.col("first.n").alias("to_n"), "bare", "several")
    moved = chunks.select("path", "block", "n", "text").join(cut, ["path", "block", "n"])
    text = F.when(F.col("bare"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    moved = moved.withColumn("text", text)
    whole = moved.where("several").groupBy("path", "to_block", "to_n").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("t"))
    out = whole.select("path", F.col("to_block").alias("block"), F.col("to_n").alias("n"), F.expr("array_join(transform(t, x -> x.text), '')").alias("text"))
    out = moved.where("not several").select("path", "block", "n", "text").unionByName(out)
    path = shared_folder(spark, "large-chunks")
    out.write.parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ rules with open parts
def _scan(x: str, at: int, least: int, head: re.Pattern, stop: re.Pattern, tail: re.Pattern) -> tuple[list[tuple[int, int]], int | None]:
    """Matches from ``at`` on, and where the first head stands that no stop follows."""
    found, s = [], None
    while h := head.search(x, at):
        if s is None or s.start() < h.end():
            s = stop.search(x, h.end())
            if s is None:
                return found, h.start()
        t = tail.match(x, s.start()) if s.start() >= h.end() + least else None
        if t:
            found.append((h.start(), t.end()))
        at = t.end() if t else h.start() + 1
    return found, None


def _summaries(brackets: list[tuple[Rule, Bracket]]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(b.least, *map(re.compile, (b.head, b.stop, b.tail))) for _, b in brackets]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in frames:
            out = {k: [] for k in ("row", "rule", "free", "free_open", "stopped", "closed", "held", "held_open")}
            for row, x in enumerate(batch.column(3).to_pylist()):
                for k, (least, head, stop, tail) in enumerate(compiled):
                    free, free_open = _scan(x, 0, least, head, stop, tail)
                    first = stop.search(x)
                    end = tail.match(x, first.start()) if first else None  # the line end before it was part of the match
                    held, held_open = _scan(x, end.end(), least, head, stop, tail) if end else (free, free_open)
                    values = (row, k, free, free_open, first is not None, end.end() if end else None, held, held_open)
                    for name, v in zip(out, values):
                        out[name].append([{"start": s, "end": e} for s, e in v] if isinstance(v, list) else v)
            rows = batch.select([0, 1, 2]).take(pa.array(out.pop("row"), pa.int64()))
            types = (pa.int32(), span, pa.int64(), pa.bool_(), pa.int64(), span, pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, t) for v, t in zip(out.values(), types)]], names=["path", "block", "n", *out])
    return run


_SUMMARY = (f"path STRING, block LONG, n INT, rule INT, free ARRAY<{_SPAN}>, free_open LONG, stopped BOOLEAN, closed LONG,"
            f" held ARRAY<{_SPAN}>, held_open LONG")


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """One rule in one file, chunk by chunk: spans in places of the whole text."""
    out, open_at = [], None
    for r in rows.sort_values(["block", "n"]).itertuples():
        found, left = (r.free, r.free_open) if open_at is None else (r.held, r.held_open)
        if open_at is not None and not r.stopped:
            continue
        if open_at is not None and not pd.isna(r.closed):
            out.append((open_at, r.offset + int(r.closed)))
        out += [(r.offset + s["start"], r.offset + s["end"]) for s in found]
        open_at = None if left is None or pd.isna(left) else r.offset + int(left)
    return pd.DataFrame({"path": rows["path"].iloc[0], "rule": rows["rule"].iloc[0], "start": [s for s, _ in out], "end": [e for _, e in out]})


# ------------------------------------------------------------------ masking
def _pieces(rules: list[Rule]):
    """Chunks cut at the line ends that no match can cross, as the last character before them tells, so that gates close on most pieces."""
    crossed = np.ones(256, bool)
    crossed[:128] = False
    for r in rules:
        crossed[[*before_line_ends(r.pattern)]] = True
    blank = np.zeros(256, bool)
    blank[[*range(9, 14), *range(28, 33)]] = True

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row, text in enumerate(batch.column(3)):
                held = text.as_buffer()
                data = np.frombuffer(held, np.uint8)
                full = np.flatnonzero(~blank[data])
                ends = np.flatnonzero(data == 10) + 1
                before = np.searchsorted(full, ends) - 1  # a line end after blanks alone is not cut
                safe = ends[(before >= 0) & ~crossed[data[full[before]]]] if len(full) else ends[:0]
                offsets = np.unique(np.concatenate([[0], safe, [len(data)]])).astype(np.int32)
                texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), held)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets[:-1]]
                keys = [pa.array([batch.column(i)[row].as_py()] * len(texts), batch.column(i).type) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(chars, pa.int64()), texts], names=["path", "block", "n", "at", "text"])
    return run


def _spliced(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their spans, disjoint and in order, written anew."""
    for batch in frames:
        clean = []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            out, at = [], 0
            for s in spans or ():
                out += (text[at:s["start"]], s["replacement"])
                at = s["end"]
            clean.append("".join(out) + text[at:] if out else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.string()), batch.column(4)], names=["path", "seq", "clean_text", "n_spans"])


def large_findings(chunks: DataFrame, rules: list[Rule], min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Kept spans (path, start, end, replacement, category, label, confidence) in places of the whole text, and the places of the chunks."""
    spark = chunks.sparkSession
    ranked = {id(r): i for i, r in enumerate(RuleSet(tuple(rules)).ordered())}
    inside, brackets, _ = _split([r for r in rules if r.confidence >= min_confidence])
    order = Window.partitionBy("path").orderBy("block", "n")
    path = shared_folder(spark, "large-places")
    light = chunks.select("path", "block", "n", F.length("text").cast("long").alias("chars"))
    light.withColumn("seq", F.row_number().over(order)).withColumn(
        "offset", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")).write.parquet(path)
    places = spark.read.parquet(path)

    keys = ["path", "block", "n"]
    columns = ("path", "start", "end", "replacement", "category", "label", "confidence", "rank")
    parts = []
    if inside:
        pieces = chunks.select(*keys, "text").mapInArrow(_pieces(inside), "path STRING, block LONG, n INT, at LONG, text STRING")
        found = raw_findings(pieces, [*keys, "at"], "text", inside, rank=True).join(places, keys).withColumn("offset", F.col("offset") + F.col("at"))
        # ranks among the rules for chunks, to ranks among all
        to_all = F.element_at(F.array(*[F.lit(ranked[id(r)]) for r in RuleSet(tuple(inside)).ordered()]), F.col("rank") + 1)
        parts.append(found.select("path", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"),
                                  *columns[3:7], to_all.alias("rank")))
    if brackets:
        walked = (chunks.select(*keys, "text").mapInArrow(_summaries(brackets), _SUMMARY).join(places, keys)
                  .groupBy("path", "rule").applyInPandas(_walk, "path STRING, rule INT, start LONG, end LONG"))
        table = spark.createDataFrame([(k, r.replacement, r.category, r.label, float(r.confidence), ranked[id(r)]) for k, (r, _) in enumerate(brackets)],
                                      "rule INT, replacement STRING, category STRING, label STRING, confidence DOUBLE, rank INT")
        parts.append(walked.join(F.broadcast(table), "rule").select(*columns))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return resolve_findings(found, ["path"], "rank").drop("rank"), places


def mask_large_files(spark: SparkSession, paths: str | list[str], rules: Rules = None, min_confidence: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Masked files as (path, seq, clean_text, n_spans): the pieces of a file in the order of ``seq`` are its masked text.

    ``n_spans`` counts the spans that begin in the piece. An empty file has no pieces. The texts move once, to the spans of their chunk.
    """
    ruleset = RuleSet.of(rules)
    if ruleset.detectors or ruleset.tables:
        raise Unbounded("detectors and rule tables may look at any part of a text")
    listed = list(ruleset.rules)
    chunks = read_chunks(spark, paths, [r for r in listed if r.confidence >= min_confidence], chunk)
    kept, places = large_findings(chunks, listed, min_confidence)

    # the chunks that a span touches: from the one it begins in, until one reaches its end
    at = places.select("path", "seq", "block", "n", "offset", "chars")
    path = shared_folder(spark, "large-spans")
    width = F.lit(CHUNK)
    reach = at.withColumn("cell", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("chars")) / width))))
    cells = kept.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    met = cells.alias("s").join(reach.alias("c"), ["path", "cell"]).where(
        (F.col("start") < F.col("offset") + F.col("chars")) & (F.col("end") > F.col("offset"))).drop("cell").distinct()
    begins = F.col("start") >= F.col("offset")
    local = F.struct(F.greatest(F.col("start") - F.col("offset"), F.lit(0)).cast("int").alias("start"),
                     F.least(F.col("end") - F.col("offset"), F.col("chars")).cast("int").alias("end"),
                     F.lit("").alias("original"), F.when(begins, F.col("replacement")).otherwise(F.lit("")).alias("replacement"))
    spans = met.groupBy("path", "block", "n").agg(F.array_sort(F.collect_list(local)).alias("spans"), F.sum(begins.cast("int")).alias("n_spans"))
    spans.write.parquet(path)
    spans = spark.read.schema(spans.schema).parquet(path)
    out = chunks.join(at.select("path", "block", "n", "seq"), ["path", "block", "n"]).join(spans, ["path", "block", "n"], "left")
    rows = out.select("path", "seq", "text", "spans", F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
    return rows.mapInArrow(_spliced, "path STRING, seq INT, clean_text STRING, n_spans LONG")
