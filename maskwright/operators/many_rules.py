"""Thousands of user rules: rules as a table, and an automaton that tells which of them a text may match.

A rule of a ``RuleTable`` is data, not part of the plan. From its pattern the literals are read of which every match holds one; an
Aho-Corasick automaton over the literals of all rules, built once per Python worker, runs over each text once and returns the rules
worth trying, whatever their number. Their patterns then run in the row, on the JVM as column patterns, or with Python's matcher
where Java's differs. Rules whose pattern needs no literal are tried on every text. The plan has the same size for any number of rules, is
narrow, and its result equals that of listing the rules one by one.

Tasks hold ``SLICE`` rules at most. A larger table stays on the cluster: the windows of a text that may be literals, as a Bloom filter of
fixed size tells, are joined by their hashes to the literals of the rules, and the rules so found are joined to the texts by a hash of the
text. That takes one pass over the texts for any number of rules, and two shuffles; the texts are read twice, so they must be the same both
times. What the join finds too much (hashes are equal by chance, too) is tried in vain; rules without literals are tried on every text, by
slices. A stream, which knows no such join, takes the whole table in slices, each with its own automaton and its own pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskwright.functions import bloom, windows
from maskwright.functions.dialect import can_match_empty, java_pattern, runs_on_jvm
from maskwright.functions.expr import empty_array, free_for, let, lit
from maskwright.functions.literals import folded, required_literals
from maskwright.rules import PRIORITIES, Rule
from maskwright.sources.patterns import DEFAULTS
from maskwright.sources.scratch import shared_folder

SLICE = 50_000
LONGEST_PATTERN = 10_000  # characters; bounds a slice together with SLICE

_FOUND = "ARRAY<STRUCT<ord: INT, nc: DOUBLE, rep: STRING, cat: STRING, lab: STRING, java: STRING, python: STRING>>"
_PREPARED = "place LONG, pattern STRING, replacement STRING, label STRING, confidence DOUBLE, java STRING, literals ARRAY<STRING>, hashes ARRAY<LONG>, sizes ARRAY<INT>"
_RULE = "named_struct('ord', int({first} + rank), 'nc', -confidence, 'rep', replacement, 'cat', {cat}, 'lab', label, 'java', java, 'python', if(java IS NULL, pattern, NULL))"


def _prepare(on_error: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            rows = b.to_pylist()
            for r in rows:
                try:
                    re.compile(r["pattern"])
                    if len(r["pattern"]) > LONGEST_PATTERN:
                        raise ValueError(f"a pattern of {len(r['pattern'])} characters")
                    r |= {"java": java_pattern(r["pattern"]) if runs_on_jvm(r["pattern"]) else None,
                          "literals": None if can_match_empty(r["pattern"]) else required_literals(r["pattern"])}
                except (re.error, TypeError, ValueError):
                    if on_error == "raise":
                        raise
                    r |= {"pattern": None, "java": None, "literals": None}
                r |= {"hashes": [windows.literal_hash(x) for x in r["literals"] or ()], "sizes": [windows.window_size(x) for x in r["literals"] or ()]}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("place", pa.int64()), *((c, pa.string()) for c in ("pattern", "replacement", "label")), ("confidence", pa.float64()),
                ("java", pa.string()), ("literals", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]))
    return run


def prepared_rules(rules: DataFrame, order: str, on_error: str = "raise") -> DataFrame:
    """The rule table with what detection needs: Java spelling, literals and their hashes, read by tasks, one row per rule.

    ``rules`` has ``pattern`` and may have ``replacement``, ``label`` and ``confidence``; missing or null ones have their defaults.
    ``order`` names the column whose ascending order is the order of the rules. ``on_error="drop_all"``: one bad pattern empties
    the whole set; ``"raise"`` reports it.
    """
    if on_error not in ("raise", "drop_all"):
        raise ValueError(f"on_error must be 'raise' or 'drop_all', not {on_error!r}")

    def value(name: str, kind: str) -> Column:
        given = F.col(name).cast(kind) if name in rules.columns else F.lit(None).cast(kind)
        return F.coalesce(given, F.lit(DEFAULTS[name])).cast(kind).alias(name)

    rows = rules.select(F.col(order).cast("long").alias("place"), "pattern", value("replacement", "string"), value("label", "string"), value("confidence", "double"))
    return rows.mapInArrow(_prepare(on_error), _PREPARED)


@dataclass(frozen=True)
class RuleTable:
    """User rules held as data, for ``sanitize`` and its like beside or instead of listed rules."""

    slices: tuple[tuple, ...] = field(repr=False)  # of rows (place, pattern, replacement, label, confidence, java, literals, rank)
    category: str = "custom"
    priority: int = PRIORITIES["custom"]
    joined: JoinedRules | None = field(default=None, repr=False)  # the rules that are not in the slices

    @classmethod
    def of(cls, spark: SparkSession, rules: DataFrame | Iterable[Rule], order: str = "rule_ord", on_error: str = "raise",
           category: str = "custom", priority: int = PRIORITIES["custom"], slice_rules: int = SLICE) -> RuleTable:
        """From a table of rules with an ``order`` column, or from listed rules, in their order. Two rules at one place are an error."""
        if not isinstance(rules, DataFrame):
            rules = spark.createDataFrame([(i, r.pattern, r.replacement, r.label, float(r.confidence)) for i, r in enumerate(rules)],
                                          f"{order} LONG, pattern STRING, replacement STRING, label STRING, confidence DOUBLE")
        unclear = f"{order} must be given and differ between rules"
        if (n := rules.count()) > slice_rules:
            joined = JoinedRules.of(spark, rules, n, order, on_error, unclear, slice_rules)
            if joined is None:
                return cls((), category, priority)
            rows = joined.rows("literals IS NULL")
            return cls(_cut(rows, slice_rules), category, priority, joined)
        prepared = prepared_rules(rules, order, on_error)
        rows = sorted((tuple(r) for r in prepared.drop("hashes", "sizes").toLocalIterator()), key=lambda r: r[0])
        if any(r[1] is None for r in rows):
            rows = []
        if any(a[0] == b[0] for a, b in zip(rows, rows[1:])) or any(r[0] is None for r in rows):
            raise ValueError(unclear)
        return cls(_cut([(*r, i) for i, r in enumerate(rows)], slice_rules), category, priority)

    def __len__(self) -> int:
        return self.joined.n if self.joined else sum(map(len, self.slices))

    def sliced(self) -> RuleTable:
        """The same with every rule in a slice."""
        if self.joined is None:
            return self
        return RuleTable(_cut(self.joined.rows("true"), self.joined.slice_rules), self.category, self.priority)

    # ------------------------------------------------------------------ detection
    def opened(self, spark: SparkSession, text: Column, number: int, first: int, min_confidence: float = 0.0) -> Column:
        """The rules of one slice that a text may match, as data; ``first`` is the rank of the table's first rule."""
        rows = [(first + r[7], -r[4], r[2], self.category, r[3], r[5], None if r[5] else r[1], r[6])
                for r in self.slices[number] if r[4] >= min_confidence]
        shared = spark.sparkContext.broadcast(rows)

        @F.arrow_udf(_FOUND)
        def worth_trying(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = _automaton(shared)
            names = ("ord", "nc", "rep", "cat", "lab", "java", "python")
            kind = pa.list_(pa.struct([("ord", pa.int32()), ("nc", pa.float64()), *((n, pa.string()) for n in names[2:])]))
            for texts in batches:
                yield pa.array([[dict(zip(names, shared.value[k])) for k in find(t.as_py())] for t in texts], kind)

        return worth_trying(text)

    def with_opened(self, df: DataFrame, text: str, into: str, first: int, min_confidence: float = 0.0) -> DataFrame:
        """Add the joined rules that a text may match, as data. ``text`` is an SQL expression."""
        sizes, shared = self.joined.sizes, df.sparkSession.sparkContext.broadcast(self.joined.table)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in frames:
                rows, found = windows.maybe_held(b.column(1), shared.value, sizes)
                # a text's own repeats; those of equal texts fall together when its rules are collected
                order = np.lexsort((found, rows))
                rows, found = rows[order], found[order]
                new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])[:len(rows)]
                rows, found = rows[new], found[new]
                keys = b.column(0).to_numpy(zero_copy_only=False)[rows]
                for at in range(0, len(keys), _PAIRS):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + _PAIRS]), pa.array(found[at:at + _PAIRS])], ["key", "h"])

        key = f"if(({text}) IS NULL, NULL, xxhash64({text}))"
        met = df.select(F.expr(key).alias("key"), F.expr(text).alias("text")).where("text <> ''").mapInArrow(run, "key LONG, h LONG")
        rule = _RULE.format(first=first, cat=lit(self.category))
        rules = self.joined.rules.where("literals IS NOT NULL").where(F.col("confidence") >= min_confidence)
        found = met.join(rules.select(F.explode(F.array_distinct("hashes")).alias("h"), F.expr(rule).alias("rule")), "h")
        per_text = found.groupBy(F.col("key").alias("_mw_key")).agg(F.sort_array(F.collect_set("rule")).alias(into))
        none = F.expr(f"CAST(array() AS {_FOUND})")
        return (free_for(df, into, "_mw_key").withColumn("_mw_key", F.expr(key)).join(per_text, "_mw_key", "left").drop("_mw_key")
                .withColumn(into, F.coalesce(F.col(into), none)))


_PAIRS = 1 << 16  # rows of a batch of windows
_PREPARED_AT_ONCE = 5_000  # rules in a task


def _cut(rows: list[tuple], size: int) -> tuple[tuple, ...]:
    return tuple(tuple(rows[i:i + size]) for i in range(0, len(rows), size))


@dataclass(frozen=True, eq=False)
class JoinedRules:
    """Prepared rules that stay on the cluster, as files in the shared folder, each with its rank."""

    rules: DataFrame
    n: int
    needs_python: bool
    sizes: list[int]  # of the windows by which literals are known
    table: np.ndarray  # Bloom filter over their hashes
    slice_rules: int

    @classmethod
    def of(cls, spark: SparkSession, rules: DataFrame, n: int, order: str, on_error: str, unclear: str, slice_rules: int) -> JoinedRules | None:
        """None if a bad pattern empties the set. Reading a pattern takes a quarter of a millisecond, so tasks get some thousand each."""
        folder = shared_folder(spark, "rules")
        place = F.col(order).cast("long")
        prepared = prepared_rules(rules.repartitionByRange(-(-n // _PREPARED_AT_ONCE), place).sortWithinPartitions(place), order, on_error)
        # the rank of a rule: the sizes of the sorted partitions before its own, and its place there
        (prepared.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
         .write.parquet(folder))
        kept = spark.read.parquet(folder)
        n, bad, placed, different, python = kept.agg(
            F.count("*"), F.count_if(F.col("pattern").isNull()), F.count("place"), F.countDistinct("place"), F.count_if(F.col("java").isNull())).first()
        if bad:
            return None
        if placed < n or different < n:
            raise ValueError(unclear)
        before, starts = 0, []
        for part, size in sorted(tuple(r) for r in kept.groupBy("part").count().collect()):
            starts.append((part, before))
            before += size
        starts = spark.createDataFrame(starts, "part INT, start LONG")
        kept = kept.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")
        literals = kept.select(F.explode("sizes").alias("size")).distinct()
        table = bloom.build(kept.select(F.explode("hashes").alias("h")))
        return cls(kept, n, python > 0, sorted(r[0] for r in literals.collect()), table, slice_rules)

    def rows(self, condition: str) -> list[tuple]:
        """Rules as the slices of a ``RuleTable`` hold them."""
        found = self.rules.where(condition).select("place", "pattern", "replacement", "label", "confidence", "java", "literals", "rank")
        return sorted((tuple(r) for r in found.toLocalIterator()), key=lambda r: r[7])


@lru_cache(maxsize=4)
def _automaton(shared):
    """A function from a text to the numbers of the rules worth trying, in order. Built once per worker and table."""
    import ahocorasick

    rules = shared.value
    always = [k for k, r in enumerate(rules) if r[7] is None]
    by_literal: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for word in r[7] or ():
            by_literal.setdefault(word, []).append(k)
    automaton = ahocorasick.Automaton()
    for word, numbers in by_literal.items():
        automaton.add_word(word, numbers)
    if by_literal:
        automaton.make_automaton()

    def find(text: str | None) -> list[int]:
        if not text:
            return always if text == "" else []
        hit = {id(numbers): numbers for _, numbers in automaton.iter(folded(text))} if by_literal else {}
        return sorted({*always, *(k for numbers in hit.values() for k in numbers)})
    return find


def jvm_candidates(x: str, opened: str) -> str:
    """Candidates of the opened rules that Java's matcher can run, by patterns taken from the row."""
    from maskwright.operators.detect import CANDIDATE_TYPE, locate

    # one match whose text occurs once is where that is; otherwise the gaps tell, for which Java compiles the pattern again
    several = locate("v_m", f"split({x}, v_n.java, -1)", "v_n")
    once = """array(named_struct('nc', v_n.nc, 's', v_at - 1, 'nl', -length(get(v_m, 0)), 'ord', v_n.ord, 'e', v_at - 1 + length(get(v_m, 0)),
        'txt', get(v_m, 0), 'rep', v_n.rep, 'cat', v_n.cat, 'lab', v_n.lab))"""
    one = let("v_at", f"instr({x}, get(v_m, 0))", f"if(locate(get(v_m, 0), {x}, v_at + 1) = 0, {once}, {several})")
    found = let("v_m", f"regexp_extract_all({x}, v_n.java, 0)", f"""CASE WHEN size(v_m) = 0 THEN {empty_array(CANDIDATE_TYPE)}
        WHEN size(v_m) = 1 AND octet_length(get(v_m, 0)) > 0 THEN {one} ELSE {several} END""")
    return f"""CASE WHEN size({opened}) > 0 THEN flatten(transform(filter({opened}, v_n -> v_n.java IS NOT NULL), v_n -> {found}))
        ELSE {empty_array(CANDIDATE_TYPE)} END"""


def python_candidates(text: Column, opened: Column) -> Column:
    """Candidates of the opened rules that need Python's matcher; rows without any are not sent."""
    from maskwright.operators.detect import CANDIDATE_TYPE

    @F.pandas_udf(f"ARRAY<{CANDIDATE_TYPE}>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        compiled = lru_cache(maxsize=1024)(re.compile)

        def one(x, rules):
            return [] if x is None else [
                {"nc": r["nc"], "s": m.start(), "nl": m.start() - m.end(), "ord": r["ord"], "e": m.end(), "txt": m.group(), "rep": r["rep"],
                 "cat": r["cat"], "lab": r["lab"]} for r in rules for m in compiled(r["python"]).finditer(x)]

        for texts, rules in batches:
            yield pd.Series([one(x, r) for x, r in zip(texts, rules)])

    own = F.filter(opened, lambda r: r["python"].isNotNull())
    return find(F.when(F.size(own) > 0, text), own)
