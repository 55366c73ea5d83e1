"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is a number of words. Its rate (target by size) gives every document the same expected number of copies:
the whole part of the rate is allotted to all of them with certainty, and the rest is an inclusion probability ``p``.
Documents are ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, with ``u`` hashed from id and
text, and the sample is the lowest ranks up to the words still due. The size is fixed in words: a document that does not fit into
what is left is passed over, and the ranks after it are gone through in the same way, until none fits. Last, the smallest
document left is added if that brings the words nearer to the target. Every such round ends at a document larger than what it
leaves, so that rounds grow with the logarithm of a document's size.

No source is ordered as a whole: words are summed by ``2**BIN_BITS`` ranges of the random number, and only documents in the
range where a round ends are ordered. What remains is one row per source with the runs of ranks taken and the largest size
in each, so that texts are marked in place and never shuffled.

Defined results: a null text has size 0; a null source is a source of its own, the last; sources come by code point. Documents
with size 0 are copied by the whole part and by rank like others, up to the first document that does not fit. Rows that repeat id, text and source have one rank and are
taken together. Without any words all targets are 0 and nothing is taken. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from maskwright.llm.common import free_name, staged, text_or_empty

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST_COPIES = 2
BIN_BITS = 12


def words(text: Column) -> Column:
    """Number of words: runs of anything but space and the five control characters next to tab."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def _rank(id_col: str, text: Column, seed: int) -> Column:
    """63 random bits of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text), 1)


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to a table of one row per source (source, source_size).

    Sources share ``total`` times all words by weight; none gets more than ``most`` times its size, and what that frees is
    shared again. That is one water level: with sources in order of limit by weight, the level is the largest of the
    levels that follow from holding the first 0, 1, 2, ... sources at their limits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    limit = F.col("source_size") * most
    by_limit = Window.orderBy(limit / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("w").over(after)
    return (weighted.withColumn("level", level).withColumn("level", F.max("level").over(everything))
            .withColumn("target", F.least(F.col("level") * F.col("w"), limit.cast("double"))).drop("level", "w"))


def _round(narrow: DataFrame) -> DataFrame:
    """From (source, size, k, p, gap) to one row per source: last_k, the last rank while they fit; upto, the words up to it; and
    next_k, the rank that does not fit, if there is one."""
    narrow = narrow.withColumn("bin", F.shiftright("k", 63 - BIN_BITS))
    # words before each range of random numbers, and the range in which the gap ends
    bins = narrow.groupBy("source", "bin", "gap").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = staged(bins.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).where("before <= gap")
                  .groupBy("source").agg(F.max(F.struct("bin", "before")).alias("e")).select("source", "e.*"), "mixing-ends")
    # within that range: documents by odds over odds, while they fit
    u = (F.col("k") + 0.5) / F.lit(2.0**63)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    last = (narrow.alias("n").join(ends.alias("e"), F.col("n.source").eqNullSafe(F.col("e.source")) & (F.col("n.bin") == F.col("e.bin")))
            .select("n.source", "size", "k", "gap", "before", q.alias("q")))
    in_order = Window.partitionBy("source").orderBy("q", "k")  # rows of one rank count together
    upto, fits = F.col("upto"), F.col("upto") <= F.col("gap")
    fitted = (last.withColumn("upto", F.col("before") + F.sum("size").over(in_order)).groupBy("source")
              .agg(F.max(F.when(fits, F.col("k"))).alias("k"), F.max(F.when(fits, upto)).alias("upto"), F.min(F.when(~fits, F.col("k"))).alias("next_k")))
    start = F.shiftleft(F.col("bin").cast("long"), 63 - BIN_BITS) - 1
    return ends.alias("e").join(fitted.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source")), "left").select(
        "e.source", F.coalesce("f.k", start).alias("last_k"), F.coalesce("f.upto", "e.before").alias("upto"), "next_k")


def _drawn(k: Column, size: Column, last_k: Column, runs: Column) -> Column:
    return (k <= last_k) | F.exists(runs, lambda r: (k > r["after"]) & (k <= r["last"]) & (size > 0) & (size <= r["most"]))


def plan(rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """From (source, size, k) to one row per source: source_size, target, whole, last rank taken of the first round, and runs of the
    later ones: documents with ranks above ``after`` up to ``last``, of ``most`` words at most."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = staged(targets(sizes, weights, total, most).withColumn("whole", F.floor(rate))
                  .withColumn("p", rate - F.col("whole"))
                  .withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")), "mixing-targets")

    def of_source(state: DataFrame, where: str) -> DataFrame:
        return rows.alias("r").join(state.where(where).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))

    def joined(state: DataFrame, found: DataFrame, *columns: Column) -> DataFrame:
        kept = [F.col(f"s.{c}") for c in ("source", "source_size", "target", "whole", "p")]
        return staged(state.alias("s").join(found.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(*kept, *columns), "mixing-cuts")

    cuts = _round(of_source(goal, "p > 0").select("r.source", "size", "k", "p", "gap"))
    left = (F.col("s.gap") - F.coalesce("c.upto", F.lit(0))).alias("gap")
    state = joined(goal, cuts, left, F.coalesce("c.last_k", F.lit(-1)).alias("last_k"), F.col("c.next_k").alias("next_k"),
                   F.array().cast("array<struct<after:bigint,last:bigint,most:double>>").alias("runs"))
    while not (open_ := state.where("gap >= 1 and next_k is not null")).isEmpty():
        cuts = _round(of_source(open_, "true").where("size > 0 and size <= gap and k > next_k").select("r.source", "size", "k", "p", "gap"))
        taken = F.array(F.struct(F.col("s.next_k").alias("after"), F.col("c.last_k").alias("last"), F.col("s.gap").alias("most")))
        state = joined(state, cuts, left, F.col("s.last_k").alias("last_k"), F.col("c.next_k").alias("next_k"),
                       F.when(F.col("c.upto") > 0, F.concat("s.runs", taken)).otherwise(F.col("s.runs")).alias("runs"))
    # now all that is left is larger than the gap
    over = (of_source(state, "gap >= 1 and p > 0").where("r.size > 0 and r.size < 2 * gap").where(~_drawn(F.col("r.k"), F.col("r.size"), F.col("last_k"), F.col("runs")))
            .groupBy("r.source", "r.k", "gap").agg(F.sum("size").alias("size")).where("size < 2 * gap")
            .groupBy("source").agg(F.min(F.struct("size", "k")).alias("b")))
    one = F.array(F.struct((F.col("c.b.k") - 1).alias("after"), F.col("c.b.k").alias("last"), F.col("c.b.size").cast("double").alias("most")))
    state = joined(state, over, F.col("s.last_k").alias("last_k"), F.when(F.col("c.b").isNull(), F.col("s.runs")).otherwise(F.concat("s.runs", one)).alias("runs"))
    return state


def _copies(k: Column, size: Column, c) -> Column:
    """``c`` gives the columns of the plan."""
    return (c("whole") + ((c("p") > 0) & _drawn(k, size, c("last_k"), c("runs"))).cast("long")).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(text).alias("size"),
                       _rank(id_col, text, seed).alias("k"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
               weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (size times copies)."""
    rows = staged(_rows(docs, id_col, text_col, source_col, seed), "mixing-sizes")
    made = rows.alias("r").join(plan(rows, weights, total, most).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    made = made.withColumn("copies", _copies(F.col("k"), F.col("size"), F.col))
    return made.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
        weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with its columns."""
    rows = staged(_rows(docs, id_col, text_col, source_col, seed).select("source", "size", "k"), "mixing-sizes")
    chosen = plan(rows, weights, total, most)
    names = {c: free_name(docs, "_" + c) for c in ("k", "size", "p", "whole", "last_k", "runs", "source", "copy")}
    chosen = chosen.select(*[F.col(c).alias(names[c]) for c in ("p", "whole", "last_k", "runs", "source")])
    d = docs.withColumns({names["k"]: _rank(id_col, text_or_empty(text_col), seed), names["size"]: words(text_or_empty(text_col))})
    d = d.join(chosen, F.col(f"`{source_col}`").eqNullSafe(F.col(names["source"])))
    n = _copies(F.col(names["k"]), F.col(names["size"]), lambda c: F.col(names[c])).cast("int")
    return d.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(True), n))).select(*[f"`{c}`" for c in docs.columns])
