"""Findings made elsewhere: entity tables, dictionaries of names and places, analyzers."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskwright.functions import bloom, phrases
from maskwright.functions.expr import computed_once, empty_array, free_for, ident, let, running, valid_utf8
from maskwright.operators.detect import SPAN_TYPE
from maskwright.rules import ENTITY_REPLACEMENTS, PRIORITIES, SKIPPED_ENTITIES, Detector

def _entity_spans(found: Column, text: Column) -> Column:
    """Entities (entity_type, start, end, score) of a text as spans.

    Known entities get their usual replacement, others their name in brackets; addresses are left to the network rules.
    """
    usual = F.create_map(*[F.lit(x) for pair in ENTITY_REPLACEMENTS.items() for x in pair])

    def span(e: Column) -> Column:
        start, end = e["start"].cast("int"), e["end"].cast("int")
        return F.struct(
            start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("original"),
            F.coalesce(usual[e["entity_type"]], F.concat(F.lit("["), e["entity_type"], F.lit("]"))).alias("replacement"),
            F.lit("pii").alias("category"), F.lower(e["entity_type"]).alias("label"), e["score"].cast("double").alias("confidence"))

    own = F.filter(found, lambda e: ~e["entity_type"].isin(*SKIPPED_ENTITIES))
    return F.transform(own, span).cast(f"ARRAY<{SPAN_TYPE}>")


def attach_entities(df: DataFrame, key: str, text_col: str, entities: DataFrame,
                    into: str = "external") -> DataFrame:
    """Add a column of spans from an entity table ``(key, entity_type, start, end, score)``.

    The label is the lower-case entity, the category pii. Entities are reduced to one array per text; the
    join then moves the texts too, unless the entities are small enough to be broadcast.
    """
    per_text = entities.groupBy(key).agg(
        F.expr("sort_array(collect_list(struct(start, end, entity_type, score)))").alias("_mw_found"))
    spans = _entity_spans(F.col("_mw_found"), F.col("_mw_valid"))
    met = computed_once(free_for(df, into).join(per_text, key, "left"), "_mw_valid", valid_utf8(ident(text_col)))
    return met.withColumn(into, F.coalesce(spans, F.expr(empty_array(SPAN_TYPE)))).drop("_mw_found", "_mw_valid")


_WORD = "'[\\\\p{L}\\\\p{N}_]+'"


FEW_TERMS = 10_000
HELD_TERMS, HELD_BYTES = 1 << 19, 1 << 25


def dictionary_entities(df: DataFrame, key: str, text_col: str, terms: DataFrame, entity: str,
                        score: float = 0.85, few: int = FEW_TERMS, longest_only: bool = False, held: int = HELD_TERMS) -> DataFrame:
    """Occurrences of listed terms (names, places) in texts, as an entity table.

    ``terms`` has one column. Up to ``held`` terms of 32 MB together are held by tasks, which look up the phrases of a batch of texts
    at once; nothing is shuffled. With more terms a text becomes one narrow row per word and per term length in words,
    holding the phrase that starts there, and phrases are equi-joined to the terms; no text is
    shuffled. Spark broadcasts a list that is below its size threshold and shuffles a larger one, where
    AQE splits frequent phrases. Of more than ``few`` terms a Bloom filter of fixed size is built on the cluster, and
    only phrases that it lets through become rows: of a million terms, no more than a few in a thousand besides the occurrences.
    The filter decides what is moved, never the result, and so does the size of the list.

    Matching ignores case; a term of several words must be written with the same separators. With ``longest_only``, of
    occurrences that begin at the same word only the longest is returned.
    """
    term = F.lower(F.col(terms.columns[0]))
    listed = (
        terms.select(F.regexp_extract(term, r"[\p{L}\p{N}_](?:.*[\p{L}\p{N}_])?", 0).alias("phrase"))
        .where("phrase <> ''").distinct()
        .withColumn("words", F.expr(f"size(regexp_extract_all(phrase, {_WORD}, 0))"))
    )
    n_terms, n_bytes, sizes = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)), F.sort_array(F.collect_set("words"))).first()
    lengths = f"CAST(array({', '.join(map(str, sizes))}) AS ARRAY<INT>)"

    ends = running("zip_with(v_w, slice(v_g, 1, size(v_w)), (v_m, v_s) -> length(v_s) + length(v_m))",
                   "0", "v_l + v_r")
    phrase = """array_join(transform(sequence(v_i, v_i + v_n - 1),
        v_j -> concat(if(v_j = v_i, '', get(v_g, v_j)), get(v_w, v_j))), '')"""
    rows = f"""flatten(transform(v_w, (v_m, v_i) -> transform(
        filter({lengths}, v_n -> v_i + v_n <= size(v_w)),
        v_n -> {let('v_ph', phrase, "named_struct('start', get(v_ends, v_i) - length(v_m),"
                    " 'len', length(v_ph), 'phrase', lower(v_ph))")})))"""
    x = "v_text"
    found = let("v_text", valid_utf8(ident(text_col)), let("v_w", f"regexp_extract_all({x}, {_WORD}, 0)", let(
        "v_g", f"split({x}, {_WORD}, -1)", let("v_ends", ends, rows))))
    texts = df.where(F.col(text_col).isNotNull())
    in_tasks = None
    if n_terms <= held and n_bytes <= HELD_BYTES:
        in_tasks = phrases.Phrases.of(pa.array([r.phrase for r in listed.select("phrase").toLocalIterator()], pa.string()), sizes)
    if in_tasks:
        # words of other letters than ASCII are told by the JVM; for the others an empty array, as Spark takes ever longer to measure a batch of null ones
        none = empty_array("STRUCT<start: INT, len: INT, phrase: STRING>")
        plain = f"octet_length({ident(text_col)}) = length({ident(text_col)})"
        own = texts.select(key, F.expr(f"if({plain}, {ident(text_col)}, NULL)").alias("_mw_plain"), F.expr(f"if({plain}, {none}, {found})").alias("_mw_phrases"))
        looked_up = _held(df.sparkSession, in_tasks)(F.col("_mw_plain"), F.col("_mw_phrases"))
        met = computed_once(own, "_mw_found", looked_up).select(key, F.expr("inline(_mw_found)"))
    elif n_terms > few:
        table = bloom.build(listed.select(F.xxhash64("phrase").alias("h")))
        hashed = computed_once(texts.select(key, F.expr(found).alias("_mw_found")), "_mw_maybe", bloom.maybe_each(
            df.sparkSession, F.expr("transform(_mw_found, p -> xxhash64(p.phrase))"), table))
        found = "filter(_mw_found, (p, i) -> get(_mw_maybe, i))"
        texts = hashed
    if not in_tasks:
        met = texts.select(key, F.expr(f"inline({found})")).join(listed, "phrase")
    if longest_only:
        met = met.groupBy(key, "start").agg(F.max("len").alias("len"))
    return (
        met.select(key, F.lit(entity).alias("entity_type"), "start",
                (F.col("start") + F.col("len")).alias("end"), F.lit(float(score)).alias("score"))
    )


def _held(spark: SparkSession, listed: phrases.Phrases):
    """A function from texts and the phrases of others to the places of listed phrases."""
    shared = spark.sparkContext.broadcast(listed)

    @F.arrow_udf("ARRAY<STRUCT<start: INT, len: INT>>")
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hasher = phrases.Hasher()
        for texts, others in batches:
            yield phrases.found_lists(shared, texts, others, hasher)

    return look_up


_ENTITY_TYPE = "STRUCT<entity_type: STRING, start: INT, end: INT, score: DOUBLE>"


def analyzer(factory: Callable[[], object], language: str = "en", on_error: str = "skip") -> Detector:
    """A detector around a text analyzer object with ``analyze(text=..., language=...)``.

    The worker only asks the analyzer, made once per Python worker; what its entities mean is decided by
    the expression that also reads entity tables. With ``on_error="skip"`` a text that the analyzer
    cannot handle, or an analyzer that cannot be imported, gives no entities; ``"raise"`` fails the job.
    """
    if on_error not in ("skip", "raise"):
        raise ValueError(f"on_error must be 'skip' or 'raise', not {on_error!r}")

    @F.pandas_udf(f"ARRAY<{_ENTITY_TYPE}>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine, tolerated = None, Exception if on_error == "skip" else ()
        with contextlib.suppress(ImportError if on_error == "skip" else ()):
            engine = factory()

        def entities(text: str) -> list[dict]:
            found = []
            if text and engine:
                with contextlib.suppress(tolerated):
                    found = [dict(entity_type=e.entity_type, start=e.start, end=e.end, score=e.score)
                             for e in engine.analyze(text=text, language=language)]
            return found

        yield from (texts.map(entities, na_action="ignore") for texts in batches)

    return Detector("pii", lambda text: _entity_spans(ask(text), text), PRIORITIES["pii"])
