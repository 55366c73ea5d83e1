"""The main plan: one narrow projection that adds spans, clean text and report to a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskwright.functions.expr import computed_once, empty_array, free_for, ident, joined, let, valid_utf8
from maskwright.operators import detect, many_rules
from maskwright.operators.redact import spliced
from maskwright.operators.report import report
from maskwright.operators.resolve import resolved_spans
from maskwright.rules import Detector, Rule, RuleSet

Rules = RuleSet | Iterable[Rule | Detector | many_rules.RuleTable] | None


def _prepared(df: DataFrame, text_col: str, rules: Rules, min_confidence: float, external: str | None,
              on_invalid: str = "replace", allowed: str | None = None) -> tuple[DataFrame, str, list[str]]:
    """The inputs of the candidate expression as helper columns, the expression, and their names.

    ``allowed`` is an expression for the numbers of the JVM rules that may run on a row.
    """
    ruleset = RuleSet.of(rules)
    jvm, python, detectors, tables = detect.rule_plan(ruleset, min_confidence)
    valid = valid_utf8(ident(text_col), on_invalid)
    if df.isStreaming:
        tables = [(first, held.sliced()) for first, held in tables]
    for first, rules_held in tables:
        if rules_held.joined:  # before anything is added to the rows that move
            df = rules_held.with_opened(df, valid, f"_mw_joined_{first}", first, min_confidence)
    df = df.withColumn("_mw_text", F.expr(valid))
    x, parts, dynamic, extra = "_mw_text", [], [], ["_mw_text"]
    if jvm:
        # Gates come first, in generated code; a text that passes none stops there.
        gated = detect.open_rules(x, "_mw_lower", jvm)
        df = (df.withColumn("_mw_lower", F.expr(detect.lower_text(x, jvm)))
              .withColumn("_mw_open", F.expr(f"array_intersect({gated}, {allowed})" if allowed else gated)))
        parts.append(detect.rule_candidates(x, "_mw_open", jvm))
        extra += ["_mw_lower", "_mw_open"]
    if python:
        # a text that opens no gate is not sent
        df = df.withColumn("_mw_python", detect.python_candidates(python)(F.expr(detect.gated_text(x, python))))
        parts.append("_mw_python")
        extra.append("_mw_python")
    for ord_, d in detectors:
        name = f"_mw_detector_{ord_}"
        df = df.withColumn(name, d.column(F.col(x)))
        dynamic.append(detect.span_to_candidate(f"coalesce({name}, {empty_array(detect.SPAN_TYPE)})",
                                                ord_, d.category))
        extra.append(name)
    for first, rules_held in tables:
        opened = [(f"_mw_joined_{first}", rules_held.joined.needs_python)] if rules_held.joined else []
        for number, held in enumerate(rules_held.slices):
            name = f"_mw_table_{first}_{number}"
            df = computed_once(df, name, rules_held.opened(df.sparkSession, F.col(x), number, first, min_confidence))
            opened.append((name, any(r[5] is None for r in held)))
        for name, needs_python in opened:
            parts.append(many_rules.jvm_candidates(x, name))
            extra.append(name)
            if needs_python:
                df = df.withColumn(f"{name}_python", many_rules.python_candidates(F.col(x), F.col(name)))
                parts.append(f"{name}_python")
                extra.append(f"{name}_python")
    if external:
        dynamic.append(detect.span_to_candidate(
            f"coalesce({ident(external)}, {empty_array(detect.SPAN_TYPE)})",
            len(ruleset.rules) + len(ruleset.detectors) + sum(map(len, ruleset.tables))))
    if min_confidence > 0.0:  # rules were filtered before the plan; scores of other sources are per span
        dynamic = [f"filter({d}, v_c -> -v_c.nc >= {float(min_confidence)!r}D)" for d in dynamic]
    parts += dynamic
    if not parts:
        parts = [empty_array(detect.CANDIDATE_TYPE)]
    return df, parts[0] if len(parts) == 1 else joined(*parts), extra


def with_candidates(df: DataFrame, text_col: str, rules: Rules = None, min_confidence: float = 0.0,
                    external: str | None = None, into: str = "candidates", on_invalid: str = "replace",
                    allowed: str | None = None) -> DataFrame:
    """Add every detected span, before overlap resolution.

    ``external`` names an ARRAY<span> column with findings made elsewhere; they rank after all rules.
    """
    df, candidates, extra = _prepared(df, text_col, rules, min_confidence, external, on_invalid, allowed)
    return computed_once(df, into, candidates).drop(*extra)


def with_spans(df: DataFrame, text_col: str, rules: Rules = None, min_confidence: float = 0.0,
               external: str | None = None, into: str = "spans", on_invalid: str = "replace") -> DataFrame:
    """Add the kept spans of each text as ``ARRAY<span>``; offsets count code points of its valid form."""
    df, candidates, extra = _prepared(df, text_col, rules, min_confidence, external, on_invalid)
    return computed_once(df, into, resolved_spans(candidates)).drop(*extra)


def sanitize(df: DataFrame, text_col: str = "text", rules: Rules = None, min_confidence: float = 0.0,
             external: str | None = None, style: str = "label", dry_run: bool = False,
             on_invalid: str = "replace") -> DataFrame:
    """Add ``spans``, ``clean_text`` and ``report`` to every row, in one stage without a shuffle (but for rule tables of more than a slice).

    Unused outputs cost nothing: Catalyst drops the splice or the report when not selected. With
    ``dry_run`` the clean text is the input. Bytes that are no UTF-8 become U+FFFD in the clean text,
    or fail the job with ``on_invalid="raise"``. Input columns with these names are an error.
    """
    df, candidates, extra = _prepared(free_for(df, "spans", "clean_text", "report"), text_col, rules, min_confidence, external, on_invalid)
    out = computed_once(df, "spans", resolved_spans(candidates))
    # the valid text is there already; tested inside the splice, each test would look its method up anew
    clean = F.col(text_col) if dry_run else F.expr(spliced("_mw_text", "spans", style))
    return out.withColumn("clean_text", clean).drop(*extra).withColumn("report", report("spans"))


def sanitize_text(spark: SparkSession, text: str, rules: Rules = None,
                  min_confidence: float = 0.0) -> tuple[str, dict]:
    """One text in, (clean text, report) out: for trying rules out."""
    row = sanitize(spark.createDataFrame([(text,)], "text STRING"), "text", rules, min_confidence).first()
    return row.clean_text, row.report.asDict(recursive=True)


def raw_findings(df: DataFrame, keys: Sequence[str], text_col: str, rules: Rules = None,
                 min_confidence: float = 0.0, rank: bool = False) -> DataFrame:
    """One row per detected span, overlaps included; with ``rank``, the place of its rule in detection order."""
    out = with_candidates(df, text_col, rules, min_confidence, into="_mw_candidates")
    place = ", 'rank', v_c.ord" if rank else ""
    return out.select(*keys, F.expr(f"""inline(transform(`_mw_candidates`, v_c -> named_struct(
        'start', v_c.s, 'end', v_c.e, 'original', v_c.txt, 'replacement', v_c.rep,
        'category', v_c.cat, 'label', v_c.lab, 'confidence', -v_c.nc{place})))"""))


def register_sql(spark: SparkSession, rules: Rules = None, min_confidence: float = 0.0,
                 name: str = "mask_text") -> None:
    """Create the temporary SQL functions ``<name>(text)`` and ``<name>_spans(text)``.

    They are SQL functions over built-in expressions, so queries using them stay on the JVM.
    """
    jvm, python, detectors, tables = detect.rule_plan(RuleSet.of(rules), min_confidence)
    if python or detectors or tables:
        raise ValueError("SQL functions take pattern rules that run on the JVM")
    spans = let("v_x", valid_utf8("x"), resolved_spans(detect.inline_candidates("v_x", jvm)))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_spans(x STRING)"
              f" RETURNS ARRAY<{detect.SPAN_TYPE}> RETURN {spans}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING"
              f" RETURN {spliced(valid_utf8('x'), f'{name}_spans(x)')}")

