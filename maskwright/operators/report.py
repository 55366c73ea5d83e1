"""Counts and messages, per row and per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.expr import ident, let

REPORT_FIELDS = ("total_matches", "by_category", "by_label", "is_clean")


def _counter(sp: str, field: str) -> str:
    """How often each value of a field stands in the spans; most texts have one span or none."""
    counted = let("v_vs", f"transform({sp}, v_s -> v_s.{field})", """map_from_entries(transform(array_sort(array_distinct(v_vs)),
        v_v -> struct(v_v, bigint(size(filter(v_vs, v_w -> v_w = v_v))))))""")
    return f"CASE size({sp}) WHEN 1 THEN map(get({sp}, 0).{field}, 1L) ELSE {counted} END"


def report(spans_col: str = "spans") -> Column:
    """STRUCT<total_matches, by_category, by_label, is_clean> of one row's spans."""
    sp = ident(spans_col)
    return F.expr(f"""named_struct(
        'total_matches', bigint(size({sp})),
        'by_category', {_counter(sp, 'category')},
        'by_label', {_counter(sp, 'label')},
        'is_clean', size({sp}) = 0)""")


def _details(by_label: str) -> str:
    return (f"array_join(transform(array_sort(map_entries({by_label})),"
            " v_e -> concat(v_e.key, '=', v_e.value)), ', ')")


def summary(report_col: str = "report", dry_run: bool = False) -> Column:
    """``Detected N sensitive value(s): label=count, ...`` with labels sorted."""
    r = ident(report_col)
    text = f"""CASE
        WHEN {r}.total_matches = 0 THEN 'No sensitive content detected.'
        WHEN coalesce(size({r}.by_label), 0) > 0 THEN concat(
            'Detected ', {r}.total_matches, ' sensitive value(s): ', {_details(f'{r}.by_label')})
        ELSE concat('Detected ', {r}.total_matches, ' sensitive value(s).') END"""
    return F.expr(f"concat('Dry run: ', {text})" if dry_run else text)


def masked_message(report_col: str = "report") -> Column:
    """The alert text of a masking run."""
    r = ident(report_col)
    return F.expr(f"""CASE
        WHEN {r}.total_matches = 0 THEN 'Clipboard is clean — nothing was masked.'
        WHEN coalesce(size({r}.by_label), 0) > 0 THEN concat(
            'Masked ', {r}.total_matches, ' value(s): ', {_details(f'{r}.by_label')})
        ELSE concat('Masked ', {r}.total_matches, ' sensitive value(s).') END""")


def findings(df: DataFrame, keys: Sequence[str], spans_col: str = "spans",
             hash_original: bool = False) -> DataFrame:
    """One row per kept span; ``hash_original`` stores a SHA-256 instead of the value."""
    out = df.select(*keys, F.inline(spans_col))
    if hash_original:
        out = out.select(*keys, "start", "end", F.sha2("original", 256).alias("original_sha256"),
                         "replacement", "category", "label", "confidence")
    return out


def label_counts(df: DataFrame, by: Sequence[str] = (), spans_col: str = "spans") -> DataFrame:
    """(by..., category, label, n) over the whole table.

    Rows are reduced to their labels before the shuffle, and partial counts leave each task, so a
    hot group costs one row per task and label.
    """
    return _labels(df, by, spans_col).groupBy(*by, "category", "label").agg(F.count("*").alias("n"))


def rollup(df: DataFrame, by: Sequence[str], spans_col: str = "spans") -> DataFrame:
    """Counts by any keys with subtotals over category and label, and the number of texts affected.

    Each row is one text and lists the subtotals it contributes to, once each, so texts are counted
    without a distinct shuffle.
    """
    sp = ident(spans_col)
    levels = f"""array_distinct(concat(
        transform({sp}, v_s -> named_struct('category', v_s.category, 'label', v_s.label)),
        transform({sp}, v_s -> named_struct('category', v_s.category, 'label', CAST(NULL AS STRING))),
        transform({sp}, v_s -> named_struct('category', CAST(NULL AS STRING), 'label', CAST(NULL AS STRING)))))"""
    rows = (
        df.where(F.expr(f"size({sp}) > 0"))
        .select(*by, F.expr(sp).alias("v_spans"), F.expr(f"explode({levels})").alias("lv"))
        .select(*by, "lv.category", "lv.label", F.expr("""bigint(size(filter(v_spans, v_s ->
            (lv.category IS NULL OR v_s.category = lv.category)
            AND (lv.label IS NULL OR v_s.label = lv.label))))""").alias("n_spans"))
    )
    return rows.groupBy(*by, "category", "label").agg(
        F.sum("n_spans").alias("n_spans"), F.count("*").alias("n_docs"))


def _labels(df: DataFrame, by: Sequence[str], spans_col: str) -> DataFrame:
    return df.select(*by, F.expr(
        f"inline(transform({ident(spans_col)}, v_s -> named_struct('category', v_s.category, 'label', v_s.label)))"))


def dirtiest(df: DataFrame, key: str, k: int, spans_col: str = "spans") -> DataFrame:
    """The k rows with most spans (ties by key)."""
    return (df.select(key, F.expr(f"bigint(size({ident(spans_col)}))").alias("total_matches"))
            .orderBy(F.desc("total_matches"), key).limit(k))


def totals(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """One row: the report of a whole table, as if it were one text."""
    n = F.expr(f"size({ident(spans_col)})")
    return df.agg(F.count("*").alias("n_docs"), F.sum(n.cast("bigint")).alias("total_matches"),
                  F.count_if(n == 0).alias("n_clean"))
