"""Redaction: write replacements over the kept spans.

Replacements are inserted as they are, never as regex templates. The text is cut once per block
of spans and once per span inside its block, so cost grows with the text and not with
text length times spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.expr import ident, let, running, valid_utf8

_BLOCK = 64
_SHORT = 1024  # bytes of a text whose pieces are cut from its beginning

STYLES = {
    "label": "v_s.replacement",
    "redact": "'[REDACTED]'",
    "fake": "rpad(substring(v_s.original, 1, 4), length(v_s.original), 'X')",
}


def _gaps(text: str) -> str:
    """The unmasked piece before each span of ``v_sp`` (disjoint, in text order, not empty)."""
    blocks = f"""transform(sequence(0, (size(v_sp) - 1) div {_BLOCK}), v_b -> named_struct(
        'base', if(v_b = 0, 0, get(v_sp, v_b * {_BLOCK} - 1).end),
        'ks', slice(v_sp, int(v_b * {_BLOCK} + 1), {_BLOCK})))"""
    cut = f"""transform({blocks}, v_k -> named_struct('base', v_k.base, 'ks', v_k.ks,
        'part', substring({text}, v_k.base + 1, element_at(v_k.ks, -1).end - v_k.base)))"""
    before = "if(v_i = 0, v_k.base, get(v_k.ks, v_i - 1).end)"
    return f"""flatten(transform({cut}, v_k -> transform(v_k.ks, (v_s, v_i) ->
        substring(v_k.part, {before} - v_k.base + 1, v_s.start - {before}))))"""


def _tail(text: str) -> str:
    return f"substring({text}, element_at(v_sp, -1).end + 1)"


# An empty span shares its start with its neighbour: write it before, the last ranked first.
_WRITE_ORDER = """if(size(v_in) < 2 OR NOT exists(sequence(1, size(v_in) - 1), v_i -> get(v_in, v_i).start <= get(v_in, v_i - 1).start),
    v_in, transform(sort_array(transform(v_in, (v_s, v_i) -> named_struct(
    's', v_s.start, 'e', v_s.end, 'i', -v_i, 'v_s', v_s))), v_o -> v_o.v_s))"""


def spliced(text: str, spans: str, style: str = "label") -> str:
    """The text with each span replaced."""
    if style not in STYLES:
        raise ValueError(f"Unknown style: {style!r}. Available styles: {', '.join(STYLES)}")
    before = "if(v_i = 0, 0, get(v_sp, v_i - 1).end)"
    short = f"concat(substring({text}, {before} + 1, v_s.start - {before}), {STYLES[style]})"
    body = f"""CASE WHEN size(v_sp) = 0 THEN {text}
        WHEN size(v_sp) = 1 THEN {let('v_s', 'get(v_sp, 0)', f"concat(coalesce(concat(substring({text}, 1, v_s.start), {STYLES[style]}), ''), substring({text}, v_s.end + 1))")}
        WHEN size(v_sp) <= {_BLOCK} AND octet_length({text}) <= {_SHORT} THEN concat(array_join(transform(v_sp, (v_s, v_i) -> {short}), ''), {_tail(text)})
        ELSE concat(array_join(zip_with({_gaps(text)}, v_sp, (v_g, v_s) -> concat(v_g, {STYLES[style]})), ''),
        {_tail(text)}) END"""
    return let("v_in", spans, let("v_sp", _WRITE_ORDER, body))


def apply_replacements(text_col: str, spans_col: str = "spans", style: str = "label") -> Column:
    return F.expr(let("v_text", valid_utf8(ident(text_col)), spliced("v_text", ident(spans_col), style)))


def line_changes(df: DataFrame, keys: list[str], text_col: str, spans_col: str = "spans") -> DataFrame:
    """A review of what masking would change: (keys..., line_no, before, after).

    One row per changed line. A span over several lines joins them into one row, numbered by its
    first line, so nothing of a multi-line secret is hidden from the review.
    """
    def newlines(s: str) -> str:
        return f"(length({s}) - length(replace({s}, '\\n', '')))"

    x = "v_text"
    advance = f"""transform(v_gp, (v_g, v_i) -> {newlines('v_g')}
        + if(v_i = 0, 0, {newlines('get(v_sp, v_i - 1).original')}))"""
    heads = """filter(sequence(0, size(v_sp) - 1),
        v_i -> if(v_i = 0, true, contains(get(v_gp, v_i), '\\n')))"""

    def side(value: str) -> str:
        inner = f"""array_join(transform(sequence(v_h, v_next - 1), v_i -> concat(
            if(v_i = v_h, '', get(v_gp, v_i)), get(v_sp, v_i).{value})), '')"""
        return (f"concat(substring_index(get(v_gp, v_h), '\\n', -1), {inner},"
                f" substring_index(coalesce(get(v_gp, v_next), v_tail), '\\n', 1))")

    rows = f"""transform(v_heads, (v_h, v_n) -> {let(
        'v_next', 'coalesce(get(v_heads, v_n + 1), size(v_sp))',
        f"named_struct('line_no', get(v_line, v_h) + 1, 'before', {side('original')}, 'after', {side('replacement')})")})"""
    units = let("v_text", valid_utf8(ident(text_col)), let("v_in", ident(spans_col), let("v_sp", _WRITE_ORDER, let("v_gp", _gaps(x), let(
        "v_tail", _tail(x), let("v_line", running(advance, "0", "v_l + v_r"), let("v_heads", heads, rows)))))))
    return df.where(F.expr(f"size({ident(spans_col)}) > 0")).select(*keys, F.expr(f"inline({units})"))
