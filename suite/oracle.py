"""Checking SQL: the same results by joins, windows and a recursive walk (not by the engine's folds)."""

from __future__ import annotations

from maskwright.rules import Rule


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _luhn(txt: str) -> str:
    digits = f"regexp_replace({txt}, '[^0-9]', '', 'g')"
    d = f"TRY_CAST(substr({digits}, CAST(p AS INT), 1) AS INT)"
    return (f"(SELECT sum(CASE WHEN p % 2 = 0 THEN {d} WHEN {d} < 5 THEN 2 * {d} ELSE 2 * {d} - 9 END)"
            f" FROM (SELECT unnest(range(1, 17)) AS p)) % 10 = 0")


def _mod97(txt: str) -> str:
    # Digits of the rearranged number, weighted by powers of ten modulo 97 (through the exact integer).
    moved = f"substr({txt}, 5) || substr({txt}, 1, 4)"
    number = f"regexp_replace({moved}, '([A-Z])', '<\\1>', 'g')"
    for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        number = f"replace({number}, '<{c}>', '{i + 10}')"
    head, tail = f"substr({number}, 1, 20)", f"substr({number}, 21)"
    return (f"(TRY_CAST({head} AS HUGEINT) % 97 * CAST(pow(10, length({tail}) % 96) AS HUGEINT)"
            f" + TRY_CAST('0' || {tail} AS HUGEINT)) % 97 = 1")


_CHECK = {
    "at_sign": lambda txt: "true",
    "luhn": _luhn,
    "mod97": _mod97,
    "ssn": lambda txt: f"NOT regexp_matches({txt}, '^(000|666|9)')",
}


def located(source: str, rules: list[Rule], min_confidence: float = 0.0) -> str:
    """CTEs ``docs`` and ``found(id, ord, s, e, txt, rep, cat, lab, conf)`` for a source query (id, source, text)."""
    ranked = [(i, r) for i, r in enumerate(sorted(rules, key=lambda r: r.priority)) if r.confidence >= min_confidence]
    hits = " UNION ALL ".join(
        f"SELECT id, {i} AS ord, regexp_extract_all(text, {quoted(r.pattern)}) AS m,"
        f" string_split_regex(text, {quoted(r.pattern)}) AS g FROM docs WHERE regexp_matches(text, {quoted(r.pattern)})"
        for i, r in ranked)
    table = ", ".join(
        f"({i}, {quoted(r.replacement)}, {quoted(r.category)}, {quoted(r.label)}, CAST({r.confidence!r} AS DOUBLE))"
        for i, r in ranked)
    checks = " ".join(f"WHEN {i} THEN {_CHECK[r.check]('txt')}" for i, r in ranked if r.check)
    keep = f"CASE ord {checks} ELSE true END" if checks else "true"
    return f"""docs AS ({source}),
    rules(ord, rep, cat, lab, conf) AS (VALUES {table}),
    hits AS ({hits}),
    pieces AS (SELECT id, ord, unnest(m) AS txt, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM hits),
    ends AS (SELECT *, CAST(sum(length(gap) + length(txt)) OVER (PARTITION BY id, ord ORDER BY i) AS INT) AS e FROM pieces),
    found AS (SELECT id, ord, e - CAST(length(txt) AS INT) AS s, e, txt, rep, cat, lab, conf
              FROM ends JOIN rules USING (ord) WHERE {keep})"""


def kept(source: str, rules: list[Rule], min_confidence: float = 0.0) -> str:
    """More CTEs: ``kept``, the spans that survive a walk through the candidates by rank."""
    return f"""{located(source, rules, min_confidence)}, {walk('found')}"""


def walk(candidates: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, s, e - s DESC, ord) AS rn FROM {candidates}),
    walk AS (
      SELECT id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s INT, e INT)[]) AS taken, false AS ok
      FROM (SELECT DISTINCT id FROM ranked)
      UNION ALL
      SELECT id, rn, CASE WHEN ok THEN list_append(taken, {{'s': s, 'e': e}}) ELSE taken END, ok FROM (
        SELECT r.id, r.rn, r.s, r.e, w.taken,
               len(list_filter(w.taken, lambda k: r.s < k.e AND k.s < r.e)) = 0 AS ok
        FROM walk w JOIN ranked r ON r.id = w.id AND r.rn = w.rn + 1)),
    kept AS (SELECT r.* FROM ranked r JOIN walk w ON r.id = w.id AND r.rn = w.rn WHERE w.ok)"""


def clean(replacement: str = "rep") -> str:
    """CTE ``clean(id, text, clean_text, n)`` over ``docs`` and ``kept``."""
    return f"""cut AS (
      SELECT k.*, text, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS pe FROM kept k JOIN docs USING (id)),
    joined AS (
      SELECT id, string_agg(substr(text, pe + 1, s - pe) || {replacement}, '' ORDER BY s)
                 || substr(any_value(text), max(e) + 1) AS masked, count(*) AS n
      FROM cut GROUP BY id),
    clean AS (
      SELECT id, source, text, coalesce(masked, text) AS clean_text, coalesce(n, 0) AS n
      FROM docs LEFT JOIN joined USING (id))"""


def with_recursive(*ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"
