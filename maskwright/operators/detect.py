"""Detection: text -> candidate spans, as one Spark expression.

For a rule, ``regexp_extract_all`` gives the matches and ``split`` the gaps between them;
running sums of their lengths give code-point offsets. Rules sit behind cheap literal gates, so
a clean text costs a few substring searches and no shuffle is ever needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from maskwright.functions.checks import CHECKS
from maskwright.functions.expr import empty_array, let, lit, running
from maskwright.rules import Detector, Rule, RuleSet

SPAN_TYPE = ("STRUCT<start: INT, end: INT, original: STRING, replacement: STRING, category: STRING,"
             " label: STRING, confidence: DOUBLE>")

# A candidate: the first four fields are the overlap-resolution order (most confident, earliest,
# longest, first rule), so the natural struct order is the rank.
CANDIDATE_TYPE = ("STRUCT<nc: DOUBLE, s: INT, nl: INT, ord: INT, e: INT, txt: STRING, rep: STRING,"
                  " cat: STRING, lab: STRING>")


def lower_text(x: str, rules: list[tuple[int, Rule]]) -> str:
    """The text in lower case, with the letters that match an ASCII one ignoring case written as that one.

    ``lower`` leaves long s and dotless i, and turns dotted capital I into i and a combining dot. NULL where no gate will ask for it.
    """
    asking = [r.need for _, r in rules if "{lc}" in (r.gate or "")]
    if not asking:
        return "CAST(NULL AS STRING)"
    lower = (f"CASE WHEN octet_length({x}) <> char_length({x})"
             f" AND (contains({x}, 'ſ') OR contains({x}, 'ı') OR contains({x}, 'İ'))"
             f" THEN translate(lower({x}), 'ſı\\u0307', 'si') ELSE lower({x}) END")
    return lower if None in asking else f"if({' OR '.join(n.format(x=x) for n in dict.fromkeys(asking))}, {lower}, NULL)"


def open_rules(x: str, lc: str, rules: list[tuple[int, Rule]]) -> str:
    """Numbers of the rules whose gate the text passes, ascending; a NULL text passes none. Rules with one need share one test of it.

    As part of whole-stage code all gates would share one method, too large for the JIT compiler.
    The lambda keeps the projection out of it, and Spark generates small methods instead.
    """
    groups: dict[str | None, list[str]] = {}
    for k, (_, r) in enumerate(rules, 1):
        groups.setdefault(r.need, []).append(f"if({r.gate.format(x=x, lc=lc)}, {k}, 0)" if r.gate else str(k))
    none = empty_array("INT")
    parts = [f"array_remove(array({', '.join(numbers)}), 0)" for numbers in groups.values()]
    parts = [f"if({need.format(x=x)}, {p}, {none})" if need else p for need, p in zip(groups, parts)]
    opened = parts[0] if len(parts) == 1 else f"sort_array(concat({', '.join(parts)}))"
    return f"if(exists(array({x}), v_x -> v_x IS NULL), {none}, {opened})"


def gated_text(x: str, rules: list[tuple[int, Rule]]) -> str:
    """The text, or NULL where no rule's gate opens."""
    if not all(r.gate for _, r in rules):
        return x
    lc = f"({lower_text(x, rules)})"
    gates = " OR ".join(f"({r.need or 'true'} AND {r.gate})".format(x=x, lc=lc) for _, r in rules)
    return f"if({gates}, {x}, NULL)"


def _per_rule(rules: list[tuple[int, Rule]], k: str, call: str) -> str:
    """``call`` with the pattern of rule ``k``, found by halving; patterns stay constants, so each is compiled once."""
    def among(first: int, calls: list[str]) -> str:
        half = len(calls) // 2
        return f"if({k} < {first + half}, {among(first, calls[:half])}, {among(first + half, calls[half:])})" if half else calls[0]
    return among(1, [call.format(lit(r.java())) for _, r in rules])


def _rule_table(rules: list[tuple[int, Rule]]) -> str:
    """The constant columns of the rules, folded into one literal."""
    rows = [
        f"named_struct('ord', {ord_}, 'nc', {-float(r.confidence)!r}D,"
        f" 'rep', {lit(r.replacement)}, 'cat', {lit(r.category)}, 'lab', {lit(r.label)})"
        for ord_, r in rules
    ]
    return f"array({', '.join(rows)})"


#: A character the text does not hold; NULL for a text that holds all of them.
_MARK = "CASE " + " ".join(f"WHEN NOT contains({{x}}, {m}) THEN {m}" for m in ("'\\u0001'", "'\\u0002'", "'\\uE000'")) + " END"


def locate(matches: str, gaps: str, rule: str) -> str:
    """Turn one rule's matches and the gaps before them into candidates."""
    ends = running(f"zip_with({matches}, slice({gaps}, 1, size({matches})),"
                   " (v_m, v_g) -> length(v_g) + length(v_m))", "0", "v_l + v_r")
    return f"""zip_with({matches}, {ends}, (v_m, v_end) -> named_struct(
        'nc', {rule}.nc, 's', v_end - length(v_m), 'nl', -length(v_m), 'ord', {rule}.ord, 'e', v_end,
        'txt', v_m, 'rep', {rule}.rep, 'cat', {rule}.cat, 'lab', {rule}.lab))"""


def _checked(candidates: str, rules: list[tuple[int, Rule]]) -> str:
    tests = [f"WHEN v_c.ord = {ord_} THEN {CHECKS[r.check]('v_c.txt')}" for ord_, r in rules if r.check]
    if not tests:
        return candidates
    return f"filter({candidates}, v_c -> CASE {' '.join(tests)} ELSE true END)"


def _by_marks(x: str, opened: str, rules: list[tuple[int, Rule]]) -> str:
    """Each rule's pattern runs over the text once, writing ``v_mark`` around its matches; cut there, matches stand at odd places.

    ``split`` compiles its pattern on every call and ``regexp_extract_all`` gives no gaps, ``regexp_replace`` keeps a constant pattern.
    """
    several = let("v_m", "transform(sequence(1, size(v_p) - 2, 2), v_i -> get(v_p, v_i))", let(
        "v_g", "transform(sequence(0, size(v_p) - 3, 2), v_i -> get(v_p, v_i))", locate("v_m", "v_g", "v_rule")))
    first, match = "length(get(v_p, 0))", "length(get(v_p, 1))"
    one = f"""array(named_struct('nc', v_rule.nc, 's', {first}, 'nl', -{match}, 'ord', v_rule.ord, 'e', {first} + {match},
        'txt', get(v_p, 1), 'rep', v_rule.rep, 'cat', v_rule.cat, 'lab', v_rule.lab))"""
    cut = let("v_p", "split(v_r, v_mark, -1)", let("v_rule", f"element_at({_rule_table(rules)}, v_n)", f"if(size(v_p) = 3, {one}, {several})"))
    per_rule = let("v_r", _per_rule(rules, "v_n", f"regexp_replace({x}, {{}}, v_around)"),
                   f"if(octet_length(v_r) > octet_length({x}), {cut}, {empty_array(CANDIDATE_TYPE)})")
    found = f"flatten(transform({opened}, v_n -> {per_rule}))"
    return _checked(let("v_around", "concat(v_mark, '$0', v_mark)", found), rules)


def _by_pattern(x: str, opened: str, rules: list[tuple[int, Rule]]) -> str:
    """For texts that hold every mark: matches, and the text split by the pattern itself."""
    hits = f"""filter(transform({opened}, v_n -> named_struct(
        'k', v_n, 'm', {_per_rule(rules, 'v_n', f'regexp_extract_all({x}, {{}}, 0)')})), v_r -> size(v_r.m) > 0)"""
    cut = f"""transform({hits}, v_r -> named_struct('m', v_r.m, 'g', split({x}, {_per_rule(rules, 'v_r.k', '{}')}, -1),
        'rule', element_at({_rule_table(rules)}, v_r.k)))"""
    return _checked(f"flatten(transform({cut}, v_q -> {locate('v_q.m', 'v_q.g', 'v_q.rule')}))", rules)


def rule_candidates(x: str, opened: str, rules: list[tuple[int, Rule]]) -> str:
    """Candidates of the JVM rules whose numbers are in ``opened``; other texts skip all of this."""
    found = let("v_mark", _MARK.format(x=x), f"if(v_mark IS NULL, {_by_pattern(x, opened, rules)}, {_by_marks(x, opened, rules)})")
    return f"CASE WHEN size({opened}) > 0 THEN {found} ELSE {empty_array(CANDIDATE_TYPE)} END"


def inline_candidates(x: str, rules: list[tuple[int, Rule]]) -> str:
    """The same as one expression, for use inside a SQL function."""
    names = f"named_struct('x', {x}, 'lc', {lower_text(x, rules)})"
    return let("v_t", names, let("v_open", open_rules("v_t.x", "v_t.lc", rules),
                                 rule_candidates("v_t.x", "v_open", rules)))


def python_candidates(rules: list[tuple[int, Rule]]):
    """Candidates of the rules Java cannot run, found with Python's own matcher in Arrow batches."""
    specs = [(ord_, r.pattern, -float(r.confidence), r.replacement, r.category, r.label, r.check)
             for ord_, r in rules]

    @F.pandas_udf(f"ARRAY<{CANDIDATE_TYPE}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(re.compile(p), o, *rest) for o, p, *rest in specs]

        def one(text):
            if text is None:
                return []
            return [
                {"nc": nc, "s": m.start(), "nl": m.start() - m.end(), "ord": o, "e": m.end(),
                 "txt": m.group(), "rep": rep, "cat": cat, "lab": lab}
                for rx, o, nc, rep, cat, lab, _ in compiled for m in rx.finditer(text)
            ]

        for texts in batches:
            yield texts.map(one)

    return find


def span_to_candidate(spans: str, ord_: int, category: str | None = None) -> str:
    """Spans from a user detector or another table, as candidates ranked at ``ord_``."""
    cat = lit(category) if category else "v_s.category"
    return f"""transform({spans}, v_s -> named_struct(
        'nc', -v_s.confidence, 's', int(v_s.start), 'nl', int(v_s.start - v_s.end), 'ord', {ord_},
        'e', int(v_s.end), 'txt', v_s.original, 'rep', v_s.replacement, 'cat', {cat},
        'lab', v_s.label))"""


def rule_plan(ruleset: RuleSet, min_confidence: float = 0.0):
    """Split a rule set by engine: (JVM rules, Python rules, user detectors, rule tables), each with its rank.

    A rank is the place in detection order: by priority, then as listed (rules before user
    detectors of the same priority, those before rule tables). A table takes a rank for each of its rules.
    """
    sources = sorted([*ruleset.rules, *ruleset.detectors, *ruleset.tables], key=lambda i: i.priority)
    sizes = [len(i) if i in ruleset.tables else 1 for i in sources]
    ranked = [(sum(sizes[:k]), i) for k, i in enumerate(sources)]
    rules = [(o, r) for o, r in ranked if isinstance(r, Rule) and r.confidence >= min_confidence]
    unchecked = [(o, r) for o, r in rules if r.resolved_engine() == "python"]
    bad = [r.label for _, r in unchecked if r.check]
    if bad:
        raise ValueError(f"checksum rules must be plain patterns: {', '.join(bad)}")
    return ([(o, r) for o, r in rules if r.resolved_engine() == "jvm"], unchecked,
            [(o, d) for o, d in ranked if isinstance(d, Detector)], [(o, t) for o, t in ranked if t in ruleset.tables])

