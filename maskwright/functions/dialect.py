"""Run Python-flavoured patterns on the JVM with the same meaning.

Python's ``\\d \\s \\w \\b`` are Unicode-aware in a slightly different way than Java's, so they
are spelled out as explicit classes. Constructs whose meaning differs, or whose Java matcher
recurses once per repetition, are refused and run in Arrow-batched Python instead.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
_BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_START, _STOP = rf"(?<![{WORD}])(?=[{WORD}])", rf"(?<=[{WORD}])(?![{WORD}])"

_OUTSIDE = {"d": r"\p{Nd}", "D": r"\P{Nd}", "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
            "w": f"[{WORD}]", "W": f"[^{WORD}]", "b": _BOUNDARY, "Z": r"\z", "A": r"\A"}
_INSIDE = {"d": r"\p{Nd}", "D": r"\P{Nd}", "s": SPACE, "w": WORD}
_NEGATED = {"S": f"[^{SPACE}]", "W": f"[^{WORD}]"}  # only within a class that is not negated itself
_CONTROL = {"n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f", "v": r"\x0B", "a": r"\x07"}
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")


# Java's matcher recurses once per repeat of a group, and nested repeats multiply.
MOST_REPEATS = 200


class Unsupported(ValueError):
    """The pattern cannot be given the same meaning on the JVM."""


def _escape(text: str, i: int, table: dict[str, str]) -> tuple[str, int]:
    """Translate the escape starting at ``text[i]`` and return it with the index after it."""
    if i + 1 >= len(text):
        raise Unsupported("trailing backslash")
    c = text[i + 1]
    if c in table:
        return table[c], i + 2
    if c in _CONTROL:
        return _CONTROL[c], i + 2
    if c in "xu":
        width = 2 if c == "x" else 4
        digits = text[i + 2:i + 2 + width]
        if not re.fullmatch(rf"[0-9a-fA-F]{{{width}}}", digits):
            raise Unsupported("bad escape")
        return rf"\{c}{digits}", i + 2 + width
    if c.isalnum():
        raise Unsupported(f"escape \\{c}")
    return "\\" + c, i + 2


def _char_class(text: str, i: int) -> tuple[str, int]:
    out, j, table = "[", i + 1, _INSIDE | _NEGATED
    if text[j:j + 1] == "^":
        out, j, table = "[^", j + 1, _INSIDE
    first = True
    while j < len(text):
        c = text[j]
        if c == "]" and not first:
            return out + "]", j + 1
        if c == "\\":
            piece, j = _escape(text, j, table)
            out += piece
        else:
            out += "\\" + c if c in "[]&~^" else c
            j += 1
        first = False
    raise Unsupported("unterminated class")


def _flags(text: str) -> tuple[str, str]:
    """Leading global flags, as Java flags (``d`` = only newline ends a line), and the rest."""
    flags = "d"
    m = re.match(r"\(\?([a-zA-Z]+)\)", text)
    if m:
        if set(m.group(1)) - set("imsu"):
            raise Unsupported("flags")
        if "i" in m.group(1):
            if not text.isascii():
                raise Unsupported("case folding of non-ASCII text")
            flags += "iu"
        flags += "".join(f for f in "ms" if f in m.group(1))
        text = text[m.end():]
    return flags, text


def _check_repeats(items, classes_too: bool, factor: int = 1) -> None:
    """Refuse patterns whose groups can repeat more than ``MOST_REPEATS`` times, all enclosing repeats multiplied.

    Python's parser turns alternatives of single characters into a class; ``classes_too`` counts a
    bounded repeat of a class inside a repeated group as one of a group.
    """
    for op, value in items:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            _, most, inner = value
            plain = len(inner) == 1 and str(inner[0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY")
            if plain and str(inner[0][0]) == "IN" and classes_too and factor > 1 and most < 65535:
                plain = False
            times = factor if plain else factor * max(1, int(most))
            if times > MOST_REPEATS:
                raise Unsupported("long repeated group recurses in the Java matcher")
            _check_repeats(inner, classes_too, times)
        elif name == "POSSESSIVE_REPEAT":
            _check_repeats(value[2], classes_too, factor)
        elif name == "SUBPATTERN":
            _check_repeats(value[3], classes_too, factor)
        elif name == "BRANCH":
            for branch in value[1]:
                _check_repeats(branch, classes_too, factor)
        elif name in ("ASSERT", "ASSERT_NOT"):
            _check_repeats(value[1], classes_too, factor)
        elif name == "ATOMIC_GROUP":
            _check_repeats(value, classes_too, factor)


def _parsed(pattern: str):
    try:
        return re._parser.parse(pattern)
    except AttributeError as exc:  # the parser module moved: be careful and refuse
        raise Unsupported("no parser to look at repeats with") from exc


def java_pattern(pattern: str, lead: str | None = None) -> str:
    """The Java spelling of a Python pattern; raises ``Unsupported`` when there is none.

    ``lead`` is a class the match must start with; testing it first lets the matcher leave
    most positions after a single character check.
    """
    _check_repeats(_parsed(pattern), "|" in pattern)
    flags, text = _flags(pattern)
    out, i, closed_group = [], 0, False
    while i < len(text):
        c = text[i]
        after_group, closed_group = closed_group, False
        if c == "\\":
            piece, j = _escape(text, i, _OUTSIDE)
            if piece is _BOUNDARY:
                if i == 0 and lead:
                    piece = rf"(?<![{WORD}])"
                elif i == 0 and re.match(r"[a-zA-Z0-9]|\[a-z0-9|\[A-Z|\[0-9", text[j:]):
                    piece = _START
                elif j == len(text) and re.search(r"[a-zA-Z0-9)\]}]$", text[:i]) and lead:
                    piece = _STOP
            out.append(piece)
            i = j
        elif c == "[":
            piece, i = _char_class(text, i)
            out.append(piece)
        elif c == "(":
            m = re.match(r"\(\?(?::|=|!|<=|<!|>)", text[i:])
            if text[i + 1:i + 2] == "?" and not m:
                raise Unsupported("group extension")
            out.append(m.group() if m else "(")
            i += m.end() if m else 1
        elif c == ")":
            out.append(c)
            i, closed_group = i + 1, True
        elif c in "*+":
            if after_group and text[i + 1:i + 2] != "+":
                raise Unsupported("unbounded repeated group recurses in the Java matcher")
            out.append(c)
            i += 1
            if text[i:i + 1] in ("+", "?"):
                out.append(text[i])
                i += 1
        elif c == "{":
            m = _QUANTIFIER.match(text, i)
            if not m or (not m.group(1) and not m.group(3)):
                out.append(r"\{")
                i += 1
                continue
            low, comma, high = m.groups()
            possessive = text[m.end():m.end() + 1] == "+"
            if after_group and not possessive and (int(high or low) > MOST_REPEATS or comma and not high):
                raise Unsupported("long repeated group recurses in the Java matcher")
            out.append("{" + (low or "0") + comma + high + "}")
            i = m.end()
        elif c == "}":
            out.append(r"\}")
            i += 1
        else:
            out.append(c)
            i += 1
    body = "".join(out)
    return f"(?{flags})" + (f"(?={lead})(?:{body})" if lead else body)


def literal_prefix(pattern: str) -> str | None:
    """Plain characters (three or more) every match starts with, when that is easy to see."""
    m = re.match(r"[A-Za-z0-9 _/:=-]+", pattern)
    if not m or "|" in pattern:
        return None
    optional = pattern[m.end():m.end() + 1] in ("*", "+", "?", "{")  # a quantifier covers the last one
    prefix = m.group()[:-1] if optional else m.group()
    return prefix if len(prefix) >= 3 else None


def can_match_empty(pattern: str) -> bool:
    """True when a match may be zero characters wide (extract/split cannot locate such matches)."""
    try:
        return re._parser.parse(pattern).getwidth()[0] == 0
    except AttributeError:  # the parser module moved: be careful and say yes
        return True


def runs_on_jvm(pattern: str) -> bool:
    try:
        java_pattern(pattern)
    except Unsupported:
        return False
    return not can_match_empty(pattern)
