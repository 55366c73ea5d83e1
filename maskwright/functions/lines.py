"""How far a pattern can reach over line ends, read from the parsed pattern."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPACES = {9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0}


class Unbounded(ValueError):
    """Matches may take in any number of lines in a way that ranges of a text cannot follow."""


@dataclass(frozen=True)
class Bracket:
    """A match runs from ``head`` over ``least`` characters or more to the first ``stop``, where ``tail`` must match."""

    head: str
    least: int
    stop: str
    tail: str


def _set(items) -> tuple[bool, bool]:
    """(matches a line end, matches nothing but white space) of a class."""
    negated = bool(items) and str(items[0][0]) == "NEGATE"
    newline, blank = False, True
    for op, value in items[negated:]:
        name = str(op)
        if name == "LITERAL":
            newline, blank = newline or value == 10, blank and value in _SPACES
        elif name == "RANGE":
            newline, blank = newline or value[0] <= 10 <= value[1], blank and all(c in _SPACES for c in range(value[0], min(value[1], 0x3001) + 1))
        else:
            space = str(value) == "CATEGORY_SPACE"
            newline, blank = newline or space or str(value) in ("CATEGORY_NOT_DIGIT", "CATEGORY_NOT_WORD"), blank and space
    return (not newline, False) if negated else (newline, blank)


def _joins(items, flags: int) -> int:
    """White space over line ends that a match may hold, at most."""
    total = 0
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            total += value == 10
        elif name == "NOT_LITERAL":
            if value != 10:
                raise Unbounded
        elif name == "ANY":
            if flags & re.S:
                raise Unbounded
        elif name == "IN":
            newline, blank = _set(value)
            if newline and not blank:
                raise Unbounded
            total += newline
        elif name == "CATEGORY":
            total += str(value) == "CATEGORY_SPACE"
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = _joins(value[2], flags)
            if inner and not (len(value[2]) == 1 and str(value[2][0][0]) in ("IN", "CATEGORY", "LITERAL")):
                if int(value[1]) > 64:
                    raise Unbounded
                inner *= max(1, int(value[1]))
            total += inner
        elif name == "SUBPATTERN":
            total += _joins(value[3], flags)
        elif name == "ATOMIC_GROUP":
            total += _joins(value, flags)
        elif name == "BRANCH":
            total += max(_joins(branch, flags) for branch in value[1])
        elif name in ("ASSERT", "ASSERT_NOT"):
            total += _joins(value[1], flags)
        elif name == "AT":
            if str(value) in ("AT_BEGINNING_STRING", "AT_END_STRING") or str(value) in ("AT_BEGINNING", "AT_END") and not flags & re.M:
                raise Unbounded
        else:  # references to groups and the like
            raise Unbounded
    return total


def joins(pattern: str) -> int:
    """The number of places where a match can go on after blanks over line ends. ``Unbounded`` if it can hold line ends otherwise."""
    parsed = re._parser.parse(pattern)
    try:
        return _joins(parsed, parsed.state.flags)
    except Unbounded:
        raise Unbounded(f"{pattern!r} may match over any number of lines") from None


_OPEN = re.compile(r"(\[\\s\\S\]\*\?)|\[\^([^\\\]\[])\](\+\??|\*\??)")


def bracket(pattern: str) -> Bracket:
    """Head, stop and tail of a pattern whose one open part is ``[\\s\\S]*?``, or a class of all but one character that then follows."""
    for part in _OPEN.finditer(pattern):
        head, tail = pattern[:part.start()], pattern[part.end():]
        try:
            if not head or not tail or joins(head) or joins(tail) or "|" in head + tail or re.match(r"\(\?[a-z]+\)", pattern):
                continue
        except (Unbounded, re.error):
            continue
        if part[1]:
            return Bracket(head, 0, tail, tail)
        if tail.startswith(part[2]) and part[2] not in r".^$*+?{}()|\\":
            return Bracket(head, int(part[3][0] == "+"), re.escape(part[2]), tail)
    raise Unbounded(f"{pattern!r} may match over any number of lines")


# ------------------------------------------------------------------ where a line may end without being crossed
_ASCII = frozenset(range(128))
_BLANK = frozenset(c for c in _SPACES if c < 128)


def _members(items) -> frozenset[int]:
    """The ASCII characters of a class."""
    negated = bool(items) and str(items[0][0]) == "NEGATE"
    held = set()
    for op, value in items[negated:]:
        name = str(op)
        if name == "LITERAL":
            held.add(value)
        elif name == "RANGE":
            held.update(range(value[0], min(value[1], 127) + 1))
        else:
            test = re.compile({"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S",
                               "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W"}[str(value)])
            held.update(c for c in _ASCII if test.match(chr(c)))
    return _ASCII - held if negated else frozenset(held) & _ASCII


def _lasts(items, before: frozenset[int], found: set[int]) -> frozenset[int]:
    """What may be the last character but blanks after ``items``, given the same before them; adds to ``found`` what may stand before a line end."""
    for op, value in items:
        name = str(op)
        if name in ("LITERAL", "IN", "CATEGORY"):
            chars = _members([(op, value)] if name != "IN" else value)
            if 10 in chars:
                found |= before
            before = (chars - _BLANK) | (before if chars & _BLANK else frozenset())
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            once = _lasts(value[2], before, found)
            again = once | _lasts(value[2], before | once, found)
            before = again | (before if value[0] == 0 else frozenset())
        elif name == "SUBPATTERN":
            before = _lasts(value[3], before, found)
        elif name == "ATOMIC_GROUP":
            before = _lasts(value, before, found)
        elif name == "BRANCH":
            before = frozenset().union(*[_lasts(branch, before, found) for branch in value[1]])
        elif name in ("ASSERT", "ASSERT_NOT"):
            _lasts(value[1], before if value[0] > 0 else _ASCII, found)
        elif name != "AT":  # any character
            before = _ASCII
    return before


def before_line_ends(pattern: str) -> frozenset[int]:
    """The ASCII characters after which, and blanks, a match may take in a line end. Only of patterns whose ``joins`` are known.

    A line whose last character but blanks is another one, and ASCII, is never crossed at its end, whatever was matched before.
    """
    parsed, found = re._parser.parse(pattern), set()
    _lasts(parsed, _ASCII, found)
    if parsed.state.flags & re.I:
        found |= {ord(f(chr(c))) for c in found for f in (str.lower, str.upper)}
    return frozenset(found)
