"""What a pattern needs: literals of which every match contains one, read from the parsed pattern."""

from __future__ import annotations

import re

LEAST = 3  # characters of a literal worth looking for
MOST = 64  # alternatives

# Characters that ignore-case matching takes for ASCII letters, beside the letters themselves.
_FOLDED = {0x17F: "s", 0x131: "i", 0x307: None}


def folded(text: str) -> str:
    """Lower case, in which every text that matches ASCII letters ignoring case shows them as themselves."""
    return text.lower() if text.isascii() else text.lower().translate(_FOLDED)


def _worth(literals: list[str] | None) -> tuple[int, int]:
    return (min(map(len, literals)), -len(literals)) if literals else (0, 0)


def _of(items) -> list[str] | None:
    """The best set of literals for a sequence: the longest shortest one."""
    best, run = None, ""

    def better(found):
        nonlocal best
        if found and _worth(found) > _worth(best):
            best = found

    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        better([run] if run else None)
        run = ""
        if name == "SUBPATTERN":
            better(_of(value[3]))
        elif name == "ATOMIC_GROUP":
            better(_of(value))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            better(_of(value[2]))
        elif name == "BRANCH":
            sides = [_of(branch) for branch in value[1]]
            if all(sides) and sum(map(len, sides)) <= MOST:
                better(sorted({x for side in sides for x in side}))
    better([run] if run else None)
    return best


def required_literals(pattern: str) -> list[str] | None:
    """Folded ASCII literals: the folded text of every match holds at least one. None if there are none of use."""
    found = _of(re._parser.parse(pattern))
    return found if found and min(map(len, found)) >= LEAST else None
