"""A plain-Python statement of what the Spark expressions must compute."""

import ipaddress
import re

from maskwright.rules import Rule


def _luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ssn(s):
    return s[:3] not in ("000", "666") and s[0] != "9"


def _ipv6(s):
    try:
        return ipaddress.IPv6Address(s) is not None
    except ValueError:
        return False


CHECKS = {"ipv6": _ipv6, "at_sign": lambda s: True, "luhn": _luhn, "mod97": _mod97, "ssn": _ssn, None: lambda s: True}


def candidates(text, rules: list[Rule], min_confidence=0.0):
    out = []
    for rule in sorted(rules, key=lambda r: r.priority):
        for m in re.finditer(rule.pattern, text):
            if CHECKS[rule.check](m.group()) and rule.confidence >= min_confidence:
                out.append((m.start(), m.end(), m.group(), rule.replacement, rule.category, rule.label,
                            rule.confidence))
    return out


def resolve(found):
    """Best first (surest, earliest, longest, first found); a span is kept if all its places are still free.

    An empty span has no places; it is kept unless it lies strictly inside a kept one.
    """
    taken, kept = set(), []
    for rank in sorted(range(len(found)), key=lambda i: (-found[i][6], found[i][0], -found[i][1] + found[i][0], i)):
        start, end = found[rank][:2]
        places = set(range(start, end))
        inside = start == end and any(k[0] < start < k[1] for k in kept)
        around = any(k[0] == k[1] and start < k[0] < end for k in kept)
        if taken.isdisjoint(places) and not inside and not around:
            taken |= places
            kept.append(found[rank])
    kept.sort(key=lambda span: span[0])
    return kept


def splice(text, spans):
    """Left to right: what stays, then what is written. Of spans with one start the empty ones come first, the last ranked first."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][1], -i))
    pieces, at = [], 0
    for i in order:
        pieces += [text[at : spans[i][0]], spans[i][3]]
        at = spans[i][1]
    return "".join(pieces) + text[at:]


def sanitize(text, rules, min_confidence=0.0):
    spans = resolve(candidates(text, rules, min_confidence))
    return splice(text, spans), spans
