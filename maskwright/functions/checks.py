"""Checksum tests for numbers, as SQL expressions over one matched string."""

from __future__ import annotations


def luhn(s: str) -> str:
    """Card checksum: from the right, every second digit is doubled and its digits summed."""
    return f"""aggregate(
        transform(split(reverse(regexp_replace({s}, '[^0-9]', '')), ''),
                  (v_d, v_i) -> if(v_i % 2 = 1, int(v_d) * 2 - if(int(v_d) > 4, 9, 0), int(v_d))),
        0, (v_a, v_d) -> v_a + v_d) % 10 = 0"""


def mod97(s: str) -> str:
    """IBAN checksum: country and check digits moved last, letters as 10..35, remainder 1."""
    return f"""aggregate(
        split(concat(substring({s}, 5), substring({s}, 1, 4)), ''), 0,
        (v_a, v_d) -> if(v_d BETWEEN '0' AND '9',
                         (v_a * 10 + int(if(v_d BETWEEN '0' AND '9', v_d, '0'))) % 97,
                         (v_a * 100 + ascii(v_d) - 55) % 97)) = 1"""


def ssn(s: str) -> str:
    """Social security numbers never have area 000, 666 or 900-999."""
    return f"NOT (substring({s}, 1, 3) IN ('000', '666') OR substring({s}, 1, 1) = '9')"


def at_sign(s: str) -> str:
    return f"contains({s}, '@')"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ipv6(s: str) -> str:
    """Eight groups, or one :: for one or more of them; the last two may be written as an IPv4 address."""
    plain = f"regexp_replace({s}, ':{_OCTET}(?:[.]{_OCTET}){{3}}$', ':0:0')"
    halves = "size(split(v_y, '::', -1))"
    groups = "size(filter(split(v_y, ':', -1), v_g -> v_g <> ''))"
    open_start, open_end = ("startswith(v_y, ':') AND NOT startswith(v_y, '::')", "endswith(v_y, ':') AND NOT endswith(v_y, '::')")
    return (f"element_at(transform(array({plain}), v_y -> NOT contains(v_y, '.') AND NOT contains(v_y, ':::') AND NOT ({open_start}) AND NOT ({open_end})"
            f" AND CASE {halves} WHEN 1 THEN {groups} = 8 WHEN 2 THEN {groups} <= 7 ELSE false END), 1)")


CHECKS = {"ipv6": ipv6, "luhn": luhn, "mod97": mod97, "ssn": ssn, "at_sign": at_sign}
