"""Secrets by patterns, and by novelty under a compressor primed with dictionaries.

Base spans come from fixed patterns. Beyond them, a string that follows a sensitive word is measured: how many bytes does it add
to a zstandard frame primed with the corpus's identifiers and with the text around the string? Words, paths, repeated
placeholders and names used nearby cost little; random strings cost nearly their length. Strings that cost ``NOVEL`` or more of
their length, and hold letters and digits, are reported as ``novel``, from end to end. A string of more than ``WINDOW``
characters is also measured in windows of that many, and one such window is enough: the compressor codes longer strings of few
symbols, as hexadecimal keys are, in fewer bits. Strings of which base spans leave less than ``LEAST`` characters are not measured.

The identifier dictionary holds the most frequent identifiers of all texts that hold a sensitive word, most frequent last, where
the compressor reaches them cheapest; it is at most ``DICTIONARY_BYTES``. Identifiers are letters and underscores only, so that a
secret with many copies doesn't become a known word. Every text is searched whole.

Defined results: a null text counts as empty; an empty text has no spans. Rows are independent, so repeated rows get equal
results; repeated rows count as often in the dictionary as they occur. Equally frequent identifiers come in code-point order.
Other columns may have any names.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.spans import Span, find_in_texts

KINDS = ("assign", "access", "hex", "novel")
NOVEL = 0.7
LEAST = 16
WINDOW = 64
AROUND = 512
DICTIONARY_BYTES = 16_384
LONGEST_IDENTIFIER = 24

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
#: Words after which a string may be a secret; the gate holds a part of each.
SENSITIVE = "bearer|authorization|credential|passphrase|password|passwd|pwd|secret|token|signature|private|key"
_GATE = ("bearer", "authorization", "credential", "passphrase", "passw", "pwd", "secret", "token", "signature", "private", "key")
_CANDIDATE = re.compile(rf"""(?:{SENSITIVE})[A-Za-z_]{{0,16}}["']?[\s:=>(]{{1,8}}["']?([A-Za-z0-9+/_=.-]{{{LEAST},}}+)""", re.I | re.A)


def base_spans(text: str, low: str) -> list[Span]:
    found: list[Span] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _covered(spans: list[tuple[int, int]]) -> int:
    """Characters in sorted spans (start, end)."""
    n = reached = 0
    for a, b in spans:
        n += max(0, b - max(a, reached))
        reached = max(reached, b)
    return n


class Novelty:
    """Marginal compressed size of a string against identifiers and the text around it."""

    def __init__(self, identifiers: bytes):
        self.identifiers = identifiers

    def share(self, piece: bytes, around: bytes) -> float:
        primed = zstandard.ZstdCompressor(level=12, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            self.identifiers + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return (len(primed.compress(piece)) - len(primed.compress(b""))) / len(piece)

    def novel(self, text: str, start: int, end: int) -> bool:
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode()
        piece = text[start:end].encode()
        if self.share(piece, around) >= NOVEL:
            return True
        at = [*range(0, len(piece) - WINDOW, WINDOW), len(piece) - WINDOW] if len(piece) > WINDOW else []
        return any(self.share(w, around) >= NOVEL for w in dict.fromkeys(piece[k : k + WINDOW] for k in at))

    def find(self, text: str, low: str, base: list[Span]) -> list[Span]:
        if not any(word in low for word in _GATE):
            return []
        out = []
        for m in _CANDIDATE.finditer(text):
            a, b = m.span(1)
            s = m.group(1)
            within = sorted((max(a, c), min(b, d)) for c, _, d in base if a < d and c < b)
            if within and b - a - _covered(within) < LEAST or not (any(map(str.isdigit, s)) and any(map(str.isalpha, s))):
                continue
            if self.novel(text, a, b):
                out.append((a, 3, b))
        return out


def identifiers(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_BYTES) -> bytes:
    """The identifier dictionary. The driver gets at most ``most`` bytes of words, and their counts."""
    text = F.col(f"`{text_col}`").cast("string")
    words = (docs.where(text.rlike(f"(?i)(?:{SENSITIVE})"))
             .select(F.explode(F.regexp_extract_all(text, F.lit(rf"[A-Za-z_]{{4,{LONGEST_IDENTIFIER}}}"), F.lit(0))).alias("word")))
    top = (words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most // 5).collect())
    kept, size = [], 0
    for r in top:
        size += len(r.word) + 1
        if size > most:
            break
        kept.append(r.word.encode())
    return b" ".join(kept[::-1])


def finder(words: bytes):
    novelty = Novelty(words)

    def find(text: str) -> tuple[list[Span], list[Span]]:
        low = text.lower()
        base = base_spans(text, low)
        return base, novelty.find(text, low, base)
    return find


def find_secrets(docs: DataFrame, words: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_assign, n_access, n_hex, base_sha256, spans."""
    return find_in_texts(docs, id_col, text_col, KINDS, 3, lambda: finder(words))
