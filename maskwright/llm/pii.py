"""Personal data by a semi-Markov conditional random field over base patterns.

Base spans come from fixed patterns and checks. The field reads the places where a value could be: runs of digits with
separators, and words around an at sign. A run is a row of tokens; a candidate segment is a group of neighbouring tokens of
bounded length with one type, scored by features of the whole segment (number and shape of digit groups, separators, checksum,
octets, a plus sign, the word before). All segmentations of a run compete: dynamic programming over the end and type of the last
segment sums them for training and for the certainty of a segment, and finds the best one. Where no run is, there are no
candidates, so leaving the rest of the text out changes nothing.

Weights maximise the likelihood of the base spans on a bounded sample: of texts that hold a digit or an at sign, the
``SAMPLE_DOCS`` with the lowest hash of the id among those of at most ``SAMPLE_BYTES`` bytes. Every text is searched whole. A
segment of the best segmentation is added if its certainty is ``CERTAIN`` or more and it meets no base span.

Defined results: a null text counts as empty; an empty text has no spans. Rows are independent, so repeated rows get equal
results. Without sample texts nothing is added to the base. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import sample_by_hash, send
from maskwright.llm.spans import Span, find_in_texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 512
SAMPLE_BYTES = 16_384
CERTAIN = 0.9
MAX_TOKENS = 9
NOTHING = len(KINDS)  # the type of a token outside all segments

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[ ().+-]{0,3}[0-9])++")
_TOKEN = re.compile(r"[0-9]+|[^0-9]")
_AT_RUN = re.compile(r"[^\s@<>()\[\],;:\"]*(?:@| ?[\[(]at[\])] ?)[^\s@<>()\[\],;:\"]*(?: ?[\[(]dot[\])] ?[^\s@<>()\[\],;:\"]+)*", re.I)
_AT_TOKEN = re.compile(r"\w+| ?[\[(](?:at|dot)[\])] ?|[^\w]", re.I)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\s:.=#]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at signs: linear in the text, whatever it holds."""
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return found


# ------------------------------------------------------------------ runs, segments, features
class Run:
    """Tokens of a run: ``bounds[i]`` to ``bounds[i + 1]``. ``segments``: (first token, token after the last, features)."""

    def __init__(self, text: str, start: int, end: int, mail: bool):
        self.mail = mail
        self.bounds = [m.start() + start for m in (_AT_TOKEN if mail else _TOKEN).finditer(text[start:end])] + [end]
        before = _WORD_BEFORE.search(text, max(0, start - 24), start)
        word = before.group(1).lower() if before else ""
        self.segments = []
        n = len(self.bounds) - 1
        longest = 2 * MAX_TOKENS
        for i in range(n):
            first = text[self.bounds[i]]
            if not (first.isalnum() or first in "+(" and not mail):
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = text[self.bounds[i] : self.bounds[j]]
                if piece[-1].isalnum():
                    features = _mail_features(piece) if mail else _number_features(piece)
                    if features:
                        whole = ["whole"] if i == 0 and j == n else ["cut"]
                        self.segments.append((i, j, features + whole + ([f"after={word}"] if word else [])))

    @property
    def types(self) -> tuple[int, ...]:
        return (0,) if self.mail else (1, 2, 3)


def _number_features(piece: str) -> list[str] | None:
    groups = re.findall("[0-9]+", piece)
    digits = "".join(groups)
    if not 7 <= len(digits) <= 19 or len(groups) > MAX_TOKENS:
        return None
    marks = re.sub("[0-9]+", "9", piece)
    out = ["bias", f"digits={len(digits)}", f"groups={len(groups)}", "shape=" + re.sub("[0-9]", "9", piece), "marks=" + marks]
    if piece[0] == "+":
        out.append("plus")
    if len(digits) >= 14:
        out.append("luhn" if luhn(digits) else "no luhn")
    if len(groups) == 4 and marks == "9.9.9.9":
        out.append("octets" if all(int(g) <= 255 for g in groups) else "no octets")
    if piece.count("(") != piece.count(")"):
        out.append("open")
    return out


def _mail_features(piece: str) -> list[str] | None:
    sides = re.split(r"@| ?[\[(]at[\])] ?", piece, flags=re.I)
    if len(sides) != 2 or not sides[0] or not sides[1]:
        return None
    domain = re.sub(r" ?[\[(]dot[\])] ?", ".", sides[1], flags=re.I)
    if not _DOMAIN.fullmatch(domain):
        return None
    return ["bias", "at sign" if "@" in piece else "at word", f"dots={min(3, domain.count('.'))}", "local" if _LOCAL.match(sides[0]) else "no local"]


def runs(text: str) -> Iterator[Run]:
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            if sum(map(str.isdigit, m.group())) >= 7:
                yield Run(text, m.start(), m.end(), False)
    low = text.lower() if "[" in text or "(" in text else ""
    signs = [m.start() for m in re.finditer("@|[\\[(]at[\\])]", text, re.I)] if "@" in text or "[at]" in low or "(at)" in low else []
    done = 0
    for at in signs:
        if at < done:
            continue
        start = at
        while start > done and at - start < 80 and not (text[start - 1].isspace() and (text[at] == "@" or start != at)) and text[start - 1] not in "@<>()[],;:\"":
            start -= 1
        m = _AT_RUN.match(text, start)
        if m and m.end() > at:
            done = m.end()
            yield Run(text, m.start(), min(m.end(), m.start() + 400), True)


# ------------------------------------------------------------------ the field
class Field:
    """Weights by (feature, type), and by (type, next type)."""

    def __init__(self):
        self.weights: dict[tuple[str, int], float] = {}
        self.next = np.zeros((NOTHING + 1, NOTHING + 1))

    def scores(self, run: Run) -> list[tuple[int, int, int, float, list[str]]]:
        """All segments with a type: (first, after, type, score, features); single tokens outside have score 0."""
        get = self.weights.get
        out = [(i, i + 1, NOTHING, 0.0, []) for i in range(len(run.bounds) - 1)]
        out += [(i, j, y, sum(get((f, y), 0.0) for f in features), features) for i, j, features in run.segments for y in run.types]
        return sorted(out, key=lambda s: s[1])

    def sums(self, run: Run):
        """Log sums over all segmentations up to and from each place, by type of the last and of the next segment."""
        n, segments = len(run.bounds) - 1, self.scores(run)
        forward = np.full((n + 1, NOTHING + 1), -np.inf)
        forward[0, NOTHING] = 0.0
        for i, j, y, s, _ in segments:
            forward[j, y] = np.logaddexp(forward[j, y], s + np.logaddexp.reduce(forward[i] + self.next[:, y]))
        backward = np.full((n + 1, NOTHING + 1), -np.inf)  # by type of the segment that ends here
        backward[n] = 0.0
        for i, j, y, s, _ in sorted(segments, key=lambda s: -s[0]):
            backward[i] = np.logaddexp(backward[i], self.next[:, y] + s + backward[j, y])
        total = np.logaddexp.reduce(forward[n])
        return segments, forward, backward, total

    def certainties(self, run: Run):
        segments, forward, backward, total = self.sums(run)
        for i, j, y, s, features in segments:
            before = forward[i] + self.next[:, y] + s + backward[j, y] - total
            yield i, j, y, features, np.exp(before)

    def best(self, run: Run) -> list[tuple[int, int, int]]:
        """The best segmentation: (first, after, type) of its segments."""
        n, segments = len(run.bounds) - 1, self.scores(run)
        score = np.full((n + 1, NOTHING + 1), -np.inf)
        score[0, NOTHING] = 0.0
        back = {}
        for i, j, y, s, _ in segments:
            via = score[i] + self.next[:, y]
            k = int(via.argmax())
            if via[k] + s > score[j, y]:
                score[j, y] = via[k] + s
                back[j, y] = (i, k)
        at, y, out = n, int(score[n].argmax()), []
        while at > 0:
            i, k = back[at, y]
            if y != NOTHING:
                out.append((i, at, y))
            at, y = i, k
        return out[::-1]

    def fit(self, examples: list[tuple[Run, set[tuple[int, int, int]]]], rounds: int = 30, rate: float = 0.5, decay: float = 0.01) -> Field:
        """Ascend the likelihood of the given segments (start, type, end in the text), with squared weights held down."""
        if not examples:
            return self
        for _ in range(rounds):
            slope: dict[tuple[str, int], float] = defaultdict(float)
            turn = np.zeros_like(self.next)
            for run, gold in examples:
                last, inside, here = NOTHING, 0, {}
                for i, j, y, features, p in self.certainties(run):
                    expected = p.sum()
                    true = (run.bounds[i], y, run.bounds[j]) in gold
                    for f in features:
                        slope[f, y] += true - expected
                    turn[:, y] -= p
                    if true:
                        here[i] = (j, y)
                while inside < len(run.bounds) - 1:
                    j, y = here.get(inside, (inside + 1, NOTHING))
                    turn[last, y] += 1
                    last, inside = y, j
            for key, g in slope.items():
                w = self.weights.get(key, 0.0)
                self.weights[key] = w + rate * (g / len(examples) * 4 - decay * w)
            self.next += rate * (turn / len(examples) - decay * self.next)
        return self


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit the field to the base spans of the sample, which is what the driver gets."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("h"))
    rows = rows.where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= sample_bytes))
    sample = [r.text for r in sample_by_hash(rows, "h", sample_docs).collect()]
    examples = []
    for text in sample:
        gold = {(a, k, b) for a, k, b in base_spans(text)}
        examples += [(run, gold) for run in runs(text) if run.segments]
    return Field().fit(examples)


def finder(field: Field):
    def find(text: str) -> tuple[list[Span], list[Span]]:
        base, more = base_spans(text), []
        for run in runs(text):
            if not run.segments or any(a <= run.bounds[0] and run.bounds[-1] <= b for a, _, b in base):
                continue
            best = set(field.best(run))
            if best:
                for i, j, y, _, p in field.certainties(run):
                    a, b = run.bounds[i], run.bounds[j]
                    if (i, j, y) in best and p.sum() >= CERTAIN and not any(a < d and c < b for c, _, d in base):
                        more.append((a, y, b))
        return base, more
    return find


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    shared = send(docs.sparkSession, field)
    return find_in_texts(docs, id_col, text_col, KINDS, len(KINDS), lambda: finder(shared.value))
