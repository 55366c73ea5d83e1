"""Pages as trees of blocks: a lenient reader of HTML, and features of its nodes for whole batches of pages.

Reading follows browsers where it matters for text: quoted attributes, comments, raw text elements, optional end tags, end tags that
match nothing, character references. Formatting elements make no nodes; a block element, or a span with a class or id, is one.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = set("audio canvas datalist math object select svg template video".split())
BLOCK = set("""address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
NO_NODE = set("html head body".split())
SCOPE = set("table td th caption button".split()) | UNSEEN
KINDS = {kind: k for k, group in enumerate(
    ["p", "div center", "section hgroup", "article", "main", "nav menu", "aside", "header", "footer", "form fieldset legend button search", "ul ol dl dir",
     "li dt dd", "h1", "h2 h3 h4 h5 h6", "table tbody thead tfoot tr caption", "td th", "blockquote pre listing", "figure figcaption",
     "address details dialog summary", "span"], 1) for kind in group.split()}
N_KINDS = 1 + max(KINDS.values())

_TAG = re.compile(r"""<(?:!--(?:-?>|[\s\S]*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)
    |(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""", re.X)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|data-mw)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_MARK = re.compile(r"[.,;:!?。，،।]")

BREAK = None


class Page:
    """A page's nodes in page order; node 0 is the page itself. ``items``: (node, text), or a break between blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.given = ["body"], [-1], [()], [None]
        self.links, self.linked = [0], [0]  # links, and characters inside them
        self.items: list[tuple[int, str] | None] = []
        self._stack: list[tuple[str, int]] = []
        self._scopes: list[tuple[int, Counter]] = [(0, Counter())]
        self._open = Counter()
        self._unseen = 0
        self._link = -1
        self._read(source)

    # ------------------------------------------------------------------ the open elements
    def _node(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _push(self, name: str, node: int) -> None:
        self._scopes[-1][1][name] += 1
        self._open[name] += 1
        self._stack.append((name, node))
        if name in SCOPE:
            self._unseen += name in UNSEEN
            self._scopes.append((len(self._stack), Counter()))

    def _pop(self) -> str:
        name, _ = self._stack.pop()
        if name in SCOPE:
            self._unseen -= name in UNSEEN
            self._scopes.pop()
        self._scopes[-1][1][name] -= 1
        self._open[name] -= 1
        if len(self._stack) < self._link:
            self._link = -1
        if name in BLOCK:
            self.items.append(BREAK)
        return name

    def _pop_to(self, names: set[str]) -> None:
        while self._pop() not in names:
            pass

    def _close(self, names: set[str], through: set[str] | None = None) -> None:
        """Close the innermost of these in this scope; with ``through``, only below such elements."""
        if any(self._scopes[-1][1][n] for n in names):
            if through is not None:
                for name, _ in reversed(self._stack[self._scopes[-1][0]:]):
                    if name in names:
                        break
                    if name in BLOCK and name not in through:
                        return
            self._pop_to(names)

    # ------------------------------------------------------------------ reading
    def _read(self, source: str) -> None:
        at = 0
        while True:
            tag = _TAG.search(source, at)
            if tag is None:
                break
            if tag.start() > at:
                self._text(source[at:tag.start()])
            at = tag.end()
            name = tag["name"]
            if name is None:
                continue
            name = name.lower()
            if tag["end"]:
                self._end(name)
            elif name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = close.start() if close else len(source)
            else:
                self._start(name, tag["rest"])
        if at < len(source):
            self._text(source[at:])

    def _text(self, text: str) -> None:
        if self._unseen:
            return
        if "&" in text:
            text = html.unescape(text)
        node = self._node()
        self.items.append((node, text))
        if self._link >= 0:
            self.linked[node] += len(text)

    def _start(self, name: str, rest: str) -> None:
        if name in NO_NODE:
            return
        if name in VOID:
            if name == "br":
                self.items.append((self._node(), " "))
            elif name == "hr":
                self._close({"p"})
                self.items.append(BREAK)
            return
        if name == "a":
            self._link = len(self._stack)
            self.links[self._node()] += 1
            return
        if name in BLOCK:
            if name != "button":
                self._close({"p"})
            if name == "li":
                self._close({"li"}, {"div", "p", "address"})
            elif name in ("dt", "dd"):
                self._close({"dt", "dd"}, {"div", "p", "address"})
            elif name in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"):
                self._table_part(name)
            elif KINDS.get(name) in (KINDS["h1"], KINDS["h2"]) and self._stack and self._stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._pop()
            self.items.append(BREAK)
            self._push(name, self._add(name, rest))
        elif name == "span":
            tokens = bool(_ATTRIBUTE.search(rest)) if rest else False
            self._push(name, self._add(name, rest) if tokens else self._node())
        elif name in UNSEEN:
            self._push(name, self._node())

    def _table_part(self, name: str) -> None:
        """A cell ends at the next one, a row at the next row, a part at the next part, each in its own table."""
        ends = {"td", "th", "caption"} | ({"tr"} if name not in ("td", "th") else set()) | (
            {"thead", "tbody", "tfoot"} if name in ("thead", "tbody", "tfoot", "caption") else set())
        while self._open["table"] and self._stack:
            inner = next((n for n, _ in reversed(self._stack) if n in ends or n == "table"), None)
            if inner is None or inner == "table":
                return
            self._pop_to({inner})

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = -1
        elif name == "br":
            self.items.append((self._node(), " "))
        elif name in BLOCK or name == "span" or name in UNSEEN:
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._close({"h1", "h2", "h3", "h4", "h5", "h6"})
            elif self._scopes[-1][1][name]:
                self._pop_to({name})
            elif name in SCOPE and self._open[name]:
                self._pop_to({name})
            elif name == "p":
                self.items.append(BREAK)

    def _add(self, name: str, rest: str) -> int:
        tokens, given = [], None
        if rest and "=" in rest:
            for key, value in _ATTRIBUTE.findall(rest):
                value = value.strip("\"'")
                if key.lower() == "data-mw":
                    given = value == "1"
                else:
                    tokens += [t.lower() for t in _PART.findall(value[:256])]
        self.tag.append(name)
        self.parent.append(self._node())
        self.tokens.append(tuple(tokens[:16]))
        self.given.append(given)
        self.links.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    # ------------------------------------------------------------------ text
    def blocks(self, keep) -> list[str]:
        """Blocks of the text of the nodes to keep: white space is one space, no block is empty."""
        out, now = [], []
        for item in [*self.items, BREAK]:
            if item is BREAK:
                if now:
                    text = " ".join("".join(now).split())
                    if text:
                        out.append(text)
                    now = []
            elif keep[item[0]]:
                now.append(item[1])
        return out


FEATURES = [*(f"kind_{k}" for k in range(N_KINDS)), "in_main", "in_side", "in_list", "token_best", "token_worst", "outer_best", "outer_worst",
            "own", "text", "link_share", "marks", "dense", "mean", "depth", "place", "siblings", "of_parent", "of_page", "offset",
            "parent_text", "parent_links", "children", "before", "after", "links"]
_MAIN = [KINDS["article"], KINDS["main"]]
_SIDE = [KINDS[k] for k in ("nav", "aside", "header", "footer", "form", "address")]


class Batch:
    """Nodes of some pages in arrays; node numbers run through."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        own = np.array([i for p in pages for i in p.parent], np.int64)
        self.parent = np.where(own >= 0, own + self.first[self.page], -1)
        self.kind = np.array([KINDS.get(t, 0) for p in pages for t in p.tag], np.int64)
        depth = np.zeros(len(own), np.int64)
        for i, up in enumerate(self.parent.tolist()):
            if up >= 0:
                depth[i] = depth[up] + 1
        self.depth = depth
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(float)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def spread(self, values: np.ndarray, combine) -> np.ndarray:
        """From the page down: a node's value combined with what its ancestors have, itself left out."""
        out = np.zeros(len(values))
        for level in self.levels[1:]:
            up = self.parent[level]
            out[level] = combine(out[up], values[up])
        return out

    def features(self, weights: dict[str, float]) -> np.ndarray:
        n, up = len(self.parent), np.maximum(self.parent, 0)
        own, marks, words, offset = (np.zeros(n) for _ in range(4))
        for p, first in zip(self.pages, self.first.tolist()):
            seen, last = 0, -1
            for item in p.items:
                if item is not BREAK:
                    node, text = item
                    while last < node:  # nodes begin in page order
                        last += 1
                        offset[first + last] = seen
                    pieces = text.split()
                    if pieces:
                        size = len(text) if len(pieces) == 1 else sum(map(len, pieces)) + len(pieces) - 1
                        own[first + node] += size
                        words[first + node] += len(pieces)
                        marks[first + node] += len(_MARK.findall(text))
                        seen += size
            offset[first + last + 1 : first + len(p.tag)] = seen
        best, worst = np.zeros(n), np.zeros(n)
        for i, tokens in enumerate(t for p in self.pages for t in p.tokens):
            if tokens:
                w = [weights.get(t, 0.0) for t in tokens]
                best[i], worst[i] = max(0.0, *w), min(0.0, *w)
        links = np.array([x for p in self.pages for x in p.links], float)
        linked = np.minimum(np.array([x for p in self.pages for x in p.linked], float), own)
        text, all_links, all_linked = self.summed(own), self.summed(links), self.summed(linked)
        all_marks, all_words, nodes = self.summed(marks), self.summed(words), self.summed(np.ones(n))
        children = np.bincount(self.parent[self.parent >= 0], minlength=n).astype(float)
        # siblings in page order
        order = np.lexsort((np.arange(n), self.parent))
        same = np.append(False, self.parent[order][1:] == self.parent[order][:-1]) & (self.parent[order] >= 0)
        start = np.maximum.accumulate(np.where(~same, np.arange(n), 0))
        place, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
        place[order] = np.arange(n) - start
        previous = np.flatnonzero(same)
        before[order[previous]] = text[order[previous - 1]]
        after[order[previous - 1]] = text[order[previous]]
        whole = np.maximum(text[self.first[self.page]], 1)
        siblings = np.where(self.parent >= 0, children[up], 1)
        either = np.maximum
        columns = [*((self.kind == k) for k in range(N_KINDS)),
                   self.spread(np.isin(self.kind, _MAIN).astype(float), either), self.spread(np.isin(self.kind, _SIDE).astype(float), either),
                   self.spread((self.kind == KINDS["ul"]).astype(float), either), best, worst, self.spread(best, np.maximum), self.spread(worst, np.minimum),
                   np.log1p(own), np.log1p(text), all_linked / np.maximum(text, 1), 100 * all_marks / np.maximum(text, 20),
                   100 * nodes / np.maximum(text, 20), text / np.maximum(all_words, 1), self.depth, place / siblings, np.log1p(siblings),
                   np.where(self.parent >= 0, text / np.maximum(text[up], 1), 1), text / whole, offset / whole,
                   np.log1p(text[up]), all_linked[up] / np.maximum(text[up], 1), np.log1p(children), np.log1p(before), np.log1p(after), np.log1p(all_links)]
        return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)
