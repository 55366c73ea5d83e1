"""Main text of pages: gradient-boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

Trees score every node of a page (``dom``) from its kind, attribute words, depth, siblings, the density of text, links and marks in its
subtree, and its surroundings: is it part of the main text? A node is then outside, main or left out, and the states of the whole
page are chosen together for the greatest probability, by a dynamic program from the leaves up: below an outside node anything may
follow, below a main one main or left out, below one left out only the same. So nothing is kept inside what is dropped, and a notice
inside an article goes without it.

Training is done here. Labels come from pages that say which part is their article (``article`` or ``main``); since such a page has
little variety, they are also cut to a few short paragraphs, and their paragraphs are laid out anew: in other elements with usual class names or with none, among
menus, sidebars, notices, adverts, forms and comments. The trees are fitted on at most ``pages`` pages, shorter ones first, and
``NODES`` nodes a page, chosen by hash, ``ROWS`` together; weights of attribute words come from the other half of the sample than the rows they describe.

Whole pages are read, of any length, each by one task. Defined results: a null or empty page, or one without main text, gives an empty
text; without any page with text there is no row to train on but the layouts' own. Bytes that are no UTF-8 count as U+FFFD. Rows that
repeat are pages of their own; other columns may have any names.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.functions.expr import valid_utf8
from maskwright.llm.boosting import Trees, fit
from maskwright.llm.common import pieces, release_memory
from maskwright.llm.dom import FEATURES, Batch, Page

PAGES = 256
NODES = 64
LARGE = 1 << 16  # bytes of a page that is taken for training only if there are not enough shorter ones
ROWS = 24_000  # nodes that the trees are fitted on
TEXT = 2000  # characters of a paragraph in a layout
LAYOUTS = 768  # at least, over the sampled pages
TREES, DEPTH = 60, 5
WORDS = 4096  # attribute words with weights
SWITCH = 1.0  # what beginning or leaving a main part costs, in log odds

# Class names for layouts.
MAIN_NAMES = """article article-body article-content body-text content entry entry-content main-content page-content post post-body post-content
    post-text prose rich-text story story-body text""".split()
SIDE_NAMES = {
    "menu": "menu main-menu nav navbar navigation breadcrumb breadcrumbs topbar tabs pagination pager toc".split(),
    "header": "header site-header masthead top-header page-header brand logo".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "sidebar": "sidebar side widget widgets related related-posts recommended trending popular more-links tags tag-cloud author-box share social".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert banner popup modal overlay newsletter subscribe paywall promo message".split(),
    "advert": "ad ads advert advertisement adsbox sponsor sponsored promoted banner-ad ad-slot adsense".split(),
    "form": "form search search-form login signup contact-form newsletter-form subscribe-form".split(),
    "comments": "comments comment comment-list commentlist replies reply discussion responses disqus reader-comments feedback".split(),
}
SIDE_TAGS = {"menu": ["nav", "div", "ul", "menu"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
             "notice": ["div", "section", "dialog", "p"], "advert": ["div", "aside", "section", "p"], "form": ["form", "div"],
             "comments": ["section", "div", "ol", "article"]}
_MAIN_TAGS, _SIDE_ELEMENTS = ("article", "main"), ("nav", "aside", "footer", "form", "dialog", "menu", "button")
_SIDE_WORDS = {n for names in SIDE_NAMES.values() for n in names} - {"tags", "side", "bottom", "message", "top-header", "page-header", "header", "logo", "brand"}


# ------------------------------------------------------------------ labels
def _labels(page: Page) -> list[bool] | None:
    """Which nodes are main text, by what the page says; None if it says nothing."""
    marked = any(g is not None for g in page.given)
    if not marked and not any(t in _MAIN_TAGS for t in page.tag):
        return None
    out = []
    for tag, up, tokens, given in zip(page.tag, page.parent, page.tokens, page.given):
        inside = up >= 0 and out[up]
        if given is not None:
            inside = given
        elif not marked:
            if tag in _SIDE_ELEMENTS or _SIDE_WORDS & set(tokens):
                inside = False
            elif tag in _MAIN_TAGS and not any(t in _SIDE_ELEMENTS for t in (page.tag[up],)):
                inside = True
        out.append(inside)
    return out


# ------------------------------------------------------------------ layouts
class _Layout:
    """One page made of given paragraphs, with the main part marked."""

    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts = rng, texts or ["Text."]

    def words(self, low: int, high: int) -> str:
        words = self.rng.choice(self.texts).split() or ["Text"]
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(words) - n + 1))
        return html.escape(" ".join(words[at:at + n]), quote=False)

    def prose(self) -> str:
        text, x = self.rng.choice(self.texts), self.rng.random()
        if x < 0.4:
            text = text[: self.rng.randint(20, 200)] if x < 0.2 else re.sub(r"[.,;:!?]", "", text)
        return html.escape(text, quote=False)

    def attribute(self, names: list[str], often: float) -> str:
        if self.rng.random() >= often:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"'

    def links(self, n: int) -> str:
        wrap = self.rng.choice([("<ul>", "<li>", "</li>", "</ul>"), ("", "<li>", "", ""), ("", "", " | ", ""), ("<p>", "", " ", "</p>")])
        return wrap[0] + "".join(f'{wrap[1]}<a href="/x">{self.words(1, 5)}</a>{wrap[2]}' for _ in range(n)) + wrap[3]

    def side(self, kind: str) -> str:
        rng, tag = self.rng, self.rng.choice(SIDE_TAGS[kind])
        named = 1.0 if kind in ("notice", "advert", "comments", "sidebar") and tag in ("div", "section", "p", "ol", "article") else 0.7
        if kind in ("menu", "sidebar"):
            inner = (f"<h3>{self.words(1, 3)}</h3>" if rng.random() < 0.4 else "") + self.links(rng.randint(2, 12))
            inner += f"<p>{self.words(3, 20)}</p>" if kind == "sidebar" and rng.random() < 0.4 else ""
        elif kind == "header":
            inner = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 8)}</p>" if rng.random() < 0.5 else "") + (
                self.links(rng.randint(2, 6)) if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "", "<p>"]) + self.words(3, 20) + (self.links(rng.randint(1, 8)) if rng.random() < 0.5 else "")
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q>" + (f"<p>{self.words(3, 12)}</p>" if rng.random() < 0.5 else "") + f"<button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            wrap = rng.choice(['<div class="comment">', "<li>", '<article class="comment">', "<div>"])
            inner = (f"<h3>{self.words(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(
                f"{wrap}<p>{self.words(1, 3)}</p><p>{self.prose()}</p></{wrap[1:].split(' ')[0].rstrip('>')}>" for _ in range(rng.randint(1, 5)))
        else:
            inner = self.words(3, 25) if rng.random() < 0.5 else f"<p>{self.words(3, 25)}</p>" + (f'<a href="/y">{self.words(1, 3)}</a>' if rng.random() < 0.5 else "")
        return f'<{tag}{self.attribute(SIDE_NAMES[kind], named)} data-mw="0">{inner}</{tag}>'

    def main(self, bare: bool) -> str:
        rng, parts = self.rng, []
        paragraph = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"])
        if rng.random() < 0.8:
            parts.append(f"<h1>{self.words(2, 12)}</h1>")
        for _ in range(rng.randint(1, 10)):
            x = rng.random()
            if x < 0.7:
                parts.append(paragraph.format(self.prose()))
            elif x < 0.78:
                parts.append(f"<h2>{self.words(1, 6)}</h2>" + paragraph.format(self.prose()))
            elif x < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif x < 0.88:
                parts.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif x < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif x < 0.95:
                parts.append(f"<pre>{self.words(3, 20)}</pre>")
            else:
                parts.append(f'<p>{self.words(3, 15)} <a href="/z">{self.words(1, 4)}</a> {self.words(3, 15)}</p>')
            if rng.random() < 0.08:
                parts.append(self.side(rng.choice(["advert", "sidebar", "notice", "form"])))
        if bare:
            return "".join(parts)
        tag = rng.choice(["div", "div", "section", "article", "article", "main"])
        return f'<{tag}{self.attribute(MAIN_NAMES, 0.7)} data-mw="1">{"".join(parts)}</{tag}>'

    def page(self) -> Page:
        rng, bare = self.rng, self.rng.random() < 0.15  # or the main part has no element of its own
        often = rng.choice([0, 0.3, 0.6, 0.9])
        before = [self.side(k) for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < often]
        after = [self.side(k) for k in ("sidebar", "comments", "form", "advert", "notice", "menu", "footer") if rng.random() < often]
        rng.shuffle(before)
        if rng.random() < 0.5:
            rng.shuffle(after)
        body = "".join(before) + self.main(bare) + "".join(after)
        for _ in range(0 if bare else rng.randint(0, 3)):
            body = f'<div{self.attribute(["wrapper", "container", "page", "row", "layout", "site"], 0.6)}>{body}</div>'
        page = Page(body)
        page.given[0] = bare
        return page


def _shortened(source: str, rng: random.Random) -> str:
    """The page with a few short paragraphs only."""
    head, *parts = re.split(r"(?=<p[\s>])", source)
    if not parts:
        return source
    rest = re.search(r"</(?!p\b)[a-z]+>\s*(?=</|<[a-z]+|\Z)[\s\S]*", parts[-1])
    size = rng.randint(8, 60)
    kept = [re.sub(rf"([^<>]{{{size}}})[^<>]+", r"\1", p) for p in parts[: rng.randint(1, 3)]]
    return re.sub(rf"(<h1>[^<>]{{{size}}})[^<>]+", r"\1", head) + "".join(kept) + (rest.group() if rest and len(kept) < len(parts) else "")


def _layout_pages(page: Page, rng: random.Random, n: int) -> list[Page]:
    texts = [t[:TEXT] for t in page.blocks([True] * len(page.tag)) if len(t) >= 40][:64]
    return [_Layout(rng, texts).page() for _ in range(n)]


# ------------------------------------------------------------------ training
@dataclass(frozen=True)
class Model:
    trees: Trees
    weights: dict[str, float]


def _examples(layouts: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for source, seed in zip(b.column(0), b.column(1).to_pylist()):
                yield from _example_rows(source.as_py(), seed, layouts)
        release_memory()
    return run


def _example_rows(source: str, seed: int, layouts: int) -> Iterator[pa.RecordBatch]:
    """Per page a row: features of its nodes without weights, labels, attribute words of nodes and of their ancestors."""
    own, rng = Page(source), random.Random(seed)
    for page in [own, Page(_shortened(source, rng)), *_layout_pages(own, rng, layouts)]:
        labels = _labels(page)
        if labels is None:
            continue
        batch = Batch([page])
        x, own_text = batch.features({}), np.zeros(len(labels))
        for node, text in filter(None, page.items):
            own_text[node] += len(text.strip())
        around = ~np.array(labels) & (own_text.sum() > 0) & (batch.summed(own_text * ~np.array(labels)) == 0) & (batch.summed(own_text) > 0)
        nodes = np.flatnonzero(~around).tolist()  # not those around nothing but main text, which may count as either
        nodes = nodes if len(nodes) <= NODES else sorted(rng.sample(nodes, NODES))
        above: list[tuple[str, ...]] = []
        for up in page.parent:
            above.append(() if up < 0 else (*page.tokens[up], *above[up])[:32])
        yield pa.RecordBatch.from_arrays([
            pa.array([seed], pa.int64()), pa.array([x[nodes].tobytes()], pa.binary()), pa.array([[labels[i] for i in nodes]], pa.list_(pa.bool_())),
            pa.array([[" ".join(page.tokens[i]) for i in nodes]], pa.list_(pa.string())),
            pa.array([[" ".join(above[i]) for i in nodes]], pa.list_(pa.string()))], names=["seed", "x", "y", "own", "above"])


def _word_weights(rows: list[tuple[str, bool]]) -> dict[str, float]:
    """Log odds of each attribute word that several nodes have, smoothed."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for words, label in rows:
        for w in set(words.split()):
            counts[w][label] += 1
    common = sorted(counts, key=lambda w: (-counts[w].total(), w))[:WORDS]
    return {w: float(np.clip(np.log((counts[w][True] + 0.5) / (counts[w][False] + 0.5)), -4, 4)) for w in common if counts[w].total() >= 3}


def _with_weights(x: np.ndarray, own: list[str], above: list[str], weights: dict[str, float]) -> np.ndarray:
    first = FEATURES.index("token_best")
    for column, words, pick in ((0, own, max), (1, own, min), (2, above, max), (3, above, min)):
        x[:, first + column] = [pick(0.0, *(weights.get(t, 0.0) for t in w.split())) if w else 0.0 for w in words]
    return x


def train(docs: DataFrame, html_col: str = "html", pages: int = PAGES) -> Model:
    """Trees and word weights from a sample of the pages; the driver gets its feature rows."""
    rows = docs.select(F.expr(valid_utf8(f"CAST(`{html_col}` AS STRING)")).alias("html")).where("html <> ''")
    keyed = rows.select("html", (F.octet_length("html") > LARGE).alias("large"), F.xxhash64("html").alias("h"))
    last = keyed.select("large", "h").distinct().orderBy("large", "h").limit(pages).collect()
    sample = keyed.limit(0)
    if last:
        large, h = last[-1]
        sample = keyed.where((F.col("large") < F.lit(large)) | ((F.col("large") == F.lit(large)) & (F.col("h") <= F.lit(h)))).dropDuplicates(["large", "h"])
    found = sample.select("html", F.col("h").alias("seed")).mapInArrow(
        _examples(max(3, -(-LAYOUTS // max(1, len(last))))), "seed long, x binary, y array<boolean>, own array<string>, above array<string>").collect()
    found = sorted(found, key=lambda r: (r.seed, r.x)) or _layout_examples()
    folds = [[], []]
    for k, r in enumerate(found):
        folds[r.seed % 2].append(r)
    table = [_word_weights([p for r in fold for p in zip(r.own, r.y)]) for fold in folds]
    x = np.concatenate([_with_weights(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).copy(), r.own, r.above, table[1 - f] or table[f])
                        for f, fold in enumerate(folds) for r in fold])
    y = np.array([v for fold in folds for r in fold for v in r.y], float)
    chosen = np.random.default_rng(0).permutation(len(y))[:ROWS]
    return Model(fit(x[chosen], y[chosen], TREES, DEPTH), _word_weights([p for r in found for p in zip(r.own, r.y)]))


def _layout_examples():
    """For a table without text: layouts of one paragraph."""
    from types import SimpleNamespace

    rows = [r for seed in range(8) for r in _example_rows("<p>Some text, of no page at all, for want of any page.", seed, LAYOUTS // 8)]
    return [SimpleNamespace(**{k: v[0] for k, v in r.to_pydict().items()}) for r in rows]


# ------------------------------------------------------------------ decoding
def decode(batch: Batch, odds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The most probable consistent states of all nodes; True where a node is main text."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    outside, main, left = no.copy(), yes.copy(), no.copy()
    for level in batch.levels[:0:-1]:
        up = batch.parent[level]
        np.add.at(outside, up, np.maximum(outside[level], main[level] - switch))
        np.add.at(main, up, np.maximum(main[level], left[level] - switch))
        np.add.at(left, up, left[level])
    state = np.zeros(len(odds), np.int8)  # 0 outside, 1 main, 2 left out
    for k, level in enumerate(batch.levels):
        up = state[batch.parent[level]] if k else np.zeros(len(level), np.int8)
        state[level] = np.select([up == 0, up == 1], [(main[level] - switch > outside[level]).astype(np.int8), np.where(left[level] - switch > main[level], 2, 1)], 2)
    return state == 1


def extract(pages: list[Page], model: Model) -> list[list[str]]:
    """Blocks of the main text of each page."""
    batch = Batch(pages)
    keep = decode(batch, model.trees.log_odds(batch.features(model.weights)))
    return [p.blocks(keep[a:b]) for p, a, b in zip(pages, batch.first.tolist(), batch.first[1:].tolist())]


def main_text(docs: DataFrame, model: Model, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: its keys, and its main text, blocks apart by an empty line."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.expr(valid_utf8(f"CAST(`{html_col}` AS STRING)")), F.lit("")).alias("_html"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in pieces(frames, "_html", 1 << 19):
                texts = extract([Page(s.as_py()) for s in b.column(b.num_columns - 1)], model) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(["\n\n".join(t) for t in texts], pa.string())], names=[*keys, "text"])
        finally:
            release_memory()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, text string")
