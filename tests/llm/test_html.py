"""Main text of pages: reading, boosting, decoding against all states, and held-out accuracy."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from maskwright.llm import html_extract as he
from maskwright.llm.boosting import fit
from maskwright.llm.dom import FEATURES, Batch, Page
from maskwright.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def blocks(source):
    page = Page(source)
    return page.blocks([True] * len(page.tag))


@pytest.mark.parametrize("source, want", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a  \n b\t</p>c", ["a b", "c"]), ("a<br>b", ["a b"]),
    ("<p><b>a<br><p>b", ["a", "b"]), ("a<b>b</b>c <i>d", ["abc d"]), ("x</p>y", ["x", "y"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
    ("&amp;&lt;p&gt; &eacute;&#233;&#xe9; &am &copy;", ["&<p> ééé &am ©"]), ("a&nbsp;&nbsp;b", ["a b"]),
    ("<script>var t='</p>';if(a<b)</script>x<style>p{}</style>", ["x"]), ("<SCRIPT>x</ScRiPt >y", ["y"]), ("a<script>never closed", ["a"]),
    ("<title>t</title>a<!-- <p>no</p> -->b<!-->c<!doctype x>d", ["abcd"]), ("a < b <3 c</ >d", ["a < b <3 cd"]),
    ('<a title="x>y" href=q>l</a>m', ["lm"]), ("<p title='a>b'>c", ["c"]), ('<p title="open>c', ["c"]), ("<p class=it's>x <i>isn't</i>", ["x isn't"]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<select><option>x</select>y<textarea><p>z</textarea>", ["y"]), ("<h1>a<h2>b</h1>c", ["a", "b", "c"]), ("</div></p></x>a", ["a"]),
    ("<td>a</div>b</td>c", ["ab", "c"]), ("<p>a<span>b<span class=k>c</span>d</span>e", ["abcde"]), ("a<", ["a<"]), ("a<b", ["a"]),
    ("<svg><text>no</text></svg>yes", ["yes"]), ("a<hr>b", ["a", "b"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
])
def test_reading(source, want):
    assert blocks(source) == want


def test_hostile_pages_take_linear_time():
    start = time.time()
    for source in ("<div>" * 20_000 + "x", "<p>a" * 50_000, "<li>a" * 50_000, "</div>" * 50_000, "<table><tr><td>" * 2_000 + "x", '<a href="' * 50_000,
                   "<!--" * 50_000, "<b" * 50_000, "&" * 100_000, "<span class=a>" * 20_000 + "</p>" * 20_000):
        page = Page(source)
        Batch([page]).features({})
    assert time.time() - start < 60


def test_boosting_learns_and_repeats():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] + x[:, 1] > 0)).astype(float)
    a, b = fit(x[:3000], y[:3000]), fit(x[:3000], y[:3000])
    assert ((a.log_odds(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.93
    assert np.array_equal(a.log_odds(x), b.log_odds(x))
    assert np.isfinite(fit(x[:1], y[:1]).log_odds(x)).all()


@pytest.mark.parametrize("seed", range(30))
def test_decoding_is_the_best_consistent_choice(seed):
    rng = random.Random(seed)
    page = Page("")
    for i in range(1, 7):
        page.tag.append("div"), page.parent.append(rng.randrange(i)), page.tokens.append(()), page.given.append(None)
        page.links.append(0), page.linked.append(0)
    odds = np.array([rng.gauss(0, 2) for _ in page.tag])
    keep = he.decode(Batch([page]), odds, 0.7)
    follows = {0: (0, 1), 1: (1, 2), 2: (2,)}

    def value(states):
        total = 0
        for i, s in enumerate(states):
            up = states[page.parent[i]] if i else 0
            if s not in follows[up]:
                return -np.inf
            total += (-np.logaddexp(0, -odds[i]) if s == 1 else -np.logaddexp(0, odds[i])) - 0.7 * (s != up)
        return total
    best = max(itertools.product(range(3), repeat=7), key=value)
    assert keep.tolist() == [s == 1 for s in best]


def expected(source):
    """What an ``article`` of headings and paragraphs holds."""
    a = re.search(r"<article>([\s\S]*?)(?:</article>|\Z)", source).group(1)
    parts = (re.sub(r"</?b>", "", p).replace("<br>", " ") for p in re.split(r"</?(?:p|h1)>", a))
    return "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


@pytest.fixture(scope="module")
def model(spark):
    return he.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_held_out_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 250")
    got = {r.page_id: r.text for r in he.main_text(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert sum(got[r.page_id] == expected(r.html) for r in rows) >= 0.99 * len(rows)


def test_held_out_layouts(spark, model):
    sources = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 250").limit(80).collect()]
    right = wrong = missed = 0
    for i, source in enumerate(sources):
        layout = he._Layout(random.Random(10**6 + i), [t for t in blocks(source) if len(t) >= 40])
        page = layout.page()
        batch, labels = Batch([page]), he._labels(page)
        keep = he.decode(batch, model.trees.log_odds(batch.features(model.weights)))
        for node, text in (x for x in page.items if x):
            right += len(text) * (keep[node] and labels[node])
            wrong += len(text) * bool(keep[node] and not labels[node])
            missed += len(text) * bool(labels[node] and not keep[node])
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.96


def test_hand_made_pages(model):
    prose = "The committee met on Tuesday, and after a long debate it agreed on the budget for next year. Members were pleased. "
    page = f"""<html><head><title>T</title></head><body><div class="cookie-banner">We use cookies. <button>OK</button></div>
        <nav><a href=/>Home</a> <a href=/a>News</a></nav><div class="post-content"><h1>Budget agreed</h1><p>{prose * 2}</p>
        <div class="ad">Buy now, cheap!</div><p>{prose * 3}</p></div>
        <aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>One more story</a><li><a href=/y>Another one</a></ul></aside>
        <div id="comments" class="comments"><div class="comment"><p>Anna</p><p>I do not agree, {prose}</p></div></div>
        <form class="newsletter"><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 The Paper</footer></body></html>"""
    assert he.extract([Page(page)], model) == [["Budget agreed", " ".join((prose * 2).split()), " ".join((prose * 3).split())]]


def test_edge_rows_and_clashing_names(spark, model):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", " \n", 3), (3, "u", "<nav><a href=x>y</a></nav>", 4), (3, "u", "<p>", 5),
            (4, "u", "<article><p>" + "word " * 200_000 + "</article>", 6), (4, "u", "<article><p>Same here, and again.</p></article>", 7)] + [
            (5, "u", "<article><p>Same here, and again.</p></article>", 8)] * 2
    docs = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, text INT").withColumn("_html", docs_invalid())
    got = he.main_text(docs, model)
    assert got.columns == ["page_id", "url", "text"]
    texts = sorted((r.page_id or 0, len(r.text)) for r in got.collect())
    assert texts[0] == (0, 0) and texts[1:3] == [(1, 0), (2, 0)] and texts[3:5] == [(3, 0), (3, 0)] and texts[-1] == texts[-2] and len(texts) == 9
    assert (4, 200_000 * 5 - 1) in texts
    broken = spark.createDataFrame([(1, "u")], "page_id LONG, url STRING").selectExpr("*", "concat('<article><p>a', CAST(unhex('E2') AS STRING), 'b') AS html")
    assert he.main_text(broken, model).first().text == "a\ufffdb"


def docs_invalid():
    from pyspark.sql import functions as F
    return F.lit("x")


def test_query_and_tables_without_rows(spark, tmp_path):
    got = QUERIES["op13_main_text"](spark, SF_DIR)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = got.collect()
    assert sum(r.text == expected(pages[r.page_id]) for r in rows) >= 0.99 * len(pages) and all(r.n_chars == len(r.text) for r in rows)
    spark.createDataFrame([], "page_id LONG, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op13_main_text"](spark, str(tmp_path)).collect() == []


def test_training_on_pages_that_name_no_article(spark):
    """Long pages, and none with a label of its own: the layouts teach."""
    prose = "It was a bright day in April, and the clocks were striking. "
    docs = spark.createDataFrame([(f"<div><p>{prose * 2000}{i}</p></div>",) for i in range(12)], "html STRING")
    model = he.train(docs)
    assert model.weights and len(FEATURES) == Batch([Page("x")]).features({}).shape[1]
    assert he.extract([Page(f"<div class=menu><a href=x>y</a></div><div class=post><p>{prose * 9}</p></div>")], model) == [[(prose * 9).strip()]]
