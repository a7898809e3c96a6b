"""Extraction against pages whose article is known, and importance against entropies worked out by hand."""

import html
import random
import re
from math import log

import pytest
from pyspark.sql import functions as F

from quern.llm import extraction
from quern.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def text_of(page):
    return " ".join(b[1] for b in extraction.blocks_of(page)[0])


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in extraction.extracted(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_query_equals_the_article_of_each_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = QUERIES["op12_html_extraction"](spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search("<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        want = " ".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split("<[^>]*>", article)) if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>one <b>bo</b>ld<p>two<br>three", "one bold two three"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>e<dd>f</dl>", "a b c d e f"),
        ("<table><tr><td>a<td>b<tr><th>c</table>after", "a b c after"),
        ("x &amp;lt; &lt;b&gt; &copy &#233;&#x4e2d; &am <p>&amp</p>", "x &lt; <b> © é中 &am &"),
        ("a < b and c <3 <p title=don't>d</p><a href='>'>e</a>", "a < b and c <3 d e"),
        ("x<!-- <p>no</p> --> y <![CDATA[z]]> <?php w ?> </ > v", "x y v"),
        ("<script>if (a < b) '</p>'</script>x<style>p{}</style><SCRIPT>y</SCRIPT >z<noscript>on</noscript><textarea><p>t</textarea>", "x z"),
        ("x<script>never closed <p>y", "x"),
        ("x<p>y<a hre", "x y"),
        ("<title>t</title><p>\n a \t b c </p>", "a b c"),
        ("</p></div>x</b></span>", "x"),
        ("", ""),
    ],
)
def test_markup(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<nav><a>m</a></nav><header><h1>Site</h1></header><aside>s</aside><article><h1>T</h1><p>x</p></article><footer>f</footer>",
        "<div class='cookie-banner'>c</div><main><h1>T</h1><p>x</p><div class=ad-slot>ad</div></main><section id=comments><article>c</article></section>",
        "<body class='has-sidebar'><article class='post with-comments'><header><h1>T</h1></header><p>x</p><footer>by</footer><form>f</form></article>",
        "<form><article><h1>T</h1><p>x</p><input value=y></article></form><form><p>search</p></form>",
        "<div role=navigation>n</div><div id=content><h1>T</h1><div class='relatedPosts'>r</div><p>x</p></div><div class=sidebar>s</div>",
        "<div hidden>h</div><div style='display: none'>h</div><p aria-hidden=true>h</p><h1>T</h1><p>x</p><span class=advert>a <span>b</span> c</span>",
        "<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Sport</a></ul><h1>T</h1><p><a href=4>x</a></p>",
        "<article><h1>T</h1><p>x</p><article class=comment>c</article></article><article class='teaser'>t</article>",
    ],
)
def test_marked_branches(page):
    assert text_of(page) == "T x"


def test_code_in_an_article_keeps_its_comments():
    assert text_of("<article><pre><span class=comment># x</span> y</pre><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>") == "# x y a b c"


def words(rng):
    return " ".join(rng.choice(("ab", "cd", "ef", "gh", "ij", "kl")) for _ in range(12))


def unmarked(rng, n):
    """A page without a mark, whose template is told from its article by its repetition alone."""
    article = [words(rng) for _ in range(1 + n % 5)]
    page = f"<div class=x1>Subscribe to read page {n}</div><div class=x2><h2>Summary</h2>{''.join(f'<p>{a}</p>' for a in article)}</div><div class=x3><p>All rights reserved</p><p>Contact us</p></div>"
    return page, " ".join(["Summary", *article])


def test_a_template_goes_by_its_entropy(spark):
    rng = random.Random(1)
    made = [unmarked(rng, n) for n in range(30)]
    rows = [(n, f"http://h.example/{n}", page) for n, (page, _) in enumerate(made)]
    assert texts(spark, rows) == {n: want for n, (_, want) in enumerate(made)}
    # Hosts of two pages say too little, and a page without a host is of no tree.
    few = [(n, f"http://h{n // 2}.example/{n}", page) for n, (page, _) in enumerate(made[:4])] + [(9, None, made[9][0])]
    assert all("rights reserved" in t for t in texts(spark, few).values())


def test_the_same_with_more_nodes_than_are_sent_to_all(spark, monkeypatch):
    monkeypatch.setattr(extraction, "FEW", 0)
    rng = random.Random(2)
    made = [unmarked(rng, n) for n in range(12)]
    rows = [(n % 6, f"http://h{n % 2}.example/{n}", page) for n, (page, _) in enumerate(made)]  # ids repeat
    found = extraction.extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in found) == sorted(want for _, want in made)


def test_copies_of_an_article_stay(spark):
    page = "<div class=b><h1>T</h1><p>same words</p></div>"
    assert set(texts(spark, [(n, "http://a.example/", page) for n in range(20)]).values()) == {"T same words"}
    near = [(n, "http://a.example/", f"<div class=b><h1>T</h1><p>same words</p><p>{'abcdefgh'[n]}</p></div>") for n in range(8)]
    assert all(t.startswith("T same words") for t in texts(spark, near).values())
    marked = [(n, "http://a.example/", f"<article><h1>T</h1><p>same words</p></article><footer>{n}</footer>") for n in range(8)]
    assert set(texts(spark, marked).values()) == {"T same words"}


def test_a_repeated_box_in_a_marked_article_goes(spark):
    rows = [(n, "http://a.example/", f"<article><h1>T {'abcdefgh'[n]}</h1><div class=z>Follow our channel</div><p>same</p></article>") for n in range(8)]
    assert texts(spark, rows) == {n: f"T {'abcdefgh'[n]} same" for n in range(8)}


def test_importance_is_one_less_the_entropy(spark):
    pages = ["<div class=a>x</div>", "<div class=a>x<p>z</p></div>", "<div class=a>y</div>", "<div class=a>w</div>"]
    tree = extraction.style_tree(extraction.parsed(spark.createDataFrame([(n, "http://h/", p) for n, p in enumerate(pages)], SCHEMA)))
    found = {(r.kind, r.pages): r.importance for r in tree.collect()}
    texts_h = (log(2) + 0 + 0) / 3 / log(4)  # x on two pages, y and w on one
    assert found["text", 4] == pytest.approx(1 - texts_h) and found["text", 1] == 1
    shapes = (log(4) - 3 * log(3) / 4) / log(4)  # three without, one with a paragraph
    own = 1 - 0.9**2
    assert found["elements", 4] == pytest.approx(own * shapes + (1 - own) * ((1 - texts_h) * 4 + 1) / 5)


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "http://a/", None), (1, None, ""), (None, "no host", "<p>a</p>"), (None, "no host", "<p>a</p>"), (2, "http://a/", deep), (3, "http://a/", "<p>word " * 50_000)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"text": F.lit(1), "host": F.lit("h"), "row": F.lit(2), "gone": F.lit(3)})
    found = extraction.extracted(table).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 1), (0, 1), (1, 0), (1, 0), (2, 1), (3, 249_999)]
    assert extraction.extracted(table.limit(0)).count() == 0
    assert {r.url for r in found} == {"http://a/", None, "no host"}
