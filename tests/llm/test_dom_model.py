import html
import re
import time

import numpy as np
import pytest
from harvestlens.llm import dom_model


@pytest.fixture(scope="module")
def model(spark, sf):
    return dom_model.fit(dom_model.training_pages(spark.read.parquet(f"{sf}/pages.parquet")))


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    model = dom_model.Model(rng.normal(size=len(dom_model.NAMES)), rng.normal(size=(2, 2)))
    nodes, _ = dom_model.parse("<html><body><nav><a href=x>m</a></nav><div><p>one</p><p>two</p></div></body></html>")
    n = len(nodes)
    total, ones = 0.0, np.zeros(n)
    for state in range(2**n):
        s = [(state >> i) & 1 for i in range(n)]
        score = sum(s[i] * sum(model.own[f] for f in nodes[i].features) for i in range(n)) + sum(model.pair[s[nodes[i].parent], s[i]] for i in range(1, n))
        total += np.exp(score)
        ones += np.exp(score) * np.array(s)
    assert np.allclose(dom_model.marginals(nodes, model)[0], ones / total)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var x = "</p><article>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div><!-- <p>no</p> -->
<article><header><h2>Head&shy;line</h2></header><p>One  <b>bold</b>
 line &lt;here&gt; 3 < 4<p>Two<br>lines<div class=ad>Buy now</div><ul><li>first <a href=x>link</a> in a longer item of the text</li><li>second</ul>
<blockquote>Quoted &eacute;&#233;</blockquote><form><label>Name</label><input name=n><textarea>t</textarea></form><table><tr><td>c1<td>c2</table></article>
<aside class="sidebar"><p>Related things that are rather long, so that length alone does not tell what they are</p></aside>
<section id="comments"><h3>Comments</h3><p>First! A reader wrote this comment and went on for quite a while about it</p></section>
<footer>&copy; Somebody</footer></body></html>"""


def test_article_of_a_full_page(model):
    text = dom_model.main_text(PAGE, model)
    assert text.split("\n") == [
        "Head\xadline", "One bold line <here> 3 < 4", "Two lines", "first link in a longer item of the text", "second", "Quoted éé", "c1", "c2",
    ]


def test_pages_without_an_article(model):
    page = "<body><div class='nav-bar'><a href=1>a</a></div><div id='main-content'><p>Kept text.</p><span class=advert>no</span></div><div class='page-footer'>x</div></body>"
    assert dom_model.main_text(page, model) == "Kept text."
    assert dom_model.main_text("<p>Just a paragraph <i>alone", model) == "Just a paragraph alone"
    assert dom_model.main_text("plain text, no markup", model) == "plain text, no markup"
    assert dom_model.main_text("<p>open <a href='x>never closed", model).startswith("open")


def test_custom_elements_and_formulas(model):
    page = """<html><body><nav><a href=x>menu</a></nav><article><h1>Title of the page</h1><p>One paragraph of the article</p><video-js id="v">player text</video-js>
<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given</p><button-group>pressed</button-group><video src=v>no video</video><button>OK</button>
<p>See <object data=o><param name=p>the text instead</object> here</p><template-x>of a template</template-x><p>Last paragraph of the article</p></article></body></html>"""
    assert dom_model.main_text(page, model).split("\n") == [
        "Title of the page", "One paragraph of the article", "player text", "Let x=2 be given", "pressed", "See the text instead here", "of a template",
        "Last paragraph of the article",
    ]


def test_every_page_against_its_article(spark, sf):
    """The tables' pages have one article of headings and paragraphs, which a pattern can read."""
    got = {r["page_id"]: r for r in dom_model.op5_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 20000 + "</article>" + "<div>" * 3000
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a", "x"), (4, "u", long, "x"), (4, "u", long, "x")], "page_id long, url string, html string, text string")
    rows = [tuple(r) for r in dom_model.extract(df).collect()]
    assert (1, "u", "", 0) in rows and (2, None, "", 0) in rows and (None, "u", "a", 1) in rows
    assert [r[3] for r in rows if r[0] == 4] == [20000 * 5 - 1] * 2
    assert dom_model.extract(df.limit(0)).count() == 0


ARTICLE = "<p>One paragraph of the article</p>{}<p>Last paragraph of the article</p>"
FRAME = "<html><body><nav><a href=x>menu</a></nav><article><h1>Title of the page</h1>{}</article><footer>end</footer>{}</body></html>"
WHOLE = ["Title of the page", "One paragraph of the article", "Last paragraph of the article"]


@pytest.mark.parametrize("between, after", [
    ("<button>", ""), ("<button>", "<button>OK</button>"), ("<select><option>a", ""), ("<video src=v>", ""), ("<svg><path d='x'>", ""), ("<template>", ""),
    ("<svg><svg><title>inner</title></svg><text>outer</text></svg>", ""), ("<noscript><img src=x></noscript>", ""), ("<noscript>", ""), ("<iframe src=x>", "<iframe src=y></iframe>"),
    ("<template><p>a</p><template><p>b</p></template><p>c</p></template>", ""), ("<button>a<button>b</button>", ""), ("<audio><p>none</p></audio>", ""),
    ("<script src='x'/>var a = '<p>';</script>", ""), ("<script src='x'/>", ""), ("<script src='x'/>", "<script>if (a < b) {}</script>"), ("<SCRIPT>var a = 1</Script >", ""),
    ("<style>p > a {}</style>", ""), ("<textarea><p>typed</textarea>", ""), ("<!-- <article> --><!---->", ""), ("<!-- a -- b > c -->", ""), ("<? x ?><!x>", ""), ("</button></select></svg></div></x>", ""),
    ("<svg/>", ""), ("<canvas></canvas>", "<svg><script>x</script></svg>"),
])
def test_unclosed_nested_and_empty_elements(model, between, after):
    # an element that is never closed, or only after the article, is no more than its tag, so what it holds stays
    text = dom_model.main_text(FRAME.format(ARTICLE.format(between), after), model).split("\n")
    assert [line for line in text if line not in ("a", "b")] == WHOLE


def test_noscript(model):
    page = FRAME.format(ARTICLE.format("<noscript><p>Please turn on scripts to see the comments of our readers</p></noscript>"), "")
    assert dom_model.main_text(page, model).split("\n") == WHOLE
    inside = "<html><body><div id=app></div><noscript><article><h1>Title of the page</h1>" + ARTICLE.format("") + "</article></noscript></body></html>"
    assert dom_model.main_text(inside, model).split("\n") == WHOLE
    both = inside.replace("<div id=app></div>", "<article><h1>Title of the page</h1>" + ARTICLE.format("") + "</article>")
    assert dom_model.main_text(both, model).split("\n") == WHOLE


@pytest.mark.parametrize("piece", [
    "<svg ", "<button>", "<svg>", "</button>", "<a \"'", "<a '", '"', "'", "<", "<!", "<!--", "<?", "<script>", "<script/>", "<script src='x'/>", "</script>", "<noscript>", "<template><p>",
    "<noscript><article>", "<p>", "<li>", "<div></x>", "<span class=a>", "<header>", "<tr><td>", "&", "&#", "<a b=\"<a c='", "<p a a a ", "<textarea/>", "<main>", "</p>", "<div>", "</div>",
])
def test_a_megabyte_of_one_piece_is_read_in_a_moment(piece):
    page = "<article><p>kept</p>" + piece * (1_000_000 // len(piece))
    start = time.process_time()
    dom_model.tags(page)
    assert time.process_time() - start < 2
    # what builds a node each is measured on a tenth
    start = time.process_time()
    dom_model.parse(page[:100_000])
    assert time.process_time() - start < 2


def test_ends_without_a_start_in_a_deep_page():
    start = time.process_time()
    dom_model.parse("<div>" * 20000 + "</section>" * 20000 + "<li>" * 2000)
    assert time.process_time() - start < 2
