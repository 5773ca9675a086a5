import re
from html import unescape

import pytest

from tracewarden.llm.html_text import blocks, extract, main_text
from tracewarden.llm.queries import op6_html

LONG = "The cat sat on the mat and it was the best of all the mats that there had been in this house for many of the years. " * 2


def article_text(html):
    """The article of the synthetic pages, by their own regular form."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in parts]
    return "\n".join(p for p in parts if p)


def test_query_on_synthetic_pages(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        rows = op6_html(spark, sf).collect()
        assert len(rows) == len(pages)
        for r in rows:
            assert r.text == article_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<br>three</p>", "one\ntwo three"),
    ("<article><h1>T</h1><p>a</p><aside>no</aside><div class='share-box'>no</div><p>b</p></article><p>after</p>", "T\na\nb"),
    ("<main><header><h1>T</h1></header><p>x</p><section id=comments><p>hi</p></section></main>", "T\nx"),
    ("<article><header><h1>T</h1></header><p>x</p><form><p>mail</p></form></article>", "T\nx"),
    ("<body><header>H</header><nav>N</nav><div class=content><p>Kept &lt;b&gt; text</p></div><footer>F</footer>", "Kept <b> text"),
    ("<div class='cookie-notice'>We use cookies</div><p>" + LONG + "</p><p>Short.</p><p>" + LONG + "</p><p><a href=x>link</a></p>", f"{LONG.strip()}\nShort.\n{LONG.strip()}"),
    ("<h2>Heading</h2><p>" + LONG + "</p><p>Menu one</p><p><a href=1>a</a> <a href=2>b</a></p>", f"Heading\n{LONG.strip()}\nMenu one"),
    ("<article><p>x<!-- <p>no</p> -->y<script>var a='</p>';</script>z</p></article>", "xyz"),
    ("<article><p>unclosed <b>bold", "unclosed bold"),
    ('<article><p title="a>b">q &nbsp; &euro;\n\t r</p><p hidden>h</p></article>', "q € r"),
    ("<article><p>a < b and 3 <4</p></article>", "a < b and 3 <4"),
    ("<p>" + "zyx wvu " * 40 + "</p><p>qpo</p>", ("zyx wvu " * 40).strip() + "\nqpo"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_pages(html, text):
    assert main_text(html) == text


def test_short_blocks_follow_their_neighbours():
    bad = "<p>" + "<a href=x>link text here</a> " * 5 + "</p>"
    html = bad + "<p>stray</p>" + bad + f"<p>{LONG}</p><p>kept</p><p>{LONG}</p>"
    assert main_text(html).split("\n") == [LONG.strip(), "kept", LONG.strip()]


def test_all_text_is_in_some_block():
    assert [b.text for b in blocks("<div>a<p>b</p>c</div>d")] == ["a", "b", "c", "d"]


def test_nulls_repeats_clashing_columns_and_long_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (3, "u", "<article>" + "<p>word</p>" * 50_000, "t")], "page_id long, url string, html string, text string")
    rows = extract(pages).collect()
    assert sorted((r.page_id, len(r.text)) for r in rows) == [(1, 0), (2, 0), (2, 0), (3, 5 * 50_000 - 1)]
    assert extract(pages.limit(0)).count() == 0
