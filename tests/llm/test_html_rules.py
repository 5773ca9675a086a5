"""Pages that say little or something odd about their structure."""

import re
import time

import pytest

from tracewarden.llm.html_text import main_text

TEXT = "The text of the page is here and it is long enough to be of use to all who read it, as it has many words in it. " * 3
P = TEXT.strip()


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div class='content has-sidebar'><p>{TEXT}</p></div>", P),
        (f"<div class='post no-comments'><p>{TEXT}</p></div>", P),
        (f"<div class='with-footer'><div id='content-sidebar-wrap'><p>{TEXT}</p></div></div>", P),
        (f"<div class='content-sidebar-wrap'><p>{TEXT}</p><div class='comments'><p>{TEXT} nice</p></div></div>", P),
        (f"<article><p>{TEXT}<a href=x>open <p>{TEXT}</p><p>{TEXT}</p></article>", f"{P} open\n{P}\n{P}"),
        (f"<article><p>Read this next.</p></article><div><p>{TEXT}</p><p>{TEXT}</p></div>", f"{P}\n{P}"),
        (f"<article><p>{TEXT}<span class='advert'>Buy now!</span> end</p></article>", f"{P} end"),
        (f"<article><p>{TEXT}<span class='advert'>Buy <span>now</span>!</span> end <b>x</b></p></article>", f"{P} end x"),
        (f"<article><p>{TEXT}<span hidden>never closed<p>{TEXT}</p></article>", f"{P}\n{P}"),
        (f"<article><p>{TEXT}<math><mi>x</mi></math></p></article>", f"{P} x"),
        (f"<div class='cookies-enabled'><p>{TEXT}</p></div>", P),
        (f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h1>Title</h1><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p><p>© someone</p></body>", f"Title\n{P}\nShort.\n{P}"),
        ("<div class='ad'>Buy this and that and more of it now.</div><div><h1>Tiny.</h1><p>Tiny.</p></div>", "Tiny.\nTiny."),
        (None, ""),
        ("", ""),
    ],
)
def test_page(html, want):
    assert main_text(html) == want


def test_same_text_without_the_article_element(spark, sf):
    """Length, stop words, links and neighbours give what the page's own mark gives."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert main_text(re.sub(r"(</?)article", r"\1div", r.html)) == main_text(r.html)


def test_stray_end_tags():
    began = time.perf_counter()
    assert main_text("<div>" * 8000 + "</p>" * 8000 + TEXT) == P
    assert time.perf_counter() - began < 2
