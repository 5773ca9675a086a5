import pytest

from tests.llm.test_html_text import LONG
from tracewarden.llm.html_text import main_text

WRAPPERS = ["<div class='content-sidebar-wrap'>{}</div>", "<div id='page' class='has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<form action='/x'>{}</form>", "<form><div class=has-sidebar>{}</div></form>"]
MENU = "<nav><p>Nav</p></nav><div class=sidebar><p>Side text</p><a href=x>a link</a></div>"


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapper_named_like_boilerplate_keeps_its_page(wrapper):
    page = "<body>" + wrapper + "</body>"
    assert main_text(page.format(MENU + "<article><h1>T</h1><p>short</p></article>")) == "T\nshort"
    assert main_text(page.format(MENU + "<div role=main><p>short</p></div>")) == "short"
    assert main_text(page.format(MENU + f"<p>{LONG}</p><p>{LONG}</p>")) == f"{LONG.strip()}\n{LONG.strip()}"


def test_boilerplate_beside_an_article_stays_out():
    comments = f"<div class=comments><article><p>{LONG}</p></article></div>"
    assert main_text(f"<article><p>kept</p></article>{comments}") == "kept"
    assert main_text(f"<p>{LONG}</p><div class=sidebar><p>Side text</p></div>") == LONG.strip()
