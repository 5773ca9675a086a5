"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by itself, by its link density,
stop-word density and length and by what the page's own structure says (navigation, forms, asides, elements named as
adverts, comments and the like, and the article). Blocks that are too short to tell stay open. The second pass gives an open
block the label of its nearest decided neighbours: main text if both sides are, or if the nearer one is; boilerplate
otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Elements by what they do in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg select object canvas audio video map".split())
DROPPED = frozenset("nav aside footer form menu dialog button head fieldset label datalist".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "summary"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
# Words in class names and ids.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert nav navbar navigation menu "
    "submenu sidebar sidebars aside footer foot comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs popup modal overlay "
    "newsletter subscribe subscription signup signin login search widget widgets pagination pager copyright masthead toolbar skip hidden".split()
)
GOOD_NAMES = frozenset("article content post entry story main body maincontent articlebody".split())
SURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent comment comments commentlist disqus hidden".split())
LAYOUT_NAMES = GOOD_NAMES | frozenset("wrap wrapper container page layout site inner outer row grid area".split())
ABSENT = frozenset("no not has have with without is non hide".split())
# Frequent function words of several languages.
STOPWORDS = frozenset(
    "the of and to in a is that it for on was with be as by this are from at an or not have has but they his her which you we all were their one there been if who "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando "
    "le les des et est dans une du pour que qui au pas sur par plus ne se ce son avec il sont ou aux mais nous vous leur cette ses été "
    "di il che è e per non una sono del della con si da come le dei nel alla più o ma anche "
    "van het een dat op te zijn voor met niet aan er maar om ook bij nog uit naar dan door".split()
)
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
GOOD, BAD, OPEN = 1, -1, 0
SOFT = -2  # BAD by a class name or id, or as a form: may be a wrapper of the whole page


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    n_links: int
    inside: int  # GOOD in the article, BAD in boilerplate, else OPEN
    heading: bool


def _named(token: str) -> int:
    """What a class name or an id says: GOOD, BAD or nothing. A name that says what is absent or beside (no-comments,
    has-sidebar), or that has both kinds of words (content-sidebar-wrap), says nothing, unless it is about comments or adverts."""
    parts = [p.lower() for p in NAME_PART.findall(token)]
    if not parts or (parts[0] in ABSENT and len(parts) > 1):
        return OPEN
    bad = BAD_NAMES.intersection(parts)
    if bad and (bad & SURE_NAMES or not LAYOUT_NAMES.intersection(parts)):
        return BAD
    return GOOD if not bad and GOOD_NAMES.intersection(parts) else OPEN


def _standing(tag: str, attributes: str, article: bool) -> int:
    """What an element's own name, class, id and role say of what is in it; good names come before bad ones."""
    if (tag in DROPPED and tag != "form") or (tag == "header" and not article):
        return BAD
    if tag in ("html", "body"):
        return OPEN
    value = GOOD if tag in ("article", "main") else OPEN
    soft = tag == "form"
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, said = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and said == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said, re.I):
                return BAD
            if name == "role":
                if said.lower() in ROLES:
                    return BAD
                value = GOOD if said.lower() in ("main", "article") else value
            elif name in ("class", "id"):
                said = [_named(token) for token in said.split()]
                if GOOD in said:
                    value = GOOD
                elif BAD in said and tag not in ("article", "main"):
                    soft = True
    return SOFT if soft and (value != GOOD or tag == "form") else value


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, white space and character references resolved, empty ones left out.

    What a class name, an id or a form makes boilerplate is left out unless it wraps the page: as long as the page marks
    no article elsewhere, such an element that holds an article, or most of the text outside links (for comments and
    adverts: four fifths of it), says nothing.
    """
    ignored: set[int] = set()
    while True:
        out, outside, held = _blocks(html, ignored)
        if any(b.inside == GOOD for b in out) or not held:
            return out
        total = outside + sum(n for n, _, _ in held.values())
        wrappers = {k for k, (_, marked, _) in held.items() if marked} or {k for k, (n, _, sure) in held.items() if (n > 0.8 * total if sure else 2 * n > total)}
        if not wrappers:
            return out
        ignored |= wrappers


def _blocks(html: str, ignored: set[int]) -> tuple[list[Block], int, dict[int, list[int]]]:
    """Blocks, characters outside links in them, and by place of each outermost SOFT element its characters outside links and whether an article is in it."""
    out: list[Block] = []
    outside, held, soft, hard = 0, {}, [], []  # depths of open SOFT elements and of BAD ones in them
    open_tags: list[tuple[str, int]] = []  # element and what holds inside it
    is_open: Counter = Counter()
    muted: list[str] = []  # an inline element that doesn't belong to the text, and those of its name in it
    text: list[str] = []
    links = n_links = in_link = 0
    heading = False

    def state() -> int:
        return open_tags[-1][1] if open_tags else OPEN

    def end_block() -> None:
        nonlocal links, n_links, heading, in_link
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, links, n_links, state(), heading))
            text.clear()
        links = n_links = in_link = 0  # what isn't closed ends with its block
        muted.clear()
        heading = False

    def forget() -> None:
        while soft and soft[-1][0] >= len(open_tags):
            soft.pop()
        while hard and hard[-1] >= len(open_tags):
            hard.pop()

    def pop(k: int) -> None:
        for name, _ in open_tags[k:]:
            is_open[name] -= 1
        del open_tags[k:]
        forget()

    def close(tag: str) -> None:
        if is_open[tag]:
            pop(next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag))

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece.startswith("<![CDATA["):
                piece = ""
            elif piece[0] == "<" and len(piece) > 1:
                continue
            if muted:
                continue
            if piece and state() == BAD and soft and not hard and not in_link:
                held[soft[0][1]][0] += len(piece.strip())
            if piece and state() != BAD:
                text.append(piece)
                if not in_link:
                    outside += len(piece.strip())
                if in_link:
                    links += len(piece.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if muted and tag == muted[-1]:
                muted.pop()
            if tag in BLOCKS or tag in DROPPED:
                end_block()
                close(tag)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCKS and tag not in DROPPED and (muted[-1] == tag if muted else m[3] and _standing(tag, m[3], True) in (BAD, SOFT)):
            muted.append(tag)
            text.append(" ")
        if tag == "a" and not muted:
            in_link, n_links = 1, n_links + 1
        if tag in BLOCKS or tag in DROPPED:
            end_block()
            if tag in ENDS_P and open_tags and open_tags[-1][0] == "p":
                pop(len(open_tags) - 1)
            elif tag == "li" and open_tags and open_tags[-1][0] == "li":
                pop(len(open_tags) - 1)
            if tag != "hr":
                above = state()
                own = _standing(tag, m[3], above == GOOD) if above != BAD or soft else BAD
                if above == BAD and soft:  # only looked at
                    if own == BAD:
                        hard.append(len(open_tags))
                    elif not hard and (tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?(?:main|article)\b", m[3], re.I)) and own == GOOD:
                        held[soft[0][1]][1] = 1
                    own = BAD
                elif own == SOFT:
                    own = OPEN if at in ignored else BAD
                    if own == BAD:
                        soft.append((len(open_tags), at))
                        held[at] = [0, 0, bool(SURE_NAMES.intersection(p.lower() for p in NAME_PART.findall(m[3])))]
                open_tags.append((tag, own or above))
                is_open[tag] += 1
            heading = bool(re.fullmatch("h[1-6]", tag))
    end_block()
    return out, outside, held


def classify(found: list[Block], length_low: int = 70, length_high: int = 200, stop_low: float = 0.15, stop_high: float = 0.30, link_high: float = 0.33) -> list[bool]:
    """Whether each block is main text.

    Every block goes through both passes. What the page marks is one more thing to go by: where it marks an article, a
    block outside of it is boilerplate and one inside needs no length or stop words, but for lists of links. An article
    with less than half as much text as what reads like main text beside it is taken for a teaser, and marks nothing.
    """
    by_text = []
    for b in found:
        density = b.links / len(b.text)
        if b.inside == BAD or density > link_high or "©" in b.text or re.match(r"copyright\b", b.text, re.I):
            by_text.append(BAD)
        elif len(b.text) < length_low:
            by_text.append(BAD if b.links else OPEN)
        else:
            words = WORD.findall(b.text.lower())
            stops = sum(w in STOPWORDS for w in words) / max(1, len(words))
            # few stop words may only mean a language that the list doesn't have, so they leave a block open
            by_text.append(GOOD if stops >= stop_high or stops >= stop_low and len(b.text) >= length_high else OPEN)
    marked = sum(len(b.text) for b in found if b.inside == GOOD)
    beside = sum(len(b.text) for b, label in zip(found, by_text, strict=True) if b.inside == OPEN and label == GOOD)
    article = marked > 0 and 2 * marked >= beside
    labels = []
    for b, label in zip(found, by_text, strict=True):
        if article and b.inside != BAD:
            label = BAD if b.inside != GOOD or (b.n_links > 1 and b.links / len(b.text) > 0.8) else GOOD
        elif marked and not article and b.inside == GOOD and label == OPEN:
            label = BAD  # a teaser's own words
        labels.append(label)
    if not article and GOOD not in labels:  # nothing is sure: what nothing speaks against
        return [x != BAD for x in labels]
    out, n = [], len(labels)
    before, after = [0] * n, [0] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for k in order:
            near[k] = last
            if labels[k] != OPEN:
                last = k
    for k, label in enumerate(labels):
        if label == OPEN:
            p, q = before[k], after[k]
            sides = [labels[x] if x is not None else BAD for x in (p, q)]
            if sides[0] == sides[1]:
                label = sides[0]
            elif found[k].heading:  # a heading belongs to what follows
                label = sides[1]
            else:
                far = n + 1
                label = sides[0] if (k - p if p is not None else far) <= (q - k if q is not None else far) else sides[1]
        out.append(label == GOOD)
    return out


def main_text(html: str | None) -> str:
    """The blocks of main text in page order, joined by line feeds."""
    found = blocks(html or "")
    return "\n".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the ``keep`` columns and ``text``, a row for each row of ``pages``.

    A null or empty page, or one without main text, has an empty text. Markup that isn't closed ends with the page.
    Repeated rows are kept, other columns ignored; an empty table gives an empty result.
    """
    columns = [id_col, *keep]
    schema = ", ".join(f"`{c}` {dict(pages.dtypes)[c]}" for c in columns) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, len(columns), 1000)):
            texts = pa.array([main_text(h.as_py()) for h in b.column(len(columns))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*columns, "text"])

    return pages.select(*columns, F.col(html_col)).mapInArrow(run, schema)
