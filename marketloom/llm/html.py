"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks (runs of text between block-level tags). Each has features of its ancestors' tags, of
words in their class, id and role, and of its own text. The CRF labels the blocks 0 (boilerplate) or 1 (main text) and
is trained on labelled pages that ``labelled_pages`` lays out in many ways: with and without article and main
elements, with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside them.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.crf import Crf, train
from marketloom.llm.text import small_batches

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title iframe svg canvas object audio video datalist textarea".split())
CLOSED = re.compile(rf"</({'|'.join(sorted(HIDDEN))})\b", re.I)
#: start tag -> open tags that it ends, if they are nearer than the barrier
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
BARRIER = frozenset("ul ol dl table menu select article section main".split())
#: kinds of region, by words that sites put into class, id, role and aria-label
KINDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip",
    "head": "header masthead banner topbar logo branding toolbar",
    "foot": "footer contentinfo copyright colophon legal bottom",
    "side": "sidebar aside complementary widget rail related recommended popular trending tags archive",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "note": "cookie cookies consent notice gdpr alert popup modal overlay dialog toast paywall disclaimer announcement notification",
    "form": "form search login signup subscribe subscription newsletter contact",
    "share": "share sharing social follow byline author meta date",
    "talk": "comment comments commentlist reply replies respond discussion disqus reviews responses",
    "body": "content article post entry story main text body prose",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
#: words of the text itself that speak for boilerplate
AROUND = frozenset("nav aside footer header form button select menu dialog".split())
SAID = frozenset("cookie cookies subscribe newsletter advertisement sponsored copyright login register privacy comments reply share consent".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    features: tuple[str, ...]
    label: int


@dataclass(slots=True)
class _Element:
    """An open element, with what holds of it and of all that it lies in, so that nobody walks up the tree."""

    tag: str
    kinds: frozenset  # region kinds, of all
    tags: frozenset  # of those that features name
    own: str  # tag of the nearest block element
    label: int  # the nearest label of a training page
    hidden: bool
    linked: bool
    inside: bool  # an element that sites use for the article itself
    block: int  # where the nearest block element, barrier, outermost drawing and paragraph (within its block element) lie, else -1
    barrier: int
    drawing: int
    paragraph: int


#: What lies in no element.
OUTSIDE = _Element("", frozenset(), frozenset(), "-", 0, False, False, False, -1, -1, -1, -1)
NAMED = (BLOCK | AROUND | {"a"}) - {"html", "body"}


class _Blocks(HTMLParser):
    """Collects the leaf blocks, each with its innermost open element. Time and memory follow the page's length at any depth.

    An element that hides its text does so only if an end tag of it is still to come, so that one that is never closed
    takes no text away (but for script and style, whose text can't be told from the page's).
    """

    def __init__(self, closed: Counter) -> None:
        super().__init__(convert_charrefs=True)
        self.closed = closed
        self.open: list[_Element] = []
        self.at: dict[str, list[int]] = {}  # tag -> where it is open
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def inner(self) -> _Element:
        return self.open[-1] if self.open else OUTSIDE

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, x: int) -> None:
        """End the open elements from x on."""
        while len(self.open) > x:
            self.at[self.open.pop().tag].pop()

    def flush(self) -> None:
        if not self.parts:
            return
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        linked, self.parts, self.linked = self.linked, [], 0
        if text:
            self.blocks.append(Block(text, (linked, self.inner()), self.inner().label))

    def parse_html_declaration(self, i):
        """Marked sections are bogus comments in HTML, whatever their keyword."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            # block elements end an open drawing, as browsers have it
            if self.inner().drawing >= 0 and tag != "title":
                self.cut(self.inner().drawing)
            ended = self.last(ENDS.get(tag, ()))
            if ended >= 0 and ended >= self.inner().barrier:
                self.cut(ended)
            if tag not in ("button", "select", "option", "textarea") and self.inner().paragraph >= 0:
                self.cut(self.inner().paragraph)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in HIDDEN and tag not in ("script", "style") and self.closed[tag] <= 0:
            tag = "span"
        a = {k: v or "" for k, v in attrs}
        named = " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label"))
        kinds = {KIND_OF[w] for w in map(str.lower, PART.findall(named)) if w in KIND_OF}
        up, x, block = self.inner(), len(self.open), tag in BLOCK
        self.at.setdefault(tag, []).append(x)
        self.open.append(_Element(
            tag, up.kinds if kinds <= up.kinds else up.kinds | kinds, up.tags if tag not in NAMED or tag in up.tags else up.tags | {tag}, tag if block else up.own, int(a["data-y"]) if a.get("data-y", "") in ("0", "1") else up.label,
            up.hidden or tag in HIDDEN, up.linked or tag == "a", up.inside or tag in ("article", "main") or "body" in kinds,
            x if block else up.block, x if tag in BARRIER else up.barrier, up.drawing if up.drawing >= 0 or tag != "svg" else x, x if tag == "p" else -1 if block else up.paragraph,
        ))

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.closed[tag] -= 1
        if tag in BLOCK:
            self.flush()
        x = self.last((tag,))
        if x >= 0 and (tag in BLOCK or x > self.inner().block):
            self.cut(x)

    def handle_data(self, data):
        if self.inner().hidden:
            return
        self.parts.append(data)
        if self.inner().linked:
            self.linked += len(data.strip())


def _core(element: _Element) -> bool:
    """Whether a block lies in an element that sites use for the article itself."""
    return element.inside and "talk" not in element.kinds


def _features(text: str, linked: int, element: _Element, page: str) -> tuple[str, ...]:
    """page: whether the page has an element for the article."""
    tags, kinds, own = element.tags, element.kinds, element.own
    zone = "core" if _core(element) else page
    around = min(2, len(tags & AROUND) + len(kinds - {"body"}))
    words = text.split(" ")
    n = len(words)
    size, links = f"words:{min(6, n.bit_length())}", f"linked:{min(4, int(5 * linked / len(text)))}"
    found = {"all", f"own:{own}", size, links, f"{zone}:{around}", f"{zone}:{around}:own:{own}", f"{zone}:{around}:{links}", f"{zone}:{around}:{size}"}
    found |= {f"in:{t}" for t in tags if t in BLOCK or t == "a"} | {f"kind:{k}" for k in kinds}
    if re.search(r"[.!?…。][\"'”’)%$#&*]*$", text):
        found.add("ends")
    if "©" in text:
        found.add("copyright")
    if n <= 40 and any(w.strip(".,:!?").lower() in SAID for w in words):
        found.add(f"said:{zone}")
    return tuple(sorted(found))


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments and markup leave none."""
    if not html:
        return []
    parser = _Blocks(Counter(t.lower() for t in CLOSED.findall(html)))
    parser.feed(html)
    parser.close()
    parser.flush()
    page = "out" if any(_core(b.features[1]) for b in parser.blocks) else "open"
    return [Block(b.text, _features(b.text, *b.features, page), b.label) for b in parser.blocks]


def labelled_pages(n: int = 260, seed: int = 9) -> list[str]:
    """Pages with data-y="1" around main text and data-y="0" around the rest, in varied layouts."""
    r = random.Random(seed)
    syllables = "ba ke ti ro sum ven dal mi or tan es pu li gra no wex hy".split()

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(a, b):
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentences(a, b):
        return " ".join(words(3, 14).capitalize() + r.choice(".....!?") for _ in range(r.randint(a, b)))

    def named(kind, plain=0.0):
        if r.random() < plain:
            return ""
        w = r.choice(KINDS[kind].split())
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("", "site-", "page-", "block_"))}{w}{r.choice(("", "-inner", " wide", "1"))}"'

    def links(a, b, tag="li"):
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 4)}</a></{tag}>' for _ in range(r.randint(a, b)))

    def menu():
        inner = f"<ul>{links(3, 8)}</ul>"
        return f'<nav data-y="0">{inner}</nav>' if r.random() < 0.6 else f'<div data-y="0"{named("nav")}>{inner}</div>'

    def box(kind, tag="div", a=1, b=3):
        return f'<{tag} data-y="0"{named(kind)}>' + "".join(r.choice((f"<p>{sentences(1, 3)}</p>", sentences(1, 2), f"<span>{words(2, 7)}</span>")) for _ in range(r.randint(a, b))) + f"</{tag}>"

    def form():
        return f'<form data-y="0"{named("form", 0.4)}><label>{words(1, 4)}</label><input name="q"><select><option>{words(1, 2)}</option></select><p>{sentences(1, 1)}</p><button>{words(1, 2)}</button></form>'

    def talk():
        tag = r.choice(("div", "article", "li", "section"))
        each = "".join(f'<{tag}{named("talk", 0.3)}><p>{sentences(1, 4)}</p></{tag}>' for _ in range(r.randint(1, 5)))
        return f'<{r.choice(("section", "div"))} data-y="0"{named("talk")}><h3>{words(1, 3)}</h3>{each}</section></div>'

    def footer():
        inner = f"{r.choice(('&copy; ', '', '&#169; '))}{words(1, 6)} &middot; {sentences(1, 1)}" + (f"<ul>{links(2, 6)}</ul>" if r.random() < 0.4 else "")
        return f'<footer data-y="0">{inner}</footer>' if r.random() < 0.6 else f'<div data-y="0"{named("foot")}>{inner}</div>'

    def header():
        inner = r.choice((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", words(2, 5))) + (menu() if r.random() < 0.4 else "")
        return f'<header data-y="0">{inner}</header>' if r.random() < 0.6 else f'<div data-y="0"{named("head")}>{inner}</div>'

    def main_text():
        out = [f"<h1>{words(2, 10)}{r.choice(('', '.'))}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15:
            return out * (r.random() < 0.5) + [f"<p>{r.choice((sentences(1, 1), words(1, 6)))}</p>"]
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.55:
                out.append(f"<p>{'<b>' * (r.random() < 0.2)}{sentences(1, 7)}{'</p>' * (r.random() < 0.9)}")
            elif x < 0.63:
                out.append("<ul>" + links(1, 5) + "</ul>")
            elif x < 0.70:
                out.append(f"<h2>{words(1, 7)}</h2>")
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{r.choice((sentences(1, 2), words(2, 9)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.80:
                out.append(f"<blockquote>{sentences(1, 3)}</blockquote>")
            elif x < 0.83:
                out.append(f"<pre>{words(3, 20)}</pre>")
            elif x < 0.86:
                out.append(f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 3)}</td></tr></table>")
            elif x < 0.89:
                out.append(f"<figure><figcaption>{sentences(1, 1)}</figcaption></figure>")
            elif x < 0.92:
                out.append(f'<p>{sentences(1, 2)} <a href="/{word()}">{words(1, 5)}</a> {sentences(1, 2)}</p>')
            else:
                out.append(r.choice((box("ad"), box("note"), box("share"), form(), box("side", r.choice(("aside", "div"))))))
        return out

    pages = []
    for _ in range(n):
        before = [x for x, p in ((box("note"), 0.3), (header(), 0.5), (menu(), 0.7), (form(), 0.15), (box("ad"), 0.5), (box("side", r.choice(("aside", "div"))), 0.2)) if r.random() < p]
        after = [x for x, p in ((talk(), 0.4), (box("side", r.choice(("aside", "div", "section"))), 0.4), (f'<div data-y="0"{named("side")}><ul>{links(2, 6)}</ul></div>', 0.3), (form(), 0.25), (box("ad"), 0.3), (box("note"), 0.2), (footer(), 0.85)) if r.random() < p]
        parts, x = main_text(), r.random()
        inner = "".join(parts)
        if r.random() < 0.25:
            inner += f'<div data-y="0">{talk()}</div>'
        if x < 0.5:
            body = f'<article data-y="1"{named("body", 0.7)}>{inner}</article>'
        elif x < 0.65:
            body = f'<main data-y="1">{inner}</main>'
        elif x < 0.9:
            body = f'<div data-y="1"{named("body")}>{inner}</div>'
        elif x < 0.95:
            body = f'<div data-y="1">{inner}</div>'
        else:
            body = "".join(p if p.split(">")[0].find("data-y") > 0 else re.sub(r"^<(\w+)", r'<\1 data-y="1"', p) for p in parts)
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        if r.random() < 0.06:
            body = ""
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return pages


def fit(pages: list[str] | None = None) -> Crf:
    """Train on labelled pages (default: ``labelled_pages()``)."""
    cut = [blocks(p) for p in (labelled_pages() if pages is None else pages)]
    return train([[b.features for b in page] for page in cut], [[b.label for b in page] for page in cut], 2, rounds=100)


def main_text(model: Crf, html: str | None, remembered: dict | None = None) -> str:
    """Text of the blocks that Viterbi labels 1, in page order, joined by one space."""
    cut = blocks(html)
    if not cut:
        return ""
    known = {} if remembered is None else remembered
    rows = []
    for b in cut:
        e = known.get(b.features)
        if e is None:
            e = known[b.features] = model.emission(b.features)
        rows.append(e)
    return " ".join(b.text for b, y in zip(cut, model.decode(np.array(rows))) if y == 1)


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """Add ``text_col`` with the main text of every page.

    Null and empty pages, and pages without main text, get an empty text. Pages are independent rows, so repeated rows
    get the same text; a column that is already called ``text_col`` is replaced.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        known: dict = {}
        return html.map(lambda h: main_text(shared.value, h, known), na_action=None)

    return pages.withColumn(text_col, text(F.coalesce(F.col(html_col), F.lit(""))))
