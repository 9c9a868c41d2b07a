"""HTML to nested pages.

``parse_html`` and ``parse_anchors`` are pandas UDFs over the standard library's parser; they take tags however they are
written. The regular-expression functions stay in the JVM and know plainly written tags only: lower case, double quotes,
no tags inside.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import PAGE

_HIDDEN = {"script", "style", "noscript", "template"}
_BLANK = re.compile(r"[\s\xa0]+")


def _clean(parts: list[str]) -> str:
    return _BLANK.sub(" ", "".join(parts)).strip()


class _Parser(HTMLParser):
    """Collects title, headings, anchors, metas and the body's text. Unclosed tags are let be."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.text: list[str] = []
        self.h1: list[str] | None = None
        self.h2: list[list[str]] = []
        self.anchors: list[tuple[str, list[str]]] = []
        self.metas: list[dict[str, str]] = []
        self.into: list[tuple[str, list[str]]] = []
        self.hidden: list[str] = []
        self.in_head = False
        self.body = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.body, self.in_head = True, False
        elif tag == "meta":
            self.metas.append({"name": a.get("name", ""), "content": a.get("content", ""), "charset": a.get("charset", ""), "http_equiv": a.get("http-equiv", ""), "scheme": a.get("scheme", "")})
        elif tag in ("title", "h1", "h2", "a"):
            out: list[str] = []
            if tag == "title" and self.title is None:
                self.title = out
            elif tag == "h1" and self.h1 is None:
                self.h1 = out
            elif tag == "h2":
                self.h2.append(out)
            elif tag == "a":
                self.into = [x for x in self.into if x[0] != "a"]  # anchors do not nest
                self.anchors.append((a.get("href", ""), out))
            self.into.append((tag, out))
        else:
            self.text.append(" ") if tag in ("p", "br", "div", "li", "tr", "td", "article", "section", "nav") else None

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag == "head":
            self.in_head = False
        self.into = [x for x in self.into if x[0] != tag]
        if tag in ("p", "div", "li", "tr", "td", "article", "section", "nav", "h1", "h2", "ul"):
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        for _, out in self.into:
            out.append(data)
        if not self.in_head and not any(t == "title" for t, _ in self.into):
            self.text.append(data)


def parse_page(url: str, html: str | None) -> dict:
    """A page as PAGE has it; links hold raw hrefs in order, to be resolved by Column functions."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    return {
        "url": url, "title": _clean(p.title or []), "text": _clean(p.text), "h1": None if p.h1 is None else _clean(p.h1), "h2": [_clean(x) for x in p.h2],
        "links": [{"link": h, "anchor": _clean(t)} for h, t in p.anchors], "metas": p.metas,
    }


@F.pandas_udf(PAGE)
def parse_html(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(u, h) for u, h in zip(url, html, strict=True)], columns=PAGE.names)


def element_text(html: str | None, attr: str, value: str) -> str | None:
    """The text of the first element whose attribute has that value, tags within it included; null if there is none."""
    found: list[str] = []

    class Find(HTMLParser):
        depth, done, tag = 0, False, ""

        def handle_starttag(self, tag, attrs):
            if self.done:
                return
            if self.depth:
                self.depth += tag == self.tag
            elif dict(attrs).get(attr) == value:
                self.depth, self.tag = 1, tag

        def handle_endtag(self, tag):
            if self.depth and tag == self.tag:
                self.depth -= 1
                self.done |= self.depth == 0

        def handle_data(self, data):
            if self.depth:
                found.append(data)

    p = Find(convert_charrefs=True)
    p.feed(html or "")
    p.close()
    return _clean(found) if p.depth or p.done else None


class _Anchors(_Parser):
    """The anchors alone, by the same rules."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and not any(k == "href" for k, _ in attrs):
            self.into = [x for x in self.into if x[0] != "a"]
        elif tag == "a" or tag in _HIDDEN:
            super().handle_starttag(tag, attrs)


def page_anchors(html: str | None) -> list[dict[str, str]]:
    """The anchors of a page that have a href, in order."""
    p = _Anchors()
    p.feed(html or "")
    p.close()
    return [{"href": h, "anchor": _clean(t)} for h, t in p.anchors]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("anchor", T.StringType())])))
def parse_anchors(html: pd.Series) -> pd.Series:
    return html.map(page_anchors)


# ---- in the JVM ------------------------------------------------------------------------------

_ANCHOR = '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def anchors_of(html: Column) -> Column:
    """An array of (href, anchor) of plainly written anchors, in order."""
    found = [F.regexp_extract_all(html, F.lit(_ANCHOR), k) for k in (1, 2)]
    return F.arrays_zip(found[0].alias("href"), found[1].alias("anchor"))
