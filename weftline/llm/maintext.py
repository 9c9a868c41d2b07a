"""Main text of HTML pages: the contiguous run of words and tags with the highest score.

A page is read once, from left to right, as a sequence of tags and words. Words score positive, by the kind of block they
stand in and whether they are a link's; tags score negative, by name (those within a marked article or main part alike). The weights are log-odds of standing inside or
outside the article, counted on labelled pages, those of the corpus that mark their article as such (``LABELLED`` distinct
ones at most, drawn by hash), with prior counts for what they do not show. A linear scan finds the run with the highest
sum, whose blocks are the text. The marks that label a page are not learned: to cross one costs ``BARRIER``.

Elements that are no part of an article wherever they stand (scripts, forms, navigation, asides, what its class, id or
role calls an advert, a notice, comments and so on) count as one tag and are left out of the text.

Defined results: null and empty html, and pages without words outside such elements, give an empty text; html without
tags is one block; a comment or script that does not end takes the rest of the page; unclosed elements end with their
parent; unknown tags share one weight; of runs of equal score the first counts; without labelled pages the priors are
the weights; repeated rows are pages of their own; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded, table

LABELLED = 4096  # distinct labelled pages that weights are counted on, at most
BARRIER = 300.0
PRIOR = 30.0  # prior counts of a feature
MOST, LEAST = 3.0, 0.1  # bounds of a weight's size

# Elements of HTML by what they are to a text.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
LEFT_OUT = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "frameset", "head", "iframe", "map", "menu", "nav", "noembed", "noframes", "noscript", "object",
    "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KINDS = dict.fromkeys(HEADINGS, "heading") | dict.fromkeys(("p", "blockquote", "pre", "figcaption"), "paragraph") | dict.fromkeys(("li", "dt", "dd"), "item") | dict.fromkeys(("td", "th", "caption"), "cell")
OTHER_BLOCKS = {"address", "article", "body", "center", "details", "div", "dl", "fieldset", "figure", "header", "hgroup", "hr", "html", "main", "ol", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
MARKS = {"article", "main"}
#: What an open element of these is closed by, besides its parent's end.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
    "p": {*KINDS, *OTHER_BLOCKS, "nav", "aside", "footer", "form", "menu"} - {"td", "th", "tr", "caption", "tbody", "tfoot", "thead"},
}
#: Names in class, id and role of what is no part of an article; those with a star begin longer names too.
NAMES = (
    "ad ads adv advert* adslot adbox sponsor* promo* banner* cookie* consent* gdpr notice notices notification* alert alerts disclaimer comment* disqus reply replies respond "
    "sidebar* aside complementary widget* menu* nav navbar* navigation breadcrumb* pagination pager toolbar footer* foot contentinfo share* sharing social* related* recommend* "
    "newsletter* subscri* signup login popup* modal* overlay dialog search searchbox skip tooltip paywall teaser*"
)
HEADER_NAMES = "header masthead topbar"
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|[!?/][^>]*+>)")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CONDITIONS = {"has", "with", "no", "without", "is", "show", "hide", "category", "tag", "type", "format", "status"}
BY_TAG, BY_NAME = 1, 2  # why an element is left out
_LETTER_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[^a-z0-9]+")


def _names(names: str) -> re.Pattern:
    return re.compile("|".join(n.replace("*", "[a-z0-9]*") for n in names.split()))


_OUT, _HEADER = _names(NAMES), _names(HEADER_NAMES)
_KNOWN = LEFT_OUT | RAW | VOID | INLINE | set(KINDS) | OTHER_BLOCKS


def out_of_article(attributes: str, inside: bool) -> bool:
    """Whether an element's class, id, role or style says that it is no part of an article, or unseen. ``inside`` an
    article a header is its own."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            if value.lower() != "until-found":
                return True
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name == "style":
            if _UNSEEN.search(value):
                return True
        else:
            for one in value.split():
                words = _WORD.split(_LETTER_CASE.sub("-", one).lower())
                if words[0] not in _CONDITIONS and any(_OUT.fullmatch(w) or not inside and _HEADER.fullmatch(w) for w in words):
                    return True
    return False


class Page:
    """A page as a sequence: ``features[i]`` stands ``counts[i]`` times at block ``blocks[i]`` (-1: a tag), ``marked[i]``
    says whether in an article; ``texts`` are the blocks' texts."""

    def __init__(self, html: str) -> None:
        self.features: list[str] = []
        self.counts: list[int] = []
        self.blocks: list[int] = []
        self.marked: list[bool] = []
        self.texts: list[list[str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        # an open element: name, why left out (0: it is not), kind of its words, in a link, in a marked article, in a mark at all
        state = ("", 0, "bare", False, False, False)
        stack, opened = [state], Counter()
        at, n, fresh = 0, len(html), True
        features, counts, blocks, marked = self.features, self.counts, self.blocks, self.marked

        def tag(name: str) -> None:
            features.append("inside" if state[5] and name.removeprefix("/") not in MARKS else name)
            counts.append(1)
            blocks.append(-1)
            marked.append(state[4])

        def text(part: str) -> None:
            nonlocal fresh
            words = len(part.split())
            if fresh and not words or state[1] or not part:
                return
            if fresh:
                self.texts.append([])
                fresh = False
            self.texts[-1].append(part)
            if words:
                features.append(f"{state[2]} link" if state[3] else state[2])
                counts.append(words)
                blocks.append(len(self.texts) - 1)
                marked.append(state[4])

        def close(to: int) -> None:
            nonlocal state
            while len(stack) > to:
                opened[stack.pop()[0]] -= 1
            state = stack[-1]

        while at < n:
            found = html.find("<", at)
            if found < 0:
                text(entities.unescape(html[at:]))
                break
            m = _TAG.match(html, found)
            if m is None:  # a less-than sign, or a tag that does not end
                if html[found + 1 : found + 2].isalpha() or html[found + 1 : found + 2] == "/":
                    text(entities.unescape(html[at:found]))
                    rest = html.find("<", found + 1)
                    at = n if rest < 0 else rest
                else:
                    text(entities.unescape(html[at : found + 1]))
                    at = found + 1
                continue
            if found > at:
                text(entities.unescape(html[at:found]))
            at = m.end()
            if m.lastindex is None:  # a comment or a declaration
                if html.startswith("<!--", found):
                    end = html.find("-->", found + 4)
                    at = n if end < 0 else end + 3
                continue
            ends, name, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            name = name.lower()
            known = name if name in _KNOWN else "other"
            if name not in INLINE and name in _KNOWN:
                fresh = True
            if ends:
                if opened[name]:
                    was = state[1]
                    i = len(stack) - 1
                    while stack[i][0] != name:
                        i -= 1
                    close(i)
                    if not was or not state[1]:
                        tag("left out" if was else f"/{known}")
                elif not state[1]:
                    tag(f"/{known}")
                continue
            closing = ENDS.keys() & opened.keys()
            for open_name in closing:
                if opened[open_name] and name in ENDS[open_name]:
                    i = len(stack) - 1
                    while i and stack[i][0] != open_name and (stack[i][0] in INLINE or stack[i][0] in ("p",)):
                        i -= 1
                    if stack[i][0] == open_name:
                        close(i)
            if state[1] and (name == "main" or name == "article" and state[1] == BY_NAME and not state[5]):
                state = (state[0], 0, *state[2:])  # a wrapper's name means something else
            inside = state[5]
            left = state[1]
            out = left
            if not left and (name in LEFT_OUT and not (name == "form" and self._wraps(html, at)) or name == "header" and not inside):
                out = BY_TAG
            if not out and attributes and name not in ("html", "body", "main") and out_of_article(attributes, inside or name == "article"):
                out = BY_NAME
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                at = n if end is None else end.end()
                if not left:
                    tag("left out")
                continue
            if name == "br":
                text(" ")
            if name in VOID or attributes.endswith("/") and name not in _KNOWN:
                if not left:
                    tag(known)
                continue
            if not out:
                tag(known)
            kind = KINDS.get(name, "bare" if name in OTHER_BLOCKS else state[2])
            state = (name, out, kind, state[3] or name == "a", state[4] or name == "article", inside or name in MARKS)
            stack.append(state)
            opened[name] += 1
        if state[1]:
            tag("left out")

    @staticmethod
    def _wraps(html: str, at: int) -> bool:
        """Whether a form is drawn round the page: its main heading or article stands in it."""
        end = html.find("</form", at)
        return re.search(r"<(?:article|main|h1)\b", html[at : len(html) if end < 0 else end], re.I) is not None

    def score(self, weights: dict[str, float]) -> list[float]:
        return [weights[f] * c for f, c in zip(self.features, self.counts, strict=True)]

    def text(self, weights: dict[str, float]) -> str:
        first, last = best_run(self.score(weights))
        inside = [b for b in self.blocks[first:last] if b >= 0]
        if not inside:
            return ""
        lines = (" ".join("".join(parts).split()) for parts in self.texts[inside[0] : inside[-1] + 1])
        return "\n".join(line for line in lines if line)


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, behind the last) of the contiguous run with the highest sum, the first and shortest of equal ones; (0, 0) if
    no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


# ---- weights ---------------------------------------------------------------------------------

WORDS = [f"{kind}{link}" for kind in ("heading", "paragraph", "item", "cell", "bare") for link in ("", " link")]
#: Prior chances of standing in an article.
CHANCES = {"heading": 0.8, "paragraph": 0.9, "item": 0.65, "cell": 0.65, "bare": 0.62} | dict.fromkeys((w for w in WORDS if w.endswith("link")), 0.52)
_TAG_CHANCE = dict.fromkeys(INLINE - {"a"}, 0.45) | dict.fromkeys((*HEADINGS, "p", "blockquote", "pre", "figure", "figcaption"), 0.4) | {"a": 0.2, "left out": 0.1, "hr": 0.3, "inside": 0.5, "div": 0.05, "section": 0.05, "table": 0.05}


def learned(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from how often each feature stood inside and outside of labelled articles."""
    out = {}
    for f in [*WORDS, "inside", "left out", "other", "/other", *_KNOWN, *(f"/{k}" for k in _KNOWN)]:
        name = f.removeprefix("/")
        word = f in CHANCES
        p = CHANCES[f] if word else _TAG_CHANCE.get(name, 0.2)
        inside, outside = counts.get(f, (0, 0))
        odds = math.log((inside + PRIOR * p) / (outside + PRIOR * (1 - p)))
        out[f] = min(MOST, max(LEAST, odds)) if word else -min(MOST, max(LEAST, -odds))
        if name in MARKS:
            out[f] = -BARRIER
    return out


def weights(pages: DataFrame, limit: int = LABELLED) -> dict[str, float]:
    """Weights from labelled pages of (html), the same for every layout of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = Page(html)
                if any(page.marked):
                    for f, c, m in zip(page.features, page.counts, page.marked, strict=True):
                        (inside if m else outside)[f] += c
        names = sorted(inside | outside)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([inside[f] for f in names], pa.int64()), pa.array([outside[f] for f in names], pa.int64())], names=["feature", "inside", "outside"])

    marked = pages.where(F.col("html").rlike("(?i)<article")).select("html", F.xxhash64("html").alias("h"))
    lowest = marked.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).head()[0]
    if lowest is None:
        return learned({})
    drawn = marked.where(F.col("h") <= lowest).groupBy("h").agg(F.min("html").alias("html")).select("html")
    got = drawn.mapInArrow(run, "feature string, inside bigint, outside bigint").groupBy("feature").agg(F.sum("inside"), F.sum("outside")).collect()
    return learned({f: (i, o) for f, i, o in got})  # a row for each known tag and kind of word


def main_text(pages: DataFrame, by: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by given weights or those of its own labelled pages."""
    bounded(pages.sparkSession, 8 << 20)
    by = weights(pages) if by is None else by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html).text(by) if html else "" for html in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
