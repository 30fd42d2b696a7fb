"""Main text of web pages: the maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score positive and tags negative; the main text lies in the contiguous run
with the greatest sum, found by one linear scan. The scores are log odds of a token standing inside the main text,
counted on labelled pages: pages that mark it themselves (``<article>``, ``<main>``, role ``main``), a bounded sample.
A token is counted with the tag, class and role words of the elements around it, so the scores carry over to pages that
mark nothing; on pages with marks, standing inside or outside of them is one more name, which weighs like any other.
Elements that are never main text (scripts, styles, forms, menus, comments and the like, by tag or by class, id
or role) score nothing and are left out of the text even inside the run. A class names what an element is by the whole
of it or by its last word (``user-comments``, but not ``has-sidebar`` or ``search-results``), and never rules out an
element that holds most of the page's words around its text blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.store import arrow_map

#: Labelled pages of the fit (those with the least hash of their id).
FIT_PAGES = 2_000

# HTML element names, and words that name the role of a part of a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "br", "wbr", "img",
}
NOT_MAIN = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "template", "svg", "canvas", "object"}
NOT_MAIN_WORDS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "dialog", "footer", "form", "gdpr",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "related", "reply", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "widget",
}
MAIN_WORDS = {"main"}
#: First words of names that tell whether a page has a part.
ABOUT_PARTS = {"has", "have", "with", "without", "no", "not", "is", "hide", "show"}
#: Elements whose class words speak of the page as a whole.
WHOLE = {"html", "body"}
#: Elements that close an open paragraph, or an open one of their own kind.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CLOSES_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"(?<=\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Element:
    """``parent``: its number, -1 without one. ``never``: skipped by its tag; ``named``: by its names, unless a wrapper."""

    tag: str
    parent: int
    never: bool
    named: bool
    main: bool
    words: frozenset[str]
    n_words: int = 0
    n_marks: int = 0
    n_blocks: int = 0


@dataclass
class Token:
    """A tag (``text`` None) or a stretch of text, with what stands around it."""

    tag: str
    text: str | None
    skipped: bool
    main: bool
    context: tuple[str, ...] = field(default_factory=tuple)
    inside: int = -1


def names_other(value: str) -> bool:
    """Whether a class, id or role says that its element is not main text."""
    runs = _NAME_WORD.findall(value)
    return value in NOT_MAIN_WORDS or (len(runs) > 0 and runs[-1] in NOT_MAIN_WORDS and runs[0] not in ABOUT_PARTS)


def skipped_elements(elements: list[Element]) -> list[bool]:
    """Which elements are skipped, with all that they hold; those named so stay where they wrap most of the page."""
    hidden: list[bool] = []
    for e in elements:
        hidden.append(e.never or (e.parent >= 0 and hidden[e.parent]))
    total = marks = 0
    for i in range(len(elements) - 1, -1, -1):
        e = elements[i]
        if hidden[i]:
            continue
        e.n_marks += e.main and not (e.parent >= 0 and elements[e.parent].main)
        e.n_blocks += e.tag in ("p", "h1")
        above = elements[e.parent] if e.parent >= 0 else None
        if above:
            above.n_words += e.n_words
            above.n_marks += e.n_marks
            above.n_blocks += e.n_blocks
        else:
            total, marks = total + e.n_words, marks + e.n_marks
    out: list[bool] = []
    for i, e in enumerate(elements):
        wraps = 2 * e.n_words > total and (e.n_marks > 0 or (marks == 0 and e.n_blocks > 1))
        out.append(hidden[i] or (e.parent >= 0 and out[e.parent]) or (e.named and not wraps))
    return out


def tokens(page: str) -> list[Token]:
    """Tags and texts of a page in order; an element left open ends with its parent."""
    out: list[Token] = []
    stack: list[Element] = []
    places: list[int] = []
    elements: list[Element] = []
    # open elements by tag, so that an end without a beginning costs nothing
    open_tags: Counter[str] = Counter()

    def state() -> tuple[int, bool, tuple[str, ...]]:
        if not stack:
            return -1, False, ()
        top = stack[-1]
        return places[-1], top.main, (top.tag, *sorted(top.words))

    def text(piece: str) -> None:
        if piece:
            inside, main, context = state()
            token = Token("", html.unescape(piece), False, main, context, inside)
            out.append(token)
            if stack:
                stack[-1].n_words += len(token.text.split())

    def close(to: int) -> None:
        while len(stack) > to:
            open_tags[stack.pop().tag] -= 1
            places.pop()

    at = 0
    while True:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = _TAG.match(page, start)
        if m is None:  # a bare "<" is text
            end = page.find("<", start + 1)
            end = len(page) if end < 0 else end
            text(page[at:end])
            at = end
            continue
        text(page[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            inside, main, context = state()
            out.append(Token("/" + tag, None, False, main, context, inside))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES_OWN and any(open_tags[t] for t in (("dt", "dd") if tag in ("dt", "dd") else (tag,))):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")):
                    close(k)
                    break
                if stack[k].tag in CLOSES_OWN[tag]:
                    break
        names: set[str] = set()
        role_main = named = False
        for a in _ATTRIBUTE.finditer(m[3] or ""):
            value = (a[2] or a[3] or a[4] or "").lower()
            names.update(_NAME_WORD.findall(value))
            named |= any(names_other(v) for v in value.split())
            role_main |= a[1].lower() == "role" and value.strip() in MAIN_WORDS
        if tag in WHOLE:
            names, named = set(), False
        parent, main, _ = state()
        # a form may hold the whole page
        element = Element(
            tag, parent, tag in NOT_MAIN and tag != "form", named or tag == "form", main or tag in ("article", "main") or role_main, frozenset(names)
        )
        elements.append(element)
        out.append(Token(tag, None, False, element.main, (tag, *sorted(names)), len(elements) - 1))
        if tag in RAW:
            end = re.compile(r"</" + re.escape(tag) + r"\s*/?>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(element)
            places.append(len(elements) - 1)
            open_tags[tag] += 1
    skipped = skipped_elements(elements)
    for t in out:
        t.skipped = t.inside >= 0 and skipped[t.inside]
    return out


def has_marks(found: list[Token]) -> bool:
    """Whether a page marks some text as main."""
    return any(t.main and not t.skipped and t.text and t.text.strip() for t in found)


def feature_of(token: Token, marked: bool) -> tuple[str, ...]:
    """What a token is counted by: tag or word, with each name around it and, on ``marked`` pages, the side of the mark."""
    kind = "tag" if token.text is None else "word"
    around = tuple(f"{kind} {name}" for name in token.context) or (f"{kind} -",)
    return (*around, f"{kind} @{'main' if token.main else 'rest'}") if marked else around


def score_of(token: Token, weights: dict[str, float], marked: bool) -> float:
    """Score of a tag, or of every word of a text: the mean weight of its features, kept on its side of zero."""
    features = feature_of(token, marked)
    weight = sum(weights.get(f, 0.0) for f in features) / len(features)
    if token.text is None:
        return min(-0.2, weight)
    return max(0.2, 1.0 + weight)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest sum; of equal sums the first and shortest; (0, 0) if none is positive."""
    best, bounds, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (begin, i + 1)
    return bounds


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run, one per line."""
    found = tokens(page or "")
    marked = has_marks(found)
    scores = []
    for t in found:
        s = score_of(t, weights, marked)
        if t.text is not None:
            s *= len(t.text.split())
        if t.skipped:  # never output
            s = 0.0
        scores.append(s)
    begin, end = best_run(scores)
    blocks: list[str] = []
    here: list[str] = []

    def flush() -> None:
        block = " ".join("".join(here).split())
        if block:
            blocks.append(block)
        here.clear()

    for t in found[begin:end]:
        if t.text is None:
            if t.tag.lstrip("/") in ("br", "wbr", "img"):
                here.append(" " if t.tag.lstrip("/") == "br" else "")
            elif t.tag.lstrip("/") not in INLINE:
                flush()
        elif not t.skipped:
            here.append(t.text)
    flush()
    return "\n".join(blocks)


def fit(pages: DataFrame) -> dict[str, float]:
    """Log odds of tokens by the names around them, on at most ``FIT_PAGES`` pages that mark their main text."""
    placed = pages.select(F.xxhash64("page_id", "url", "html").alias("place"), "html")
    marked = placed.where("lower(html) rlike '<article|<main|role=.?main'")
    # numbers alone are sorted; the pages of the chosen ones are fetched by a second read, repeated pages once
    chosen = marked.select("place").distinct().orderBy("place").limit(FIT_PAGES)
    labelled = placed.join(F.broadcast(chosen), "place").dropDuplicates(["place"])

    def run(batch):
        counts: Counter[tuple[str, bool]] = Counter()
        for page in batch.column(0).to_pylist():
            found = tokens(page or "")
            marked = has_marks(found)
            for t in found:
                n = 1 if t.text is None else len(t.text.split())
                for f in feature_of(t, marked):
                    counts[f, t.main and not t.skipped] += n
        rows = [(f, inside, n) for (f, inside), n in counts.items()]
        if rows:
            f, inside, n = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(f), pa.array(inside), pa.array(n, pa.int64())], names=["feature", "inside", "n"])

    counted = arrow_map(labelled.select("html"), run, "feature string, inside boolean, n long")
    sums = counted.groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside")
    )
    odds = F.round(F.log((F.col("inside") + 1) / (F.col("outside") + 1)), 4)
    # the names of at most FIT_PAGES pages
    return {r["feature"]: max(-3.0, min(3.0, r["weight"])) for r in sums.select("feature", odds.alias("weight")).collect()}


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``; null and empty html give an empty text.

    Character references are decoded, white space inside a block becomes one space, blocks follow one another on lines
    of their own in page order. Repeated pages are extracted like any other; other columns are left out.
    """
    known = pages.sparkSession.sparkContext.broadcast(weights)  # a number per name of the fit's pages

    def run(batch):
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            texts = [main_text(p.as_py(), known.value) for p in part.column(2)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
