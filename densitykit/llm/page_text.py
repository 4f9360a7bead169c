"""Main text of web pages by the maximum-scoring subsequence (operator 5).

A page is a sequence of tags and words. Words score positive, tags negative, and the contiguous region with
the greatest sum, found by one linear scan, is the content. The weights come from labelled pages: a
page with one ``article`` or ``main`` element labels its own words and tags as inside or outside.

* A word's weight depends on its context, the innermost block element and its class
  (``p``, ``li``, ``div.ad``): the share of such words inside less the share outside (1 for
  contexts that were never seen). Where no ``article`` or ``main`` encloses it, the weight is the mean of this and of the weight of its block's
  form: the number of words (by powers of two), whether links hold most of them, whether a copyright sign begins it. These
  weights are learned from all blocks, menus and footers included.
* A tag's weight is ``-(TAG_MIN + TAG_OUT * share outside)``, counted over the tags that stand in no
  boilerplate element; the tags of ``article`` and ``main`` themselves, where content begins or ends, weigh
  ``-TAG_EDGE``.

Words and tags in elements that are no content by their very name or class (``BOILERPLATE``: menus, adverts, forms, reader
comments, ..) score -1, or 0 where an ``article`` or ``main`` element encloses them, and are left out of the region's text; scripts, styles and the head are no words
at all. A class, id or role marks no ``html`` or ``body``, no ``article`` or ``main`` outside marked elements, and no element
with most of the text: more than half of the words of the page (unless articles beside it hold a tenth of them)
or of the ``article`` or ``main`` around it. Some marks only raise a question: ``AMBIGUOUS`` words, and listed words inside a phrase
(``form-of-government``). Such an element is left out unless its own blocks have the form of content, a sum of block weights
above 0, where blocks under 16 words count -1. ``header`` and its like mark no heading. The weights are fitted on at most ``sample_rows`` pages, those with the smallest hash of their id;
extraction is one scan of all pages, one page at a time, without a shuffle.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one space in page order.

Edge cases: null or empty html gives empty text; html without markup is one block; broken markup (open
comments, scripts or quotes, stray ``<``) is read as far as it goes; without labelled pages all contexts count
as unseen; equal sums take the first region; a null id or url is kept; repeated rows give repeated rows; an empty
table gives an empty result; extra columns are ignored; whole pages are read whatever their length.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.llm.common import bounded_sample

TAG_MIN, TAG_OUT, TAG_EDGE = 0.1, 1.0, 10.0
#: Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "head")
#: Elements and class or id words that are no content (fixed values).
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "header", "fieldset"}
BOILERPLATE_CLASS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promotion", "related", "replies", "search",
    "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Listed words that are also names of subjects or of parts of the content; words that make a class or id a phrase; marks
#: that say nothing of a heading; MathML elements (fixed values).
AMBIGUOUS = {"form", "header", "search"}
PHRASE = {"a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"}
HEADING, NO_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"header", "banner", "masthead"}
MATH = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "mspace", "mfenced"}
#: Elements that don't break a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", *MATH}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)(?:>|\Z)""", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_COPYRIGHT = re.compile(r"\s*(?:©|&copy;|&#169;|&#xa9;|\(c\)|copyright\b)", re.I)
_SPACE = re.compile(r"\s+")


class Element(NamedTuple):
    name: str
    context: str
    up: int  # the element around it
    scope: int  # the article or main element around it (0: none)
    by_name: bool
    by_class: int  # 1: a listed word marks it, 2: its text decides


@dataclass
class Weights:
    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    block: dict[str, float] = field(default_factory=dict)

    def of_block(self, form: str) -> float:
        """Whether a block of this form speaks for content: its learned weight (1 if never seen) from 16 words on, -1 for
        fewer words, links and copyright."""
        return self.block.get(form, 1.0) if form.isdigit() and int(form) >= 5 else -1.0

    def of_word(self, context: str, boiler: int, form: str, scope: int) -> float:
        if boiler:
            return (-1.0, 0.0)[boiler - 1]
        own = self.word.get(context, 1.0)
        return own if scope or form not in self.block else (own + self.block[form]) / 2

    def of_tag(self, name: str, boiler: int) -> float:
        if name in ("article", "main") and not boiler:
            return -TAG_EDGE
        return (self.tag.get(name, -TAG_MIN), -1.0, 0.0)[boiler]


class Token(NamedTuple):
    kind: str  # 't': a run of text, 'o' and 'c': tags
    name: str
    text: str
    context: str
    boiler: int  # 0: none, 1: outside, 2: inside an article or main element
    words: int
    form: str  # of the block around a run of text
    scope: int


def tokens(page: str, weights: Weights | None = None) -> list[Token]:
    toks, elements = parse(page)
    words = [len(t[2].split()) if t[0] == "t" else 0 for t in toks]
    forms = block_forms(toks, words)
    boiler = marks(toks, elements, words, forms, weights or Weights())
    out = []
    for (kind, name, text, at), n, form in zip(toks, words, forms):
        e = elements[at]
        out.append(Token(kind, name, text, e.context, boiler[at], n, form, at if e.name in ("article", "main") else e.scope))
    return out


def block_forms(toks: list[tuple[str, str, str, int]], words: list[int]) -> list[str]:
    """Form of the block that holds each token: the bit length of its number of words (at most 7), 'a' if links hold more than
    half of them, 'c' if it begins with a copyright sign."""
    forms = [""] * len(toks)
    first = total = links = 0
    link = lead = False
    for i in range(len(toks) + 1):
        kind, name, text, _ = toks[i] if i < len(toks) else ("c", "", "", 0)
        if kind == "t":
            if not total and words[i]:
                lead = bool(_COPYRIGHT.match(text))
            total += words[i]
            links += words[i] * link
        elif name == "a":
            link = kind == "o"
        elif name not in INLINE:
            if total:
                form = str(min(7, total.bit_length())) + ("a" if 2 * links > total else "") + ("c" if lead else "")
                forms[first:i] = [form] * (i - first)
            first, total, links = i + 1, 0, 0
            link = link and kind == "o" and name != "p"  # a link may hold blocks
    return forms


def parse(page: str) -> tuple[list[tuple[str, str, str, int]], list[Element]]:
    """``(kind, name, text, element)`` with the index of the element around the token, and the elements; the first one
    stands for the page."""
    at, n = 0, len(page)
    toks: list[tuple[str, str, str, int]] = []
    elements = [Element("", "", 0, 0, False, 0)]
    stack: list[int] = []
    now = 0
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            toks.append(("t", "", page[at:end], now))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, close, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if close:
            toks.append(("c", name, "", now))
            if any(elements[s].name == name for s in stack):
                while elements[stack.pop()].name != name:
                    pass
        else:
            if name in RAW and not attrs.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if name != "head":
                    at = stop.end() if stop else n
                else:
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = stop.end() if stop else body.start() if body else at
                continue
            toks.append(("o", name, "", now))
            if name in VOID or attrs.endswith("/") or name in INLINE:
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and elements[stack[-1]].name == name:
                stack.pop()
            label = " ".join(x for g in _CLASS.findall(attrs) for x in g).lower() if attrs else ""
            up = stack[-1] if stack else 0
            scope = up if elements[up].name in ("article", "main") else elements[up].scope
            by_class = class_mark(name, label) if label else 0
            by_name = name in BOILERPLATE and not (name == "header" and scope)
            key = f"{name}.{label.split()[0]}" if label.split() else name
            stack.append(len(elements))
            elements.append(Element(name, key, up, scope, by_name, by_class))
        now = stack[-1] if stack else 0
    return toks, elements


def class_mark(name: str, label: str) -> int:
    """What class, id and role words say of an element: 0 nothing, 1 boilerplate, 2 its text decides."""
    mark = 0
    for token in label.split():
        parts = set(_PART.findall(token))
        listed = parts & BOILERPLATE_CLASS
        if name in HEADING:
            listed -= NO_HEADING
        if listed and (listed <= AMBIGUOUS or parts & PHRASE):
            mark = mark or 2
        elif listed:
            return 1
    return mark


def marks(toks: list[tuple[str, str, str, int]], elements: list[Element], n_words: list[int], forms: list[str], weights: Weights) -> list[int]:
    """Boilerplate (as in ``Token``) of each element."""
    words, articles, gain = [0] * len(elements), [0] * len(elements), [0.0] * len(elements)
    if any(e.by_class and not e.by_name for e in elements):  # words of each element, those of them in article and main elements, and block weights
        for (kind, _, _, at), n, form in zip(toks, n_words, forms):
            if kind == "t" and n:
                words[at] += n
                gain[at] += n * weights.of_block(form)
        for i in range(len(elements) - 1, 0, -1):
            e = elements[i]
            words[e.up] += words[i]
            gain[e.up] += gain[i]
            articles[e.up] += words[i] if e.name in ("article", "main") else articles[i]
    boiler = [0]
    for i, e in enumerate(elements[1:], 1):
        above, edge = boiler[e.up], e.name in ("article", "main")
        bad = e.by_name
        if e.by_class and not bad:
            most = 2 * words[i] > words[e.scope] and (e.scope > 0 or 10 * (articles[0] - articles[i]) < words[0])
            prose = e.by_class == 2 and gain[i] > 0
            bad = e.name not in ("html", "body") and (above > 0 if edge else not most and not prose)
        boiler.append(0 if edge and not bad else above or (2 if bad and e.scope else int(bad)))
    return boiler


def count_labelled(page: str) -> list[tuple[str, int, int]]:
    """``(key, inside, outside)`` counts of a page that labels its own content; [] if it does not.
    Keys: 'w:' and a word's context, 't:' and a tag's name, 'b:' and the form of a word's block."""
    seen: dict[str, list[int]] = {}
    depth = regions = 0
    for kind, name, _, context, boiler, k, form, _ in tokens(page):
        if kind == "t":
            if k and not boiler:
                seen.setdefault(f"w:{context}", [0, 0])[depth == 0] += k
            if k and boiler < 2:
                seen.setdefault(f"b:{form}", [0, 0])[depth == 0] += k
            continue
        if name in ("article", "main"):
            depth = max(0, depth + (1 if kind == "o" else -1))
            regions += kind == "o" and depth == 1
            continue
        if not boiler:
            seen.setdefault(f"t:{name}", [0, 0])[depth == 0] += 1
    return [(k, a, b) for k, (a, b) in seen.items()] if regions == 1 else []


def extract(page: str, weights: Weights) -> str:
    """Text of the region with the greatest sum of weights."""
    toks = tokens(page, weights)
    best = total = 0.0
    start = lo = hi = 0
    for i, (kind, name, _, context, boiler, n, form, scope) in enumerate(toks):
        gain = n * weights.of_word(context, boiler, form, scope) if kind == "t" else weights.of_tag(name, boiler)
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, lo, hi = total, start, i + 1
    blocks, now = [], []
    for kind, name, text, _, boiler, *_ in toks[lo:hi]:
        if kind == "t":
            if not boiler:
                now.append(text)
        elif name not in INLINE and now:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_rows: int = 2000) -> Weights:
    """Weights from the labelled pages among the ``sample_rows`` pages of smallest id hash."""
    sample = bounded_sample(pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h")).where("h is not null"), "id", "h", sample_rows)

    def run(batches):
        for b in batches:
            rows = [x for p in b.column(0).to_pylist() if p for x in count_labelled(p)]
            if rows:
                k, a, o = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a, pa.int64()), pa.array(o, pa.int64())], ["k", "a", "o"])

    counts = sample.select("h").mapInArrow(run, "k string, a long, o long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("o").alias("o")) \
        .orderBy("k").toLocalIterator()  # contexts of the sample's pages
    w = Weights()
    for k, a, o in counts:
        if k[0] == "w":
            w.word[k[2:]] = (a - o + 1) / (a + o + 1)
        elif k[0] == "b":
            w.block[k[2:]] = (a - o) / (a + o + 1)
        else:
            w.tag[k[2:]] = -(TAG_MIN + TAG_OUT * o / (a + o + 1))
    return w


def page_text(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, and text, n_chars (code points)."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema), "text string", "n_chars long"])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                text = [extract(p, weights) if p else "" for p in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(keep))), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                                                 [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
