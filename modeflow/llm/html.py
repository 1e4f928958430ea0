"""Main text of web pages: flat text blocks classified by word counts and link densities of themselves and their neighbours.

A page is read once into flat blocks. A decision tree decides which of them are kept. It is trained at the first use on the
small labelled table below: hand-written pages whose blocks are labelled one by one. Its features are the words and the link
density of a block, of the one before and the one after, its number of links, and weaker cues: whether it is a heading, where
it stands to the page's article, and whether it lies in an element that is boilerplate by its kind or by a token of its class.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: place: the share of the page's plain words that its article or main element holds; negative for blocks outside of it.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "anchors", "heading", "place", "boilerplate", "marked")
#: The labelled table: pages with {n} in place of n words, and a label for each block in order, 1 if it is main text.
LABELLED = [
    # a news article with an advert and share links inside, an aside and a footer
    ("<header><a>{2}</a></header><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><article><h1>{8}</h1><p>{4}</p><p>{45}</p><p>{62}</p><div class=ad>{9}</div><h2>{3}</h2><p>{80}</p><p>{6}</p><ul class=share><li><a>{1}</a><li><a>{1}</a></ul></article><aside><h3>{2}</h3><p>{14}</p></aside><footer>{6} <a>{1}</a></footer>", "00001111011100000"),
    # a short note: its paragraphs are no longer than menu entries, its advert is longer than it
    ("<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{7}</div><article><h1>{2}</h1><p>{2}</p></article><footer>{12}</footer>", "00000110"),
    ("<nav><a>{1}</a> <a>{1}</a></nav><div class=advert>{13}</div><article><h1>{9}</h1><p>{1}</p><p>{1}</p><p>{3}</p><p>{1}</p></article><footer>{9}</footer>", "00111110"),
    # blocks without any markup of their own
    ("<div><a>{1}</a> <a>{1}</a> <a>{1}</a></div><h1>{6}</h1><div>{40}</div><div>{4}</div><div>{55} <a>{3}</a></div><div><a>{4}</a></div><div><a>{5}</a></div><div>{5} <a>{2}</a> <a>{2}</a></div>", "01111000"),
    ("<table><tr><td><a>{1}</a><td><a>{2}</a><td><a>{1}</a></table><div>{18}</div><div>{70}</div><div>{25}</div><div>{1} <a>{2}</a> <a>{1}</a> <a>{3}</a></div>", "0001110"),
    ("<p>{5}</p>", "1"),
    ("<p>{1}</p><p>{30}</p><p>{2}</p>", "111"),
    ("<div><a>{2}</a></div><div><a>{1}</a></div><div><a>{1}</a></div>", "000"),
    # a story beside a teaser
    ("<nav><a>{1}</a></nav><div id=story><h2>{7}</h2><p>{90}</p><p>{64}</p><p>{8}</p></div><article><h3><a>{6}</a></h3><p>{9} <a>{2}</a></p></article><div>{8} <a>{1}</a> <a>{1}</a></div>", "01111000"),
    ("<article><p>{6} <a>{3}</a></p></article><div><p>{28}</p><p>{120}</p></div>", "011"),
    # related links and recommendations without a name inside the article; a single link as an item of its text
    ("<article><h1>{5}</h1><p>{50}</p><div><a>{6}</a> <a>{7}</a></div><p>{48}</p><ul><li><a>{5}</a><li><a>{6}</a><li><a>{4}</a></ul></article>", "11010" + "00"),
    ("<article><h1>{4}</h1><p>{33}</p><p>{1}</p><ul><li><a>{1}</a></ul><p>{1}</p><p>{30}</p></article>", "111111"),
    ("<article><p>{60}</p><p><a>{3}</a></p><p>{44}</p><div><a>{1}</a> | <a>{1}</a> | <a>{1}</a></div></article>", "1110"),
    # lists of short items: a recipe; references with links in running text
    ("<main><h1>{3}</h1><ul><li>{2}<li>{3}<li>{1}<li>{4}</ul><ol><li>{15}<li>{22}<li>{7}</ol></main><footer>{4}</footer>", "11111" + "1110"),
    ("<article><h1>{7}</h1><p>{85} <a>{2}</a></p><h2>{1}</h2><ol><li>{6} <a>{5}</a><li>{8} <a>{6}</a><li>{5} <a>{3}</a></ol></article>", "111111"),
    # documentation: code, tables of single words, a contents list, pages before and after
    ("<main><div><a>{1}</a> / <a>{2}</a> / {1}</div><h1>{4}</h1><ul><li><a>{2}</a><li><a>{3}</a><li><a>{2}</a></ul><p>{35}</p><pre>{20}</pre><table><tr><td>{1}<td>{1}<tr><td>{2}<td>{6}</table><p>{16} <a>{1}</a> {9}</p><div><a>{2}</a> <a>{2}</a></div></main>", "01000" + "11" + "1111" + "10"),
    # a product page without an article
    ("<div><a>{1}</a> <a>{1}</a> <a>{1}</a> <a>{2}</a></div><h1>{5}</h1><p>{70}</p><table><tr><td>{2}<td>{3}<tr><td>{1}<td>{2}</table><p>{32}</p><div><a>{4}</a> {2}</div><div><a>{5}</a> {2}</div><div><a>{3}</a> {2}</div><div>{9} <a>{1}</a> <a>{2}</a> <a>{1}</a></div>", "01111111" + "0000"),
    # several articles with linked headings and links to the rest
    ("<main><article><h2><a>{6}</a></h2><p>{25}</p><p><a>{2}</a></p></article><article><h2><a>{8}</a></h2><p>{31}</p><p><a>{2}</a></p></article></main>", "111111"),
    # comments: of a name, as articles, and beside an article
    ("<article><h1>{6}</h1><p>{75}</p><section id=comments><h3>{2}</h3><p>{20}</p><p>{35}</p></section><p>{40}</p></article>", "110001"),
    ("<article><p>{110}</p><p>{38}</p></article><section class=comments><article class=comment><p>{1}</p><p>{42}</p></article><article class=comment><p>{16}</p></article></section><form><label>{1}</label> <input> <label>{3}</label></form>", "1100000"),
    # notices and wrappers; names on the article itself
    ("<div class=cookie-notice>{24} <a>{1}</a></div><div class='page no-sidebar'><article class='post comments-open'><h1>{6}</h1><p>{26}</p></article><div class=sidebar><p>{12}</p><p>{20}</p></div></div><footer><p>{11}</p></footer>", "0110000"[:2] + "1" + "000"),
    ("<form><div><a>{1}</a> <a>{1}</a></div><div>{33}</div><div>{41}</div></form>", "011"),
    # plain text outside the article that has neither a name nor links
    ("<div>{6}</div><div>{14}</div><article><h1>{5}</h1><p>{55}</p><p>{71}</p></article><div>{8}</div><div>{17}</div>", "0011100"),
    ("<main><p>{12} <a>{9}</a></p><p><a>{2}</a> {28} <a>{3}</a></p><p>{9}</p></main><div>{30}</div>", "1110"),
    ("<header><h2>{3}</h2><p>{10}</p></header><div><h1>{4}</h1><p>{18}</p><p>{5}</p><p>{23}</p></div><footer><p>{21}</p><p>{8}</p></footer>", "00" + "1111" + "00"),
    # named links and adverts with links amid the article's text
    ("<article><h1>{5}</h1><p>{52}</p><div class=ad>{4} <a>{3}</a></div><p>{29}</p><aside><a>{7}</a></aside><p>{18}</p><div class=related><a>{5}</a></div><p>{36}</p><nav><a>{1}</a> <a>{2}</a></nav><p>{12}</p></article>", "1101" + "0101" + "01"),
    ("<article><p>{25}</p><div><a>{2}</a> <a>{3}</a></div><p>{9}</p><p><a>{4}</a> {2} <a>{1}</a></p><p>{20}</p><div><a>{8}</a> <a>{9}</a> <a>{7}</a></div></article>", "101110"),
    ("<div class=menu><a>{1}</a> <a>{1}</a></div><div><p>{15}</p><p>{9}</p></div><div class=widget><p>{19}</p></div><div class=footer>{13}</div>", "01100"),
]


def grow(rows: np.ndarray, depth: int = 10) -> tuple | int:
    """A classification tree by Gini impurity: (feature, limit, tree at or below it, tree above it) or a label."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= limit
            a, b = y[low], y[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(limit), low
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, limit, low = best
    return f, limit, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def labelled_blocks() -> np.ndarray:
    """The features of all blocks of the labelled table, and their labels."""
    rows = []
    for page, labels in LABELLED:
        found = described(blocks(re.sub(r"\{(\d+)\}", lambda m: " w" * int(m[1]), page)))
        rows += [(*features, int(label)) for features, label in zip(found, labels, strict=True)]
    return np.array(rows, float)


@lru_cache(maxsize=1)
def tree() -> tuple | int:
    return grow(labelled_blocks())


def keeps(features: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node == 1


# --- pages to blocks ---------------------------------------------------------------------------------------------------
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']+|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes xmp iframe".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset(("article", "main"))
# Fixed by the language: elements that a start tag ends, up to an element of the second list.
_ENDS = {
    **{name: (("li",), ("ul", "ol", "menu")) for name in ("li",)}, **{name: (("dt", "dd"), ("dl",)) for name in ("dt", "dd")}, **{name: (("td", "th"), ("tr", "table")) for name in ("td", "th")},
    "tr": (("td", "th", "tr"), ("table",)), **{name: (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)) for name in ("thead", "tbody", "tfoot")}, "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
_P_STAYS = frozenset("td th button caption object template html body".split())
# Elements, roles and tokens of classes and ids that are boilerplate.
_BOILER = frozenset("nav footer aside form button select option datalist dialog menu noscript template svg math canvas object audio video head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification alert sidebar comment comments commentlist disqus reply replies respond nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay widget widgets login signin signup search pagination pager toolbar skip copyright".split()
)
#: Parts of a token that say nothing of their own, and those that turn it round.
_NEUTRAL = frozenset("slot box bar list item items wrapper wrap container block area section unit links link buttons button left right top bottom inner outer content main primary secondary site page global thread body panel region posts articles stories group row col column icons".split())
_NEGATIONS = frozenset("no not non has have with without hide show is".split())


def mark(token: str) -> bool:
    """Whether a token of a class or an id names boilerplate: its last telling part does, as in cookie-notice or ad-slot, and
    not in no-sidebar, comments-open or related-work."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    if not parts or parts[0] in _NEGATIONS:
        return False
    telling = [p for p in parts if p not in _NEUTRAL]
    return bool(telling) and telling[-1] in _MARKS


def kind_of(name: str, attributes: str, inside: bool) -> str:
    """`boilerplate` by the element's kind or role, `marked` by a token of its class or id, or neither (empty)."""
    if name in _BOILER or name == "header" and not inside:
        return "boilerplate"
    if not attributes or name in ("html", "body"):
        return ""
    seen: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in seen:
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
            return "boilerplate"
        if key in ("class", "id") and any(mark(t) or not inside and t.lower() in ("header", "site-header", "page-header") for t in value.split()):
            return "marked"
    return ""


class Block(NamedTuple):
    """Words in a row; `holder` is the innermost boilerplate, marked or article element around them, -1 if there is none."""

    text: str
    words: int
    linked: int
    anchors: int
    heading: bool
    holder: int


class Element(NamedTuple):
    """A boilerplate, marked or article element, and the next one around it (-1: none)."""

    name: str
    kind: str
    holder: int


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page, and the elements that hold them, outer ones first."""
    out: list[Block] = []
    elements: list[Element] = []
    words: list[str] = []  # of the open block
    glue = False  # the last word may go on
    linked = anchors = in_link = in_article = headings = 0
    new_link = False
    stack: list[tuple[str, int]] = []  # open elements, with their numbers in elements or -1
    opened: defaultdict[str, list[int]] = defaultdict(list)  # the places of open elements in the stack, by name
    holder = -1
    at, end = 0, len(page)

    def close() -> None:
        nonlocal words, linked, anchors, glue, new_link
        if words:
            out.append(Block(" ".join(words), len(words), linked, anchors, headings > 0, holder))
            words, linked, anchors = [], 0, 0
            new_link = in_link > 0
        glue = False

    def add(raw: str) -> None:
        nonlocal linked, glue, anchors, new_link
        text = unescape(raw) if "&" in raw else raw
        got = text.split()
        if got:
            joins = glue and not text[0].isspace()
            if in_link:
                linked += len(got) - joins
                anchors, new_link = anchors + new_link, False
            if joins:
                words[-1] += got[0]
                words.extend(got[1:])
            else:
                words.extend(got)
            glue = not text[-1].isspace()
        elif text:
            glue = False

    def leave(depth: int) -> None:
        """End the open elements from this one on."""
        nonlocal in_article, headings, holder
        while len(stack) > depth:
            name, number = stack.pop()
            opened[name].pop()
            in_article -= name in _ARTICLE
            headings -= name in _HEADINGS
            if number >= 0:
                holder = elements[number].holder

    def nearest(names) -> int:
        """The place of the last open element of these names, -1 without one."""
        return max((opened[x][-1] for x in names if opened[x]), default=-1)

    def end_up_to(ended: tuple[str, ...], limits) -> None:
        """End from the first open element of these names on that stands after the last limit."""
        limit = nearest(x for x in limits if x not in ended)
        first = [opened[x][i] for x in ended if (i := bisect_right(opened[x], limit)) < len(opened[x])]
        if first:
            leave(min(first))

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW and not closing:
            gone = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = gone.start() if gone else end
            if name == "title" or name == "textarea":
                close()
            continue
        if name == "a":
            in_link, new_link = (0, False) if closing else (1, True)
            continue
        if name in _INLINE and not (name == "span" and (opened["span"] if closing else kind_of(name, m[3], in_article > 0))):
            continue
        close()
        if name in _RAW:
            continue
        if closing:
            in_link = 0
            if opened[name]:
                depth = opened[name][-1]
                if name != "p" or nearest(_P_STAYS) < depth:
                    leave(depth)
            continue
        if name in _P_ENDS and opened["p"]:
            end_up_to(("p",), _P_STAYS)
        if name in _ENDS and any(opened[x] for x in _ENDS[name][0]):
            end_up_to(*_ENDS[name])
        if name == "body" or name in _ARTICLE:  # an unclosed head does not reach into these
            while stack and stack[-1][0] in ("head", "title"):
                leave(len(stack) - 1)
        if name in _VOID:
            continue
        kind, number = kind_of(name, m[3], in_article > 0), -1
        if kind or name in _ARTICLE:
            number = len(elements)
            elements.append(Element(name, kind, holder))
            holder = number
        opened[name].append(len(stack))
        stack.append((name, number))
        in_article += name in _ARTICLE
        headings += name in _HEADINGS
    close()
    return out, elements


def described(page: tuple[list[Block], list[Element]]) -> list[tuple]:
    """The features of each block.

    The page's article is every article or main element outside boilerplate; where there is none, the one with most plain
    (unlinked) words, if it has half of them. Boilerplate around or on the article does not count, nor does a form or a named
    element that holds most of a page without an article.
    """
    found, elements = page
    n = len(elements)
    plain = [0] * (n + 1)  # the last one is the page; so is holder -1
    for b in found:
        plain[b.holder] += b.words - b.linked
    for h in range(n - 1, -1, -1):
        plain[elements[h].holder] += plain[h]
    under = [False] * (n + 1)  # in or under boilerplate of any kind
    for h, e in enumerate(elements):
        under[h] = bool(e.kind) or under[e.holder]
    clean = {h for h, e in enumerate(elements) if e.name in _ARTICLE and not under[h]}
    if not clean:
        best = max((h for h, e in enumerate(elements) if e.name in _ARTICLE), key=lambda h: (plain[h], -h), default=None)
        if best is not None and 2 * plain[best] >= plain[-1]:
            clean = {best}
    free = [h in clean for h in range(n)] + [False]
    for h in range(n - 1, -1, -1):
        free[elements[h].holder] |= free[h]
    if not clean:
        free = [(e.name == "form" or e.kind == "marked") and 10 * plain[h] > 6 * plain[-1] for h, e in enumerate(elements)]
    inside, boiler, named = ([False] * (n + 1) for _ in range(3))
    for h, e in enumerate(elements):
        inside[h] = h in clean or inside[e.holder]
        boiler[h] = e.kind == "boilerplate" and not free[h] or boiler[e.holder]
        named[h] = e.kind == "marked" and not free[h] or named[e.holder]
    open_words = [0, 0]
    for b in found:
        if not boiler[b.holder] and not named[b.holder]:
            open_words[inside[b.holder]] += b.words - b.linked
    share = open_words[1] / max(1, sum(open_words))
    sizes = [(0, 0.0), *[(b.words, b.linked / b.words) for b in found], (0, 0.0)]
    return [(*sizes[i], *sizes[i - 1], *sizes[i + 1], b.anchors, int(b.heading), share if inside[b.holder] else -share, int(boiler[b.holder]), int(named[b.holder])) for i, b in enumerate(found, 1)]


def main_text(page: str | None) -> str:
    """The kept blocks of a page in order, joined by one space; empty for a null or empty page or one without any."""
    if not page:
        return ""
    read = blocks(page)
    return " ".join(b.text for b, features in zip(read[0], described(read), strict=True) if keeps(features))


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """df without its html, with the main text and n_chars, its code points.

    Pages are read whole; null and empty pages, and pages without main text, have an empty text. Broken pages are read as far
    as they go: a tag or script cut off at the end is dropped, a cut-off character reference stays as it is. Repeated rows
    give repeated results. Other columns pass through; one named like a result gives way to it. No shuffle.
    """
    others = [c for c in df.columns if c not in (html_col, text_col, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(0).to_pylist()]
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, text_col, "n_chars"])

    rows = df.select(F.col(html_col).cast("string").alias("__html"), *[F.col(f"`{c}`") for c in others])
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kinds + ', ' if kinds else ''}`{text_col}` string, n_chars bigint")


def op1_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
