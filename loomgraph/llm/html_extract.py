"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The elements that a block stands in are evidence: an article, a
boilerplate container (menu, header, footer, sidebar, form, advert, comments; by its tag, its role, or a class or id
that is such a name) or a doubtful one, whose class or id only has such a name as a part, or one that articles use too.

First pass, in this order. Links: a block most of whose text is links is boilerplate, but in an article only
if it is a bare list of at least three, without a word between them; other linked text there stays undecided.
Container: what is left of a boilerplate container, and outside of articles of a doubtful one, is boilerplate, however
it reads. Density: long blocks with some stop words and shorter ones with many are content; long ones with hardly any
are boilerplate, but in an article undecided. Short blocks stay undecided.

Second pass: an undecided block takes the label of the nearest blocks before and after it that the first pass decided by
their text: that which both have, else that of the nearer one. In an article only the same article's blocks count; of
equally near ones, and where it has none, the article itself decides for content. In a doubtful container of an article
only its own blocks count, and where it has none the doubt is for boilerplate. Elsewhere containers count too, and the
doubt is for boilerplate.

Defined results: a null or empty page has no text, an empty table no rows. A page that ends within a tag, an element or a
character reference is read as far as it goes. Pages of any length are read whole. Repeated rows, and rows that share a key,
get a result each; a null key stays null. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre script search section select style summary table tbody td template tfoot th thead title tr ul".split()
)
BAD_TAGS = frozenset("nav header footer aside form button select menu dialog head".split())
MAIN_TAGS = frozenset(("article", "main"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Words of class names and ids (between hyphens, underscores and changes of case) that name boilerplate.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar footer "
    "masthead toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "recommendations comment comments commentlist disqus pagination pager disclaimer".split()
)
#: Words that name boilerplate, but parts of articles too.
DOUBTFUL = frozenset("notice notices alert side aside subscription share sharing social related recommended respond reply replies widget legal copyright skip search form".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on are this from at or an not have has but they which he she we you "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur se ne ce il sont avec ou son "
    "el los las y del una por con para su al lo como más pero sus este entre cuando muy sin sobre".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
#: Words that only say where or how such a part stands.
FILLERS = frozenset("list section box wrap wrapper container area block body item items content inner outer main site page global top bottom left right bar slot unit group row col primary secondary user thread post js x".split())
#: One attribute after the other, so that nothing within a value is taken for a name; a stray quoted text is passed over.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?|\"[^\"]*\"|'[^']*'", re.S)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
GOOD, BAD, OPEN = 1, -1, 0


NO, DOUBT, YES = 0, 1, 2


def named(names: str) -> int:
    """What class names or ids say, each by itself. YES: bad words, and none but doubtful ones beside; DOUBT: some bad words, or only doubtful ones."""
    out = NO
    for one in names.split():
        words = [w.lower() for w in WORDS.findall(one)]
        words = [w for w in words if w not in FILLERS] or words
        bad, doubt = sum(w in BAD_NAMES for w in words), sum(w in DOUBTFUL for w in words)
        if bad and bad + doubt == len(words):
            return YES
        if bad or doubt and doubt == len(words):
            out = DOUBT
    return out


def boilerplate(tag: str, attributes: str) -> int:
    """How far an element is a boilerplate container: NO, DOUBT or YES."""
    if tag in BAD_TAGS:
        return YES
    if not attributes or tag in ("body", "html", "article", "main"):
        return NO
    out = NO
    for m in ATTRIBUTE.finditer(attributes):
        if m[1] is None:
            continue
        name, v = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and v.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", v, re.I):
            return YES
        if name == "role" and v.lower() in BAD_ROLES:
            return YES
        if name in ("class", "id"):
            out = max(out, named(v))
    return out


@dataclass(frozen=True)
class Block:
    text: str
    linked: int  # characters in links, but for white space
    links: int
    bare: bool  # no letter or digit outside of links
    bad: bool  # in a boilerplate container
    doubt: int  # number of the outermost doubtful container, 0 for none
    article: int  # number of the innermost article, 0 for none


def blocks(html: str) -> list[Block]:
    """The blocks with text, in the order of the page."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []
    parts, linked, n_links, bare = [], 0, 0, True
    bad = links = articles = article = doubts = doubt = 0

    def close() -> None:
        nonlocal parts, linked, n_links, bare
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, n_links, bare, bad > 0, doubt, article))
        parts, linked, n_links, bare = [], 0, int(links > 0), True

    def drop() -> None:
        nonlocal bad, article, links, doubt
        tag, b, article, doubt = stack.pop()
        bad -= b == YES
        links -= tag == "a"

    def text(s: str) -> None:
        nonlocal linked, bare
        s = unescape(s)
        parts.append(s)
        if links:
            linked += len("".join(s.split()))
        elif bare and any(map(str.isalnum, s)):
            bare = False

    at, n = 0, len(html)
    while at < n:
        if (i := html.find("<", at)) < 0:
            text(html[at:])
            break
        m = TOKEN.match(html, i)
        if m is None:  # a bare <
            text(html[at : i + 1])
            at = i + 1
            continue
        if i > at:
            text(html[at:i])
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if m[0][-1] != ">":  # cut off within the tag
            break
        if m[1]:
            if tag in BLOCK:
                close()
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    drop()
                drop()
            continue
        if tag in BLOCK:
            close()
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their kind
            limit = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(tag, ("div", "section", "article", "td", "li"))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        drop()
                    break
                if stack[k][0] in limit:
                    break
        if tag not in VOID:
            b = boilerplate(tag, m[3])
            # a header within the article holds its title
            if tag == "header" and article and not bad:
                b = NO
            stack.append((tag, b, article, doubt))
            bad += b == YES
            if b == DOUBT and not doubt:
                doubts += 1
                doubt = doubts
            if tag in MAIN_TAGS:
                articles += 1
                article = articles
            links += tag == "a"
            n_links += tag == "a"
    close()
    return out


def label(block: Block, long: int = 140, dense: float = 0.25, sparse: float = 0.12, linky: float = 0.5) -> tuple[int, str]:
    """First pass: the label and the rule that gave it."""
    size = sum(map(len, block.text.split()))
    if block.linked > linky * size:
        if block.bad or not block.article or block.links >= 3 and block.bare:
            return BAD, "links"
        return OPEN, ""
    if block.bad or block.doubt and not block.article:
        return BAD, "container"
    w = re.findall(r"[^\W\d_]+", block.text.lower())
    stop = sum(x in STOP_WORDS for x in w) / max(1, len(w))
    if stop >= sparse and size >= long or stop >= dense and len(w) >= 8:
        return GOOD, "density"
    if size >= long and not block.article:
        return BAD, "density"
    return OPEN, ""


def nearest(labels: list[int]) -> list[tuple[int | None, int | None]]:
    """For each place the nearest decided ones before and after it."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        last = i if labels[i] else last
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] else last
    return list(zip(before, after, strict=True))


def inherit(labels: list[int], doubt: int = BAD) -> list[int]:
    """Second pass over one run of blocks."""
    out = []
    for i, (x, (a, b)) in enumerate(zip(labels, nearest(labels), strict=True)):
        if x:
            out.append(x)
        elif a is None or b is None:
            k = b if a is None else a
            out.append(doubt if k is None else labels[k])
        elif labels[a] == labels[b]:
            out.append(labels[a])
        else:
            out.append(doubt if i - a == b - i else labels[a if i - a < b - i else b])
    return out


def classify(found: list[Block]) -> list[tuple[int, str]]:
    """Both passes: each block's label and the rule that gave it, `neighbours` in the second pass."""
    first = [label(b) for b in found]
    out = list(zip(inherit([x for x, _ in first]), (rule or "neighbours" for _, rule in first), strict=True))
    runs: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(found):
        if b.article and first[i][1] != "container":
            runs.setdefault((b.article, b.doubt), []).append(i)
    for (_, doubtful), places in runs.items():
        for i, x in zip(places, inherit([first[i][0] for i in places], BAD if doubtful else GOOD), strict=True):
            out[i] = x, out[i][1]
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n\n".join(b.text for b, (x, _) in zip(found, classify(found), strict=True) if x == GOOD)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Returns key, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    return pages.select(F.col(f"`{key}`").cast("long"), F.col(f"`{url}`").cast("string"), F.col(f"`{html}`")).mapInArrow(run, "key long, url string, text string, n_chars long")


def op8(spark, sf_dir: str) -> DataFrame:
    """Query op8_html_extraction."""
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")
