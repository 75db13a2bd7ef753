"""Main text of web pages by two passes of block rules.

A page falls into blocks at block-level tags. The first pass classifies each by
the share of stop words, length and link density, and by where it stands: what
is inside menus, headers, footers, sidebars, notices, adverts, forms or reader
comments is boilerplate whatever it says, and what else is inside an article
element has lower thresholds to meet. Blocks too short to tell, and those that
are nearly good, are decided in the second pass by their nearest decided
neighbours, those inside an article by others inside, the rest by the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare

# Thresholds, tag names, marks of boilerplate, and common words.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
STOP_ARTICLE = 0.05  # inside an article; below it a block without a sentence mark is a list of words
MAX_LINKS, MAX_ARTICLE_LINKS = 0.2, 0.5
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript script style svg template textarea title xmp".split())
BOILER_TAGS = frozenset("aside button dialog footer form head menu nav object select audio video canvas".split())
CONTENT_TAGS = frozenset("article main".split())
#: Tags whose next one closes them, if nothing of the second kind was opened between.
CLOSES_ITSELF = {"p": BLOCK_TAGS, "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
                 "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"])}
BOILER_MARKS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent
cookie cookies dialog disqus footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices pager pagination paywall popup
promo promoted promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe
subscription teaser toolbar widget widgets""".split())
#: Marks that count outside an article only: an article's own header has its title.
HEADER_MARKS = frozenset("header masthead topbar".split())
#: Words beside a mark in a compound name that leave its meaning: "site-footer", "comment-body".
NEUTRAL_MARKS = frozenset("""area article bar block body bottom box btn button buttons col column container content desktop entry fixed form global group header
icon icons inner item items left line link links list main mobile outer page panel post primary reader right row secondary section site slot sticky thread
title top unit user wrap wrapper""".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
STOP_WORDS = frozenset("""a about after all also an and any are as at be because been but by can could did do for from had has have he her his
how i if in into is it its just like more most my no not now of on one only or other our out over she so some such than that the their them then
there these they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann
mit nach nicht noch nur oder schon sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour
qu que qui sa sans se ses son sont sur te tu un une vous y
al como con de del desde donde el ella en entre era es esta este esto fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser
si sin sobre son su sus también te tiene todo un una uno y ya""".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.;!?…。！？।؟]")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    boiler: bool
    content: bool  # inside an article
    wrapped: bool = False  # boilerplate only by names of elements around the article, or of its own
    label: str = ""


def _marked(names: str, marks: frozenset[str]) -> bool:
    """Whether one of the class names is a mark: as a whole, or made of marks and
    words that leave their meaning. "has-sidebar" and "comments-open" are neither."""
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if any(x in marks for x in parts) and all(x in BOILER_MARKS or x in HEADER_MARKS or x in NEUTRAL_MARKS for x in parts):
            return True
    return False


def _where(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool, bool]:
    """Whether an element makes what is in it boilerplate: by what it is, by its
    names; and whether it makes it content."""
    boiler = tag in BOILER_TAGS or tag == "header" and not in_content
    content, named = tag in CONTENT_TAGS, False
    if attributes and not boiler and tag not in ("html", "body"):
        for name, value in _MARKS.findall(attributes):
            value, name = value.strip("\"'").lower(), name.lower()
            if name in ("class", "id"):
                named = named or _marked(value, BOILER_MARKS) or not in_content and _marked(value, HEADER_MARKS)
            elif name == "role":
                boiler = boiler or value in BOILER_ROLES
                content = content or value in ("main", "article")
            elif name == "itemprop":
                content = content or value == "articlebody"
            elif name == "hidden" or value == "true":
                boiler = True
    return boiler, named, content


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order; tags need not be closed."""
    out: list[Block] = []
    text: list[str] = []
    links = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate by what it is or by a name inside content, content, named around content
    in_link = -1  # how many elements were open where the link began

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, boiler, content, named = stack[-1] if stack else ("", False, False, False)
                out.append(Block(joined, links, boiler or named, content, content and named and not boiler))
            text.clear()
            links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text.append(html.unescape(raw))
            if in_link >= 0:
                links += len("".join(text[-1].split()))

    at = 0
    while (m := _MARKUP.search(page, at)) is not None:
        add(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if tag == "a":
            # without an address it is no link, and without an end it ends with the element around it
            in_link = len(stack) if not closing and _HREF.search(m[3] or m[6] or "") else -1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW_TAGS:
            if not closing:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag in BLOCK_TAGS or tag in BOILER_TAGS:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            if len(stack) < in_link:
                in_link = -1
            continue
        if tag in VOID_TAGS:
            continue
        if tag in CLOSES_ITSELF or tag in BLOCK_TAGS:
            for open_tag in ("p", tag) if tag in CLOSES_ITSELF else ("p",):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == open_tag:
                        del stack[i:]
                        break
                    if stack[i][0] in CLOSES_ITSELF[open_tag]:
                        break
        if len(stack) < in_link:
            in_link = -1
        _, boiler, content, named = stack[-1] if stack else ("", False, False, False)
        new_boiler, new_named, new_content = _where(tag, m[3] or m[6] or "", content)
        # inside content a name says what it says; around it, or on it, it may be about the page's layout
        stack.append((tag, boiler or new_boiler or new_named and content and not new_content, content or new_content, named or new_named and (new_content or not content)))
    add(page[at:])
    flush()
    return out


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _density(b: Block) -> float:
    return b.links / max(1, len("".join(b.text.split())))


def _first_pass(b: Block) -> str:
    if b.boiler or _density(b) > MAX_LINKS or "©" in b.text:
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.links else "short"
    stop = _stop_share(b.text)
    if stop >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stop >= STOP_LOW else "bad"


def _first_pass_inside(b: Block, known: bool) -> str:
    """For blocks inside an article; ``known``: its language has known stop words."""
    density = _density(b)
    if density > MAX_ARTICLE_LINKS or "©" in b.text and len(b.text) < SHORT:
        return "bad"
    stop = _stop_share(b.text)
    if density > MAX_LINKS:
        return "near" if stop >= STOP_LOW or not known else "bad"
    if len(b.text) < SHORT:
        return "near" if stop >= STOP_LOW else "short"
    if stop >= STOP_LOW:
        return "good"
    return "list" if known and stop < STOP_ARTICLE and not _SENTENCE.search(b.text) else "near"


def _sides(labels: list[str], decided: tuple[str, ...], left: str = "bad", right: str = "bad") -> tuple[list[str], list[str]]:
    """For each block the nearest decided label before it and after it, by one
    sweep each; beyond the edges stand ``left`` and ``right``."""
    sides = []
    for order, x in ((labels, left), (labels[::-1], right)):
        side = []
        for label in order:
            side.append(x)
            x = label if label in decided else x
        sides.append(side)
    return sides[0], sides[1][::-1]


def _outside(found: list[Block], has_article: bool) -> list[str]:
    """Labels by both passes. Short blocks take their decided neighbours' label
    where both agree; between a good and a bad one, they are good if the nearest
    block that isn't short is nearly good on the good side. Blocks nearly good
    are good beside a good one. A page on which nothing is good, but has long
    blocks without links, has a language without known stop words: those blocks
    are then good."""
    first = [_first_pass(b) for b in found]
    if not has_article and "good" not in first and "near" not in first:
        first = ["good" if not b.boiler and len(b.text) >= SHORT and not b.links and "©" not in b.text else x for b, x in zip(found, first)]
    around = list(zip(*_sides(first, ("good", "bad"))))
    beside = list(zip(*_sides(first, ("good", "bad", "near"))))
    labels = list(first)
    for i, x in enumerate(first):
        if x == "short":
            labels[i] = around[i][0] if around[i][0] == around[i][1] else "good" if "near" in beside[i] else "bad"
    after = _sides(labels, ("good", "bad"))[1]
    before = "bad"
    for i, x in enumerate(labels):
        if x == "near":
            labels[i] = "good" if "good" in (before, after[i]) else "bad"
        before = labels[i]
    return labels


def _inside(found: list[Block]) -> list[str]:
    """Labels by both passes inside an article. Blocks nearly good are good unless
    they stand between two bad ones, the article's edges being good. Then lists of
    words are good between two good ones, and last short blocks beside a good one;
    for these the end counts as bad. With nothing good, both are good."""
    known = any(len(b.text) >= SHORT and _stop_share(b.text) >= STOP_LOW for b in found)
    first = [_first_pass_inside(b, known) for b in found]
    around = lambda labels, end: list(zip(*_sides(labels, ("good", "bad"), "good", end)))
    sure = [x if x != "near" else "good" if "good" in near else "bad" for x, near in zip(first, around(first, "good"))]
    if "good" not in sure:
        return ["good" if x in ("short", "list") else x for x in sure]
    sure = [x if x != "list" else "good" if near == ("good", "good") else "bad" for x, near in zip(sure, around(sure, "bad"))]
    return [x if x != "short" else "good" if "good" in near else "bad" for x, near in zip(sure, around(sure, "bad"))]


def classify(found: list[Block]) -> list[Block]:
    """Labels each block good or bad, those inside an article among themselves and
    the others among themselves. What is marked as boilerplate inside an article,
    an advert between two paragraphs, says nothing about its neighbours. Names of
    elements around an article (a layout "with sidebar") count while there is
    another article without such names; on a page whose only content has them,
    they don't."""
    if not any(b.content and not b.boiler for b in found):
        for b in found:
            b.boiler = b.boiler and not b.wrapped
    inside = [b for b in found if b.content and not b.boiler]
    outside = [b for b in found if not b.content]
    for b in found:
        b.label = "bad"
    for b, x in zip((*inside, *outside), (*_inside(inside), *_outside(outside, bool(inside)))):
        b.label = x
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row of ``pages``, and ``text``, the main text
    of the whole page: blocks joined by an empty line, white space inside a block
    one space. Null and empty pages, and pages without content, have empty text.
    Rows are independent: ids may be null or tied, repeated rows each get a row,
    other columns are not read, an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f"c{i}") for i in range(len(keep))), texts], names=[*(f"c{i}" for i in range(len(keep))), "text"])

    prepare(pages.sparkSession)
    rows = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(html_col).alias("html"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "html"), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).toDF(*keep, "text")
