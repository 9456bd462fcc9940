"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's void and block elements; elements, roles and class or id words of what isn't an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html tbody td tfoot th thead title tr".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
OUTSIDE = frozenset("nav footer aside form head menu dialog button select option label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login comment comments reply replies respond disqus share sharing social related recommended "
    "recommendations widget toolbar pagination pager skip search copyright paywall".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。、！？；：，]")
#: A tag up to its end; a quoted value may hold `>`. Possessive: what was read once isn't tried again.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the mean fused ratio that a path needs, width of the smoothing in blocks, share of a path's text in links from which its
#: blocks are lists of links.
THRESHOLD, WIDTH, LINKS = 0.5, 1.0, 0.5


class Block(NamedTuple):
    path: int  # tags from the root to the block, by number
    element: int  # the block element it stands in
    text: str
    linked: int  # characters inside links
    out: bool  # in an element that is no part of an article by its tag, role or style
    named: int  # the innermost element around it whose class or id says so, by number; 0 is none


class Page:
    """A page's blocks in order, with its block elements: tag, parent and path of each (element 0 is the root)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.tags, self.parents, self.paths = [""], [0], [0]
        numbers: dict[tuple[int, str], int] = {}  # (path of the parent, tag): path
        self.around = [0]  # of each element with such a class or id the next one around it
        stack: list[tuple[str, int, bool, int]] = []  # tag, block element, in something outside, innermost such element
        opened: Counter[str] = Counter()
        text: list[str] = []
        linked = at = 0
        quotes = True  # until a quote is found that never ends

        def flush() -> None:
            nonlocal linked
            words = entities.unescape("".join(text)).split()
            if words:
                element, out, named = stack[-1][1:] if stack else (0, False, 0)
                self.blocks.append(Block(self.paths[element], element, " ".join(words), linked, out, named))
            text.clear()
            linked = 0

        def close(tag: str) -> None:
            while True:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == tag:
                    return

        while True:
            lt = page.find("<", at)
            piece = page[at:] if lt < 0 else page[at:lt]
            if piece:
                text.append(piece)
                if opened["a"]:
                    linked += len(piece)
            if lt < 0:
                break
            kind = page[lt + 1 : lt + 2]
            if kind in ("!", "?"):
                end = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
                at = end if end > 2 or end and not page.startswith("<!--", lt) else len(page)
                continue
            name = page[lt + 2 : lt + 3] if kind == "/" else kind
            if not (name.isascii() and name.isalpha()):
                if kind == "/":
                    at = page.find(">", lt) + 1 or len(page)
                else:
                    text.append("<")
                    at = lt + 1
                continue
            m = TAG.match(page, lt) if quotes else None
            if m:
                closing, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
            else:
                quotes = False
                at = page.find(">", lt) + 1 or len(page)
                if page[at - 1] != ">":
                    break
                closing, (tag, _, attributes) = "/" * (kind == "/"), page[lt + 1 + (kind == "/") : at - 1].replace("/", " ").partition(" ")
                tag = (tag.split() or [""])[0].lower()
            if closing:
                if opened[tag]:
                    if tag in BLOCKS:
                        flush()
                    close(tag)
                continue
            if tag in RAW:  # what it holds isn't markup or isn't text
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag in BLOCKS:
                flush()
                if tag in CLOSES_P and opened["p"]:
                    close("p")
                if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                    close(tag)
            if tag == "br":
                text.append(" ")
            if tag in VOID or attributes.endswith("/"):
                continue
            element, out, named = stack[-1][1:] if stack else (0, False, 0)
            out = out or outside(tag, attributes, bool(opened["article"] or opened["main"]))
            if not out and misnamed(tag, attributes):
                self.around.append(named)
                named = len(self.around) - 1
            if tag in BLOCKS:
                self.tags.append(tag)
                self.parents.append(element)
                self.paths.append(numbers.setdefault((self.paths[element], tag), len(numbers) + 1))
                element = len(self.tags) - 1
            stack.append((tag, element, out, named))
            opened[tag] += 1
        flush()

    def summed(self, values: list[int]) -> list[int]:
        """For each element the sum of its own value and those of all elements in it."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def inside(self, root: int) -> list[bool]:
        """For each element whether it is root or stands in it."""
        out = [root == 0]
        for e in range(1, len(self.tags)):
            out.append(e == root or out[self.parents[e]])
        return out


def outside(tag: str, attributes: str, inner: bool) -> bool:
    """Whether an element is a menu, footer, form or the like by its tag, role or style. inner: it stands in an article."""
    if tag in OUTSIDE or tag == "header" and not inner:
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def misnamed(tag: str, attributes: str) -> bool:
    """Whether a class or id of the element has a word for a menu, footer, advert or the like."""
    if tag in ("html", "body", "article", "main"):
        return False
    return any(name.lower() in ("class", "id") and not WORDS.isdisjoint(x.lower() for x in SPLIT.split(next((v for v in values if v), ""))) for name, *values in ATTRIBUTE.findall(attributes))


#: Share of a page's text that must be left once elements with such names are gone; else those of them that hold most of it stay.
LEFT = 0.1


def unnamed(page: Page) -> list[Block]:
    """The blocks that stand in nothing outside, by tag, role, style, class or id. If hardly any text is left, a name was misread:
    an element that holds more than half of the text stays whatever it is called."""
    inner = [b for b in page.blocks if not b.out]
    left = [b for b in inner if not b.named]
    total = sum(len(b.text) for b in inner)
    if sum(len(b.text) for b in left) >= LEFT * total:
        return left
    held = [0] * len(page.around)
    for b in inner:
        held[b.named] += len(b.text)
    for e in range(len(held) - 1, 0, -1):
        held[page.around[e]] += held[e] * (page.around[e] > 0)
    gone = [False]
    for e in range(1, len(held)):
        gone.append(gone[page.around[e]] or held[e] <= total / 2)
    return [b for b in inner if not gone[b.named]]


def scores(blocks: list[Block]) -> tuple[dict[int, float], dict[int, float]]:
    """(fused ratio, share of text in links) of each path.

    A path's ratio is its mean text a block, raised by punctuation and lowered by links; blocks take their path's ratio,
    smoothed with their neighbours', and a path's fused ratio is the mean of both over its blocks.
    """
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for i, x in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), b.linked, 1)):
            s[i] += x
    links = {p: s[2] / max(s[0], 1) for p, s in sums.items()}
    ratio = {p: s[0] / s[3] * (1 + s[1] / s[3]) * max(0.05, 1 - links[p]) for p, s in sums.items()}
    row = [ratio[b.path] for b in blocks]
    weight = [math.exp(-(k**2) / (2 * WIDTH**2)) for k in (-2, -1, 0, 1, 2)]
    fused: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        near = [(weight[k + 2], row[i + k]) for k in (-2, -1, 0, 1, 2) if 0 <= i + k < len(row)]
        fused.setdefault(b.path, []).append((row[i] + sum(w * x for w, x in near) / sum(w for w, _ in near)) / 2)
    return {p: sum(x) / len(x) for p, x in fused.items()}, links


def content(page: Page) -> list[Block]:
    """The blocks of the article.

    The paths whose fused ratio is over the threshold are content; the element that holds most of their text is the article.
    Where the page doesn't mark it as one (article or main), it goes from the first block of a content path, with the headings
    right before it, to the last, so that what stands before and behind falls away without any name. Inside, short blocks
    belong to it, but for those of paths that are mostly links. Blocks in elements that are no part of an article (see unnamed) take no
    part at all.
    """
    left = unnamed(page)
    if not left:
        return []
    score, links = scores(left)
    limit = THRESHOLD * sum(score[b.path] for b in left) / len(left)
    own = [0] * len(page.tags)
    for b in left:
        if score[b.path] >= limit:
            own[b.element] += len(b.text)
    total, held = sum(own), page.summed(own)
    # The deepest article or main element with most of the text, else the deepest element with nearly all of it: elements that
    # hold most of the text lie in each other, so the last is the deepest.
    marked = [e for e, n in enumerate(held) if page.tags[e] in ("article", "main") and n > 0.5 * total]
    guessed = [e for e, n in enumerate(held) if n >= 0.9 * total and page.tags[e] not in LEAVES]
    within = page.inside((marked or guessed)[-1])
    found = [b for b in left if within[b.element]]
    if not marked:
        at = [i for i, b in enumerate(found) if score[b.path] >= limit]
        lo, hi = at[0], at[-1] + 1
        while lo and page.tags[found[lo - 1].element] in HEADINGS:
            lo -= 1
        found = found[lo:hi]
    return [b for b in found if links[b.path] < LINKS or score[b.path] >= limit]


def main_text(page: str) -> str:
    return "\n".join(b.text for b in content(Page(page)))


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """For each row of pages (html) the columns in keep, text (the article's blocks, a line each; empty if none) and n_chars.

    Null html counts as empty; cut-off markup ends where the page ends; columns not in keep are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    chosen = pages.select(*keep, F.coalesce("html", F.lit("")).alias("_html"))
    kinds = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
