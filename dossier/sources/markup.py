"""A linear scanner of HTML: start tags with their attributes, end tags and text, in order."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NONE: dict[str, str] = {}
#: Elements whose content is text up to their end tag, whatever it holds.
RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style")}


@lru_cache(maxsize=10_000)
def attributes(text: str) -> dict[str, str]:
    """A start tag's attributes; pages repeat them, so they are shared and must not be changed."""
    return {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(text)}


class Scanner:
    """Calls start, end and data for a page's parts; an element without an end tag ends with the one around it."""

    def start(self, tag: str, own: dict[str, str]) -> None: ...

    def end(self, tag: str) -> None: ...

    def data(self, text: str) -> None: ...

    def feed(self, page: str) -> None:
        at = 0
        start_, end_, data = self.start, self.end, self.data
        found = TAG.finditer(page)
        while m := next(found, None):
            begin, end = m.span()
            if begin > at:
                text = page[at:begin]
                data(unescape(text) if "&" in text else text)
            at = end
            close, tag, own = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            if close:
                end_(tag)
                continue
            # A very long value, such as an image in the page, isn't worth remembering.
            start_(tag, NONE if not own else attributes(own) if len(own) < 200 else attributes.__wrapped__(own))
            if tag in RAW:
                close = RAW[tag].search(page, at)
                stop = close.start() if close else len(page)
                data(page[at:stop])
                at = stop
                found = TAG.finditer(page, at)
        if at < len(page):
            self.data(unescape(page[at:]))


def cleaned(parts: list[str]) -> str:
    return " ".join("".join(parts).split())
