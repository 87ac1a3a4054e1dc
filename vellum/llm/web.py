"""Lines of clipped pages: what a line of ``content_html`` shows, and what its mark-up says about it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import xxhash

TAG = re.compile(r"<[^>]*>")
DIGITS = re.compile(r"[0-9]+")
URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")
FIRST = re.compile(r"\s*<([A-Za-z][A-Za-z0-9]*)")
CONTAINER = re.compile(r"<(/?)(ul|ol|dl|pre|nav|aside|footer|header|form|menu|noscript)\b([^>]*)>", re.I)

BLOCK_START = re.compile(r"\s*<(?:p|div|section|article|aside|nav|footer|header|h[1-6]|table|blockquote)\b", re.I)

#: Tags inside which text belongs to the page and not to the article.
PAGE_TAGS = frozenset({"nav", "aside", "footer", "header", "form", "menu"})
LIST_TAGS = frozenset({"ul", "ol", "dl"})


def site_and_page(url: str | None) -> tuple[str | None, str | None]:
    """Lower-cased host of ``url`` and host with path; (None, None) where there is no host."""
    m = URL.match(url.strip()) if url else None
    if not m or not m[1]:
        return None, None
    host = m[1].lower()
    return host, host + m[2]


def brand(site: str | None) -> str | None:
    """The name a site goes by in its own notices: the label before the last one of the host."""
    labels = (site or "").split(":")[0].split(".")
    name = labels[-2] if len(labels) > 1 else labels[0]
    return name if len(name) > 2 else None


def visible(line: str) -> str:
    """Visible text of a line: tags removed, character references decoded."""
    text = TAG.sub("", line) if "<" in line else line
    return html.unescape(text) if "&" in text else text


def same_text(text: str) -> str:
    """Form in which squeezed line texts are compared: runs of digits alike."""
    return DIGITS.sub("0", text)


def key(*parts: str) -> int:
    """Signed 64-bit hash of the parts."""
    return xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)


class Line(NamedTuple):
    no: int
    raw: str
    text: str
    in_list: bool
    in_code: bool
    in_page_tag: bool
    noscript: bool
    tag: str


def lines_of(content: str | None) -> list[Line]:
    """Lines with visible text, each with the mark-up it stands in.

    Nesting is tracked leniently: an end tag closes the nearest open element of its name and one
    that matches nothing is ignored, so badly nested pages still give every line.
    """
    out: list[Line] = []
    lists = code = page = 0
    for no, raw in enumerate((content or "").split("\n")):
        if not raw:
            continue
        first = ""
        in_list, in_code, in_page, script = lists > 0, code > 0, page > 0, False
        if "<" in raw:
            if (lists or code) and BLOCK_START.match(raw):
                lists = code = 0  # a block begins: what was left open before it has ended
                in_list = in_code = False
            if m := FIRST.match(raw):
                first = m[1].lower()
            for m in CONTAINER.finditer(raw):
                name = m[2].lower()
                step = -1 if m[1] else (0 if m[3].endswith("/") else 1)
                if name in LIST_TAGS:
                    lists = max(0, lists + step)
                    in_list = in_list or lists > 0
                elif name == "pre":
                    code = max(0, code + step)
                    in_code = in_code or code > 0
                elif name in PAGE_TAGS:
                    page = max(0, page + step)
                    in_page = in_page or page > 0
                else:
                    script = True
        text = " ".join(visible(raw).split())
        if text:
            out.append(Line(no, raw, text, in_list, in_code, in_page, script, first))
    return out
