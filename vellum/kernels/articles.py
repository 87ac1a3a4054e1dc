"""Clipped pages to blocks by a walk over their elements; cleaning and extraction of whole pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..operators.articles import FOLD_MARKERS, FOLDED_LENGTH, LAZY, OVERLAY_KEYWORDS, RESTORED
from ..schemas import block, merged, numbered, run
from .tree import Element, parse

BLOCK_TAGS = frozenset(
    "p div section article main blockquote pre table ul ol li h1 h2 h3 h4 h5 h6 figure figcaption hr dl dt dd header footer aside nav details summary center form".split()
)
SKIPPED = frozenset({"script", "style", "noscript", "template", "head", "iframe", "svg", "canvas", "button", "input", "select"})
BOLD = frozenset({"b", "strong", "h1", "h2", "h3", "h4", "h5", "h6", "th"})
ITALIC = frozenset({"i", "em", "cite", "var"})
STRUCK = frozenset({"s", "del", "strike"})


def image_address(node: Element, page: str | None = None) -> str | None:
    """Address of an image: the first usable of the attributes in which pages keep it."""
    return next((url for name in LAZY if (url := usable_address(node.attrs.get(name, ""), page))), None)


def usable_address(raw: str, page: str | None = None) -> str | None:
    """An image address made absolute; None for drawings, blank pages and whatever is neither of the web nor inline."""
    raw = raw.strip()
    if not raw or raw.lower().startswith("data:image/svg") or raw == "about:blank":
        return None
    try:
        url = urljoin(page, raw) if page else raw
    except ValueError:
        url = raw
    url = "https:" + url if url.startswith("//") else url
    return url if url.lower().startswith(("http://", "https://", "data:image/")) else None


def inline_runs(node: Element, bold=False, italic=False, strike=False) -> list[dict]:
    out: list[dict] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(run(re.sub(r"\s+", " ", c), bold, italic, strike))
        elif c.tag == "br":
            out.append(run("\n", bold, italic, strike))
        elif c.tag not in SKIPPED and c.tag not in ("img", "rt", "rp"):
            out += inline_runs(c, bold or c.tag in BOLD, italic or c.tag in ITALIC, strike or c.tag in STRUCK)
    return out


def trimmed(runs: list[dict]) -> list[dict]:
    """Merged runs without white space at the ends and doubled blanks at the joints."""
    out = [dict(r) for r in merged(runs)]
    for a, b in zip(out, out[1:]):
        if a["text"].endswith((" ", "\n")):
            b["text"] = b["text"].lstrip(" ")
    while out and not out[0]["text"].strip():
        out.pop(0)
    while out and not out[-1]["text"].strip():
        out.pop()
    if out:
        out[0]["text"] = out[0]["text"].lstrip()
        out[-1]["text"] = out[-1]["text"].rstrip()
    return merged(out)


def table_block(node: Element) -> dict | None:
    """Header from thead, else from the first row with header cells, else the first row; rows may be ragged."""
    rows = [e for e in node.walk() if e.tag == "tr"]
    cells = [[c for c in r.elements() if c.tag in ("td", "th")] for r in rows]
    pairs = [(r, c) for r, c in zip(rows, cells) if c]
    if not pairs:
        return None
    head = next((k for k, (r, _) in enumerate(pairs) if r.parent is not None and r.parent.tag == "thead"), None)
    if head is None:
        head = next((k for k, (_, c) in enumerate(pairs) if any(x.tag == "th" for x in c)), 0)
    runs = [[trimmed(inline_runs(x)) for x in c] for _, c in pairs]
    return block("table", headers=runs[head], rows=[r for k, r in enumerate(runs) if k != head])


def leaf_blocks(node: Element, kind: str = "paragraph", **fields) -> list[dict]:
    runs = trimmed(inline_runs(node, bold=kind == "heading"))
    out = [block(kind, runs, **fields)] if runs else []
    images = [node] if node.tag == "img" else [e for e in node.walk() if e.tag == "img"]
    return out + [block("image", image=url) for e in images if (url := image_address(e))]


def element_blocks(node: Element, depth: int = 0, top_heading: int = 1) -> list[dict]:
    """Blocks of one element: containers are entered, others are leaves.

    Text that stands beside block children of a container is kept as paragraphs of its own.
    """
    tag = node.tag
    if tag in SKIPPED:
        return []
    if tag[:1] == "h" and tag[1:].isdigit():
        return leaf_blocks(node, "heading", level=min(max(int(tag[1:]) + top_heading, 1 + top_heading), 6))
    if tag == "hr":
        return [block("hr")]
    if tag == "pre":
        code = node.find("code")
        language = re.search(r"language-(\S+)", (code or node).attrs.get("class", ""))
        text = node.text().strip("\n")
        return [block("code", text=text, language=language[1] if language else None)] if text.strip() else []
    if tag == "table" and node.find("th", "td"):
        inner = [e for e in node.walk() if e.tag in ("p", "div", "ul", "ol", "pre")]
        if len([e for e in node.walk() if e.tag in ("td", "th")]) > 1 or not inner:
            b = table_block(node)
            return [b] if b else []
    if tag in ("ul", "ol"):
        out, number = [], 0
        for item in node.elements():
            if item.tag == "li":
                nested = [c for c in item.elements() if c.tag in ("ul", "ol")]
                bare = Element("li", item.attrs)
                bare.children = [c for c in item.children if c not in nested]
                part = leaf_blocks(bare, "list_item", level=depth, ordered=tag == "ol", order_index=number + 1 if tag == "ol" else None)
                number += bool(part)
                out += part
                for n in nested:
                    out += element_blocks(n, depth + 1, top_heading)
            else:
                out += element_blocks(item, depth + 1, top_heading)
        return out
    if tag == "blockquote":
        inner = container_blocks(node, depth, top_heading)
        return [b | {"kind": "quote"} if b["kind"] in ("paragraph", "list_item") else b for b in inner]
    if any(c.tag in BLOCK_TAGS for c in node.elements()):
        return container_blocks(node, depth, top_heading)
    return leaf_blocks(node)


def container_blocks(node: Element, depth: int = 0, top_heading: int = 1) -> list[dict]:
    out: list[dict] = []
    loose = Element("p")

    def flush() -> None:
        out.extend(leaf_blocks(loose))
        loose.children = []

    for c in node.children:
        if isinstance(c, Element) and c.tag in BLOCK_TAGS:
            flush()
            out.extend(element_blocks(c, depth, top_heading))
        else:
            loose.children.append(c)
    flush()
    return out


def article_blocks(article_id, title, content) -> Iterator[dict]:
    """Rows of one article: its title as heading of level 1, headings of its text one level lower."""
    blocks = [block("heading", [run(title.strip(), bold=True)], level=1)] if title and title.strip() else []
    if content:
        blocks += container_blocks(parse(content))
    for b in numbered(blocks):
        yield {"doc_id": article_id, **b}


#: Elements of the page's frame; parts of class names and of ids of advertisements; names of the main text.
STRUCTURE = ("script", "style", "noscript", "iframe", "svg", "canvas", "form", "nav", "header", "footer", "aside")
NOISE_CLASSES = ("advert", "recommend", "related", "share-bar", "social-share")
NOISE_IDS = ("advert",)
FALLBACKS = ("RichContent-inner", "Post-RichText", "RichText", "js_content", "article-content")
LEAST_TEXT = 50
#: Hidden elements with more text than this hold folded text and are shown.
FOLDED_TEXT = 200


def cleaned_page(root: Element, page: str | None = None) -> Element:
    """Without frame, advertisements and overlays; hidden parts with much text are shown, they hold folded text."""

    def keep(node: Element) -> bool:
        classes, name = node.attrs.get("class", ""), node.attrs.get("id", "")
        if node.tag in STRUCTURE or any(k in classes for k in NOISE_CLASSES) or any(k in name for k in NOISE_IDS):
            return False
        return not any(k in classes.lower() or k in name.lower() for k in OVERLAY_KEYWORDS)

    def show(node: Element) -> None:
        if is_hidden(node) and len(" ".join(node.text().split())) > FOLDED_TEXT:
            node.attrs.pop("hidden", None)
            node.attrs["style"] = re.sub(r"(?i)display\s*:\s*none", "display:block", node.attrs.get("style", ""))

    def prune(node: Element) -> None:
        node.children = [c for c in node.children if isinstance(c, str) or keep(c)]
        for c in node.elements():
            show(c)
            prune(c)

    for image in [e for n in root.walk() if n.tag == "noscript" for e in n.elements() if e.tag == "img"]:
        holder = image.parent
        at = holder.parent.children.index(holder)
        holder.parent.children.insert(at, image)
        holder.children.remove(image)
        image.parent = holder.parent
    for image in [e for e in root.walk() if e.tag == "img"]:
        if url := next((u for name in RESTORED if (u := usable_address(image.attrs.get(name, ""), page))), None):
            image.attrs["src"] = url
        elif image.attrs.get("src", "").strip().startswith("//"):
            image.attrs["src"] = "https:" + image.attrs["src"].strip()
    prune(root)
    return root


def is_hidden(node: Element) -> bool:
    style = node.attrs.get("style", "").lower()
    return "hidden" in node.attrs or "display:none" in style or "display: none" in style


def without_hidden(root: Element) -> Element:
    """Without what a page still hides once folded text is shown."""
    for node in (root, *root.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or not is_hidden(c)]
    return root


def _score(node: Element) -> float:
    """Text of the node's own paragraphs, weighed by commas and against links."""
    own = [c for c in node.elements() if c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "h2", "h3")]
    text = "".join(c.text() for c in own)
    links = sum(len(a.text()) for c in own for a in c.walk() if a.tag == "a")
    size = len(text.strip())
    return (size + 10 * len(re.findall("[,，、;；]", text))) * (1 - links / max(size, 1)) if size else 0.0


def main_content(html: str) -> tuple[str | None, list[dict], bool, str | None]:
    """(title, blocks, possibly truncated, error) of a whole page, by the best-scoring element."""
    root = parse(html)
    page_text = " ".join(root.text().split())
    head = root.find("title")
    title_of_head = " ".join(head.text().split()) if head is not None else None
    without_hidden(cleaned_page(root))
    candidates = [e for e in root.walk() if e.tag in ("article", "main", "section", "div", "body", "td")] or [root]
    best = max(candidates, key=_score)
    if len("".join(best.text().split())) < LEAST_TEXT:
        named = [e for e in root.walk() if any(f in (e.attrs.get("class", ""), e.attrs.get("id", "")) for f in FALLBACKS) or e.tag in ("article", "main")]
        best = next((e for e in named if len(e.text().strip()) >= LEAST_TEXT), best)
    size = len(" ".join(best.text().split()))
    if not size:
        return title_of_head, [], False, "no text"
    if size < LEAST_TEXT:
        return title_of_head, [], False, "text too short"
    h1 = root.find("h1")
    title = (" ".join(h1.text().split()) if h1 is not None else "") or title_of_head
    truncated = size < FOLDED_LENGTH and any(m in page_text for m in FOLD_MARKERS)
    return title, numbered(container_blocks(best)), truncated, None
