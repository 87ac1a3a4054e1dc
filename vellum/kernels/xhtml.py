"""Pages as safe XHTML bodies for books."""

from __future__ import annotations

from html import escape
from urllib.parse import urljoin

from .articles import usable_address
from .tree import VOID, Element, parse

#: Elements that a book keeps, and those that go with all they hold.
SAFE = frozenset(
    "h1 h2 h3 h4 h5 h6 p div span section article br hr blockquote ul ol li b strong i em u s sub sup pre code table thead tbody tr td th figure figcaption img a".split()
)
GONE = frozenset({"script", "style", "noscript", "iframe"})
#: Attributes in which an image's address is looked for.
SOURCES = ("data-actualsrc", "data-original", "data-src", "data-origin-src", "data-lazy-src", "data-echo", "src")


def absolute(address: str, page: str | None) -> str | None:
    """An address made absolute; None unless it is one of the web."""
    try:
        url = urljoin(page or "", address.strip())
    except ValueError:
        return None
    return url if url.lower().startswith(("http://", "https://")) else None


def _opened(node: Element, page: str | None) -> tuple[str, str | None]:
    """Start tag of a safe element, and the address of the image it is."""
    kept: dict[str, str] = {}
    address = None
    if node.tag == "img":
        web = (u for name in SOURCES if (u := usable_address(node.attrs.get(name, ""), page)) and not u.lower().startswith("data:"))
        address = next(web, None) or absolute(node.attrs.get("src", ""), page)
        if address:
            kept["src"] = address
        if "alt" in node.attrs:
            kept["alt"] = node.attrs["alt"]
    elif node.tag == "a" and (url := absolute(node.attrs.get("href", ""), page)) and node.attrs.get("href", "").strip():
        kept["href"] = url
    tag = "".join([node.tag, *(f' {k}="{escape(v)}"' for k, v in kept.items())])
    return (f"<{tag}/>" if node.tag in VOID else f"<{tag}>"), address


def safe_body(content: str | None, page: str | None, images: bool = True) -> tuple[str, list[str]]:
    """(XHTML, addresses of its images in order): safe elements with their safe attributes, all other tags taken
    off their text.  Without ``images`` these and figures are left out.  Null content gives an empty body."""
    out: list[str] = []
    found: dict[str, None] = {}
    todo: list = list(reversed(parse(content or "").children))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # an end tag
            out.append(f"</{x[0]}>")
        elif isinstance(x, str):
            out.append(escape(x, quote=False).replace("\xa0", "&#160;"))
        elif x.tag in GONE or (not images and x.tag in ("img", "figure")):
            continue
        else:
            if x.tag in SAFE:
                start, address = _opened(x, page)
                out.append(start)
                if address:
                    found[address] = None
                if x.tag not in VOID:
                    todo.append((x.tag,))
            todo.extend(reversed(x.children))
    return "".join(c for part in out for c in part if c in "\t\n\r" or c >= " "), list(found)


def with_local_images(body: str, files: dict[str, str]) -> str:
    """A body whose images of known addresses are files of the book."""
    for url, name in files.items():
        body = body.replace(f'"{escape(url)}"', f'"../images/{name}"')
    return body
