"""Books in archives: EPUB, DOCX and MOBI to blocks, and EPUB packages from chapters."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from ..schemas import block, merged, numbered, run
from ..sources.decode import decode_file
from .articles import container_blocks
from .tree import VOID, Element, parse


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node.iter() if local(c.tag) == name]


def normal_path(base: str, href: str) -> str:
    """Path of a reference inside an archive: percent-decoded, without fragment and query, dots resolved."""
    target = unquote(re.split(r"[#?]", href)[0].strip()).replace("\\", "/")
    if not target:
        return base
    out: list[str] = []
    for part in (target if target.startswith("/") else posixpath.join(posixpath.dirname(base), target)).split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def archive(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}


def entry(files: dict[str, bytes], path: str) -> bytes | None:
    """Entry by exact path, then without case, then by its file name alone."""
    if path in files:
        return files[path]
    low = {k.lower(): v for k, v in files.items()}
    if path.lower() in low:
        return low[path.lower()]
    name = path.rpartition("/")[2].lower()
    return next((v for k, v in low.items() if k.rpartition("/")[2] == name), None)


def _shift_headings(blocks: list[dict]) -> list[dict]:
    """Headings of book chapters keep their own level."""
    return [b | {"level": b["level"] - 1} if b["kind"] == "heading" and b["level"] > 1 else b for b in blocks]


def parse_epub(data: bytes) -> dict:
    """``title, author, blocks, toc, error``; chapters are parted by page breaks, broken ones are left out."""
    try:
        files = archive(data)
        container = ET.fromstring(entry(files, "META-INF/container.xml"))
        opf_path = next(r.get("full-path") for r in _children(container, "rootfile"))
        opf = ET.fromstring(entry(files, opf_path))
    except Exception as e:  # a book that can't be read is a row that says so
        return _failed(f"EPUB: {e}")
    manifest = {i.get("id"): i for i in _children(opf, "item")}
    title = next((t.text for t in _children(opf, "title") if t.text), "") or ""
    author = next((t.text for t in _children(opf, "creator") if t.text), "") or ""
    blocks: list[dict] = []
    anchors: dict[tuple[str, str], int] = {}
    starts: dict[str, int] = {}
    for ref in _children(opf, "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is None:
            continue
        path = normal_path(opf_path, item.get("href", ""))
        raw = entry(files, path)
        if raw is None:
            continue
        try:
            root = parse(decode_file(raw, False) or "")
            part, places = _placed_blocks(root.find("body") or root)
            part = _shift_headings(part)
        except Exception:
            continue
        if not part:
            continue
        if blocks:
            blocks.append(block("page_break"))
        starts.setdefault(path, len(blocks))
        for name, k in places:
            for found in ((path, name), (path.lower(), name.lower()), ("", name), ("", name.lower())):
                anchors.setdefault(found, len(blocks) + k)
        blocks += part
    toc = _epub_outline(files, opf, opf_path, manifest, anchors, starts)
    if not toc:
        toc = [(b["text"], b["level"], i) for i, b in enumerate(blocks) if b["kind"] == "heading"]
    return {"title": title, "author": author, "blocks": numbered(blocks), "error": None,
            "toc": [{"toc_ord": i, "title": t, "level": lv, "block_index": b} for i, (t, lv, b) in enumerate(toc)]}


#: Marks of an element's place in its text, taken out again once blocks are made.
PLACE = re.compile("\ue0f0(\\d+)\ue0f1")
#: Elements whose own text is no text: their mark goes into the first element below that has some.
STRUCTURAL = frozenset("table thead tbody tfoot tr ul ol dl colgroup".split())


def _names(e: Element) -> list[str]:
    return [n for n in (e.attrs.get("id", "").strip(), e.attrs.get("name", "").strip() if e.tag == "a" else "") if n]


def _placed_blocks(body: Element) -> tuple[list[dict], list[tuple[str, int]]]:
    """Blocks of a chapter, and the names of elements with the block in which each begins.

    Each named element is marked in its text; a mark is found again in the block that its text became, and
    one alone in its block stands for the block that follows.
    """
    named: list[str] = []
    for e in [body, *body.walk()]:
        for name in _names(e):
            mark = f"\ue0f0{len(named)}\ue0f1"
            named.append(name)
            at = e
            while at.tag in STRUCTURAL:
                below = at.elements()
                if not below:
                    break
                at = below[0]
            if at.tag in VOID and at.parent is not None:
                at.parent.children.insert(at.parent.children.index(at), mark)
            else:
                at.children.insert(0, mark)
    places: list[tuple[str, int]] = []
    out: list[dict] = []

    def bare(text: str | None) -> str | None:
        if not text or "\ue0f0" not in text:
            return text
        places.extend((named[int(n)], len(out)) for n in PLACE.findall(text))
        return PLACE.sub("", text)

    def bare_runs(runs: list[dict] | None) -> list[dict] | None:
        return runs and merged([r | {"text": bare(r["text"])} for r in runs])

    for b in container_blocks(body):
        marked = any("\ue0f0" in (r["text"] or "") for r in b["runs"] or []) or "\ue0f0" in (b["text"] or "")
        b = b | {"runs": bare_runs(b["runs"]), "headers": b["headers"] and [bare_runs(c) for c in b["headers"]], "rows": b["rows"] and [[bare_runs(c) for c in r] for r in b["rows"]]}
        if b["runs"] is not None:
            if marked and b["runs"]:
                b["runs"][0] = b["runs"][0] | {"text": b["runs"][0]["text"].lstrip()}
            b["text"] = "".join(r["text"] for r in b["runs"])
        else:
            b["text"] = bare(b["text"])
        if marked and not (b["text"] or "").strip() and b["kind"] in ("paragraph", "list_item", "quote", "heading"):
            continue  # the mark stood alone
        out.append(b)
    return out, [(n, min(k, max(len(out) - 1, 0))) for n, k in places]


def _epub_outline(files, opf, opf_path, manifest, anchors, starts) -> list[tuple[str, int, int]]:
    """Outline from the NCX, else from the navigation document; the level is the depth, from 0."""
    entries: list[tuple[str, int, str, str]] = []
    ncx = next((i for i in manifest.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
    if ncx is not None and (raw := entry(files, path := normal_path(opf_path, ncx.get("href", "")))) is not None:

        def points(node: ET.Element, depth: int) -> None:
            for p in node:
                if local(p.tag) == "navPoint":
                    text = next((t.text for t in p.iter() if local(t.tag) == "text"), "") or ""
                    src = next((c.get("src", "") for c in p if local(c.tag) == "content"), "")
                    entries.append((text.strip(), depth, normal_path(path, src), src.partition("#")[2]))
                    points(p, depth + 1)
                elif local(p.tag) == "navMap":
                    points(p, depth)

        points(ET.fromstring(raw), 0)
    if not entries:
        nav = next((i for i in manifest.values() if "nav" in (i.get("properties") or "").split()), None)
        if nav is not None and (raw := entry(files, path := normal_path(opf_path, nav.get("href", "")))) is not None:
            root = parse(decode_file(raw, False) or "")
            for a in (e for e in root.walk() if e.tag == "a" and e.attrs.get("href")):
                depth, up = -1, a
                while up is not None:
                    depth += up.tag == "ol"
                    up = up.parent
                entries.append((" ".join(a.text().split()), max(depth, 0), normal_path(path, a.attrs["href"]), a.attrs["href"].partition("#")[2]))
    by_path = {p.lower(): i for p, i in reversed(starts.items())}
    by_name = {p.rpartition("/")[2].lower(): i for p, i in reversed(starts.items())}
    out = []
    for title, level, path, anchor in entries:
        keys = ((path, anchor), (path.lower(), anchor.lower()), ("", anchor), ("", anchor.lower())) if anchor else ()
        at = next((anchors[k] for k in keys if k in anchors), None)
        at = starts.get(path) if at is None else at
        at = by_path.get(path.lower()) if at is None else at
        at = by_name.get(path.rpartition("/")[2].lower()) if at is None else at
        if at is not None and title:
            out.append((title, level, at))
    return out


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _on(props: ET.Element | None, name: str) -> bool:
    node = props.find(W + name) if props is not None else None
    return node is not None and node.get(W + "val", "true").lower() not in ("0", "false", "off", "none")


def _docx_runs(par: ET.Element) -> list[dict]:
    out = []
    for r in par.iter(W + "r"):
        props = r.find(W + "rPr")
        style = (_on(props, "b"), _on(props, "i"), _on(props, "strike"))
        for c in r:
            if c.tag == W + "t":
                out.append(run(c.text or "", *style))
            elif c.tag == W + "tab":
                out.append(run("\t", *style))
            elif c.tag == W + "br" and c.get(W + "type") != "page":
                out.append(run("\n", *style))
    return out


def _docx_heading(props: ET.Element | None) -> int | None:
    if props is None:
        return None
    style = props.find(W + "pStyle")
    name = (style.get(W + "val") or "") if style is not None else ""
    if m := re.search(r"(?:heading|标题)\s*(\d)", name, re.I):
        return int(m[1])
    outline = props.find(W + "outlineLvl")
    if outline is not None and (outline.get(W + "val") or "").isdigit() and int(outline.get(W + "val")) <= 5:
        return int(outline.get(W + "val")) + 1
    return None


def parse_docx(data: bytes) -> dict:
    """``title, author, blocks, toc, error`` of a Word file."""
    try:
        files = archive(data)
        body = ET.fromstring(files["word/document.xml"]).find(W + "body")
    except Exception as e:
        return _failed(f"DOCX: {e}")
    title = author = ""
    if core := files.get("docProps/core.xml"):
        meta = ET.fromstring(core)
        title = next((t.text for t in _children(meta, "title") if t.text), "") or ""
        author = next((t.text for t in _children(meta, "creator") if t.text), "") or ""
    rels = {}
    if raw := files.get("word/_rels/document.xml.rels"):
        rels = {x.get("Id"): normal_path("word/document.xml", x.get("Target", "")) for x in ET.fromstring(raw) if x.get("TargetMode") != "External"}
    blocks: list[dict] = []

    def images(node: ET.Element) -> None:
        seen = []
        for e in node.iter():
            rid = e.get(R + "embed") or (e.get(R + "id") if local(e.tag) == "imagedata" else None)
            if rid and rid in rels and rid not in seen:
                seen.append(rid)
                blocks.append(block("image", image=rels[rid]))

    def paragraph(p: ET.Element) -> None:
        props = p.find(W + "pPr")
        runs = _docx_runs(p)
        level = _docx_heading(props)
        style = (props.find(W + "pStyle").get(W + "val") or "") if props is not None and props.find(W + "pStyle") is not None else ""
        listed = props is not None and (props.find(W + "numPr") is not None or "list" in style.lower())
        if any(b.get(W + "type") == "page" for b in p.iter(W + "br")):
            blocks.append(block("page_break"))
        if any(r["text"].strip() for r in runs):
            if level:
                blocks.append(block("heading", [r | {"bold": True} for r in runs], level=min(level, 6)))
            elif listed:
                ilvl = props.find(f"{W}numPr/{W}ilvl")
                depth = int(ilvl.get(W + "val") or 0) if ilvl is not None else 0
                blocks.append(block("list_item", runs, level=depth, ordered=False))
            else:
                blocks.append(block("paragraph", runs))
        images(p)

    def walk(node: ET.Element) -> None:
        for c in node:
            if c.tag == W + "p":
                paragraph(c)
            elif c.tag == W + "tbl":
                rows = [[[r for p in tc.iter(W + "p") for r in _docx_runs(p)] for tc in tr.findall(W + "tc")] for tr in c.findall(W + "tr")]
                width = max((len(r) for r in rows), default=0)
                rows = [r + [[]] * (width - len(r)) for r in rows]
                if rows:
                    blocks.append(block("table", headers=[[r | {"bold": True} for r in cell] for cell in rows[0]], rows=rows[1:]))
                images(c)
            elif c.tag == W + "sdt":
                inner = c.find(W + "sdtContent")
                if inner is not None:
                    walk(inner)

    walk(body)
    return {"title": title, "author": author, "blocks": numbered(blocks), "error": None, "toc": _outline(blocks)}


def _outline(blocks: list[dict]) -> list[dict]:
    heads = [(i, b) for i, b in enumerate(blocks) if b["kind"] == "heading"]
    return [{"toc_ord": k, "title": b["text"], "level": b["level"], "block_index": i} for k, (i, b) in enumerate(heads)]


def _failed(message: str) -> dict:
    blocks = numbered([block("paragraph", [run(message)])])
    return {"title": "", "author": "", "blocks": blocks, "toc": [], "error": message}


def palmdoc(data: bytes) -> bytes:
    """LZ77 of PalmDOC records: literals, counted literals, pairs with a blank, and back references."""
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        c = data[i]
        i += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < n:
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, size = pair >> 3, (pair & 7) + 3
            if 0 < back <= len(out):
                for _ in range(size):
                    out.append(out[-back])
    return bytes(out)


class Huff:
    """HUFF/CDIC: a prefix code whose symbols are phrases, themselves perhaps encoded."""

    def __init__(self, huff: bytes, cdics: list[bytes]):
        if huff[:4] != b"HUFF":
            raise ValueError("no HUFF record")
        fast_at, slow_at = struct.unpack(">LL", huff[8:16])
        self.fast = [(v & 0x1F, bool(v & 0x80), v >> 8) for v in struct.unpack(">256L", huff[fast_at : fast_at + 1024])]
        bounds = struct.unpack(">64L", huff[slow_at : slow_at + 256])
        self.low = [0, *bounds[::2]]
        self.high = [0, *bounds[1::2]]
        self.phrases: list[tuple[bytes, bool] | None] = []
        for c in cdics:
            if c[:4] != b"CDIC":
                raise ValueError("no CDIC record")
            total, bits = struct.unpack(">LL", c[8:16])
            count = min(1 << bits, total - len(self.phrases))
            for at in struct.unpack(f">{count}H", c[16 : 16 + 2 * count]):
                size = struct.unpack(">H", c[16 + at : 18 + at])[0]
                self.phrases.append((c[18 + at : 18 + at + (size & 0x7FFF)], bool(size & 0x8000)))

    def decode(self, data: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            return b""
        bits = len(data) * 8
        value = int.from_bytes(data + bytes(8), "big")
        total, at, out = bits + 64, 0, bytearray()
        while at < bits:
            word = value >> (total - at - 32) & 0xFFFFFFFF
            size, final, top = self.fast[word >> 24]
            if size == 0:
                break
            if final:
                top = ((top + 1) << (32 - size)) - 1
            else:
                while size < 32 and word < self.low[size] << (32 - size):
                    size += 1
                top = ((self.high[size] + 1) << (32 - size)) - 1
            at += size
            if at > bits:
                break
            index = (top - word) >> (32 - size)
            phrase, plain = self.phrases[index]
            if not plain:
                phrase = self.decode(phrase, depth + 1)
                self.phrases[index] = (phrase, True)
            out += phrase
        return bytes(out)


def _trailing(record: bytes, flags: int) -> bytes:
    """Record without the entries that its flags announce at its end."""
    size = len(record)
    for bit in range(1, 16):
        if flags >> bit & 1:
            value = shift = 0
            for k in range(1, 5):
                if size - k < 0:
                    break
                b = record[size - k]
                value |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            size = max(size - value, 0)
    if flags & 1 and size:
        size = max(size - (record[size - 1] & 3) - 1, 0)
    return record[:size]


def parse_mobi(data: bytes) -> dict:
    """``title, author, blocks, toc, error`` of a PalmDB book; encrypted ones are refused."""
    try:
        count = struct.unpack(">H", data[76:78])[0]
        offsets = [struct.unpack(">L", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(count)] + [len(data)]
        records = [data[a:b] for a, b in zip(offsets, offsets[1:])]
        head = records[0]
        compression, _, _, n_text, _, encryption = struct.unpack(">HHLHHH", head[:14] + b"\0\0")[:6] if len(head) < 16 else (
            *struct.unpack(">HH", head[:4]), *struct.unpack(">L", head[4:8]), *struct.unpack(">HHH", head[8:14]),
        )
        if encryption:
            return _failed("MOBI: the book is encrypted")
        charset, flags, title, author, boundary, start = 65001, 0, "", "", -1, 1
        if head[16:20] == b"MOBI":
            size, charset = struct.unpack(">L", head[20:24])[0], struct.unpack(">L", head[28:32])[0]
            if size >= 228 and len(head) >= 244:
                flags = struct.unpack(">H", head[242:244])[0]
            name_at, name_size = struct.unpack(">LL", head[84:92]) if len(head) >= 92 else (0, 0)
            title = head[name_at : name_at + name_size].decode("utf-8", "replace") if name_at else ""
            exth = head.find(b"EXTH", 16 + size)
            if len(head) >= 132 and struct.unpack(">L", head[128:132])[0] & 0x40 and exth >= 0:
                at, number = exth + 12, struct.unpack(">L", head[exth + 8 : exth + 12])[0]
                for _ in range(number):
                    kind, length = struct.unpack(">LL", head[at : at + 8])
                    value = head[at + 8 : at + length]
                    if kind == 100:
                        author = value.decode("utf-8", "replace")
                    elif kind == 503:
                        title = value.decode("utf-8", "replace").strip() or title
                    elif kind == 121 and len(value) == 4:
                        boundary = struct.unpack(">L", value)[0]
                    at += max(length, 8)
        title = title.strip() or data[:32].decode("latin-1").strip().strip("\0") or "MOBI 电子书"
        if 0 < boundary < count and len(newer := records[boundary]) >= 32:
            how, n_newer, secret = *struct.unpack(">H", newer[:2]), *struct.unpack(">H", newer[8:10]), *struct.unpack(">H", newer[12:14])
            if not secret and n_newer and how in (1, 2, 0x4448):  # the newer form of the book follows the older one
                compression, n_text, start, head = how, n_newer, boundary + 1, newer
                if newer[16:20] == b"MOBI" and struct.unpack(">L", newer[20:24])[0] >= 228 and len(newer) >= 244:
                    flags = struct.unpack(">H", newer[242:244])[0]
        parts = [_trailing(r, flags) for r in records[start : start + n_text]]
        if compression == 2:
            raw = b"".join(palmdoc(p) for p in parts)
        elif compression == 0x4448:
            first, number = struct.unpack(">LL", head[112:120])
            reader = Huff(records[first], records[first + 1 : first + number])
            raw = b"".join(reader.decode(p) for p in parts)
        else:
            raw = b"".join(parts)
        text = raw.decode("cp1252", "replace") if charset == 1252 else decode_file(raw, False)
    except Exception as e:
        return _failed(f"MOBI: {e}")
    if "<" not in text or ">" not in text:
        blocks = [block("paragraph", [run(x.strip())]) for x in re.split(r"[\r\n]+", text) if x.strip()]
        return {"title": title, "author": author, "blocks": numbered(blocks), "toc": [], "error": None}
    blocks = []
    for k, part in enumerate(re.split(r"<mbp:pagebreak[^>]*>(?:</mbp:pagebreak>)?", text, flags=re.I)):
        found = _shift_headings(container_blocks(parse(re.sub(r"<(img\b[^>]*?)\srecindex=[\"']?(\d+)", r'<\1 src="data:recindex,\2', part, flags=re.I))))
        if k and blocks and found:
            blocks.append(block("page_break"))
        blocks += found
    return {"title": title, "author": author, "blocks": numbered(blocks), "toc": _outline(blocks), "error": None}


def chapter_xhtml(title: str, body: str, indent: bool = True) -> str:
    css = "" if indent else '<style type="text/css">p { text-indent: 0 !important; }</style>\n'
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n'
        f"<head><title>{escape(title)}</title>\n{css}</head>\n<body>\n<h1>{escape(title)}</h1>\n{body}\n</body>\n</html>\n"
    )


def image_suffix(data: bytes) -> str:
    """Suffix under which an image is stored, jpg where its first bytes tell nothing."""
    head = bytes(data[:12])
    if head.startswith(b"\x89P") and len(data) > 8:
        return "png"
    if head.startswith(b"GI") and len(data) > 6:
        return "gif"
    if head[8:10] == b"WE" and len(data) > 12:
        return "webp"
    return "bmp" if head.startswith(b"BM") and len(data) > 2 else "jpg"


def build_epub(title: str, chapters: list[tuple[str, str]], author: str = "", language: str = "zh", modified: str = "2000-01-01T00:00:00Z", images: dict[str, bytes] | None = None, indent: bool = True) -> bytes:
    """An EPUB 3 package: the type first and stored, container, package, both outlines, chapters, images."""
    names = [f"chapter_{i:03d}" for i in range(1, len(chapters) + 1)]
    images = images or {}
    kinds = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    items += "".join(f'<item id="i{k}" href="images/{n}" media-type="{kinds.get(n.rpartition(".")[2], "image/jpeg")}"/>' for k, n in enumerate(images))
    spine = "".join(f'<itemref idref="{n}"/>' for n in names)
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:vellum:{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{language}</dc:language>'
        f'<meta property="dcterms:modified">{modified}</meta></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'
    )
    points = "".join(
        f'<navPoint id="p{i}" playOrder="{i}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}.xhtml"/></navPoint>' for i, ((t, _), n) in enumerate(zip(chapters, names), 1)
    )
    ncx = f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    links = "".join(f'<li><a href="{n}.xhtml">{escape(t)}</a></li>' for (t, _), n in zip(chapters, names))
    nav = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = how
            z.writestr(info, data)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", container)
        put("OEBPS/content.opf", opf)
        put("OEBPS/toc.ncx", ncx)
        put("OEBPS/nav.xhtml", nav)
        for (t, body), n in zip(chapters, names):
            put(f"OEBPS/{n}.xhtml", chapter_xhtml(t, body, indent))
        for n, data in images.items():
            put(f"OEBPS/images/{n}", data)
    return out.getvalue()
