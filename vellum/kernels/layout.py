"""Blocks to lines and pages without font metrics: CJK characters are one em wide, others half."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.text import CJK, HAN, LATIN, LATIN_WORD, LINE_END_FORBIDDEN, LINE_START_FORBIDDEN, RIGHT_BLANK


def _class(spec: str) -> re.Pattern:
    return re.compile(f"[{spec}]")


IS_CJK, IS_HAN, IS_LATIN, IS_WORD = _class(CJK), _class(HAN), _class(LATIN), _class(LATIN_WORD)
NO_START, NO_END, BLANK_RIGHT = frozenset(LINE_START_FORBIDDEN), frozenset(LINE_END_FORBIDDEN), frozenset(RIGHT_BLANK)
GAP, HANG, PUSH_OUT = 0.20, 1.05, 4


@dataclass(frozen=True)
class Params:
    """Page geometry in points."""

    width: float = 255.0
    height: float = 340.0
    font_size: float = 12.0
    line_height: float = 1.5
    indent: float = 2.0
    paragraph_gap: float = 0.3
    heading_base: float = 1.4


def advance(c: str) -> float:
    """Width of a character in em."""
    return 1.0 if IS_CJK.match(c) else 0.5


def gap(before: str, c: str) -> float:
    """Blank between Han and Latin characters that stand side by side."""
    mixed = (IS_HAN.match(before) and IS_LATIN.match(c)) or (IS_LATIN.match(before) and IS_HAN.match(c)) if before else None
    return GAP if mixed else 0.0


@dataclass
class Line:
    text: str
    width: float
    hang: float = 0.0
    hard: bool = False
    start: int = 0


def break_lines(text: str, width: float, indent: float = 0.0, scale: list[float] | None = None) -> list[Line]:
    """Lines of a text in a measure of ``width`` em; the first is shorter by ``indent``.  ``scale`` gives the
    size of each character relative to the measure's em.

    A mark that must not begin a line hangs beyond the measure, up to 1.05 em in all, or takes up to four
    characters with it to the next line; a mark that must not end a line goes to the next one; a Latin word
    is not broken unless it fills a line alone; newlines always break.
    """
    out: list[Line] = []
    base = -1
    for k, part in enumerate(text.split("\n")):
        base += 1 if k == 0 else size + 1
        size = len(part)
        first = indent if k == 0 else 0.0
        i, n = 0, len(part)
        if not n:
            out.append(Line("", 0.0, hard=True, start=base))
            continue
        sizes = scale[base : base + n] if scale else None
        while i < n:
            room = width - (first if i == 0 else 0.0)
            used, j = 0.0, i
            while j < n:
                w = advance(part[j]) * (sizes[j] if sizes else 1.0) + (gap(part[j - 1], part[j]) if j > i else 0.0)
                if used + w > room + 1e-9 and j > i:
                    break
                used += w
                j += 1
            if j < n:
                j = _break_at(part, i, j, used, room)
            shown = part[i:j].rstrip(" ") if j < n else part[i:j]
            w = sum(advance(c) * (sizes[i + m] if sizes else 1.0) for m, c in enumerate(shown)) + sum(gap(a, b) for a, b in zip(shown, shown[1:]))
            last = shown[-1:]
            hang = 0.75 * advance(last) if last in BLANK_RIGHT else 0.5 * advance(last) if last in NO_START and last else 0.0
            out.append(Line(shown, w, hang, j >= n, base + i))
            i = j
            while i < n and part[i] == " ":
                i += 1
    return out


def _break_at(part: str, i: int, j: int, used: float, room: float) -> int:
    """Where a line that is full before ``j`` really ends."""
    end = j
    over = used
    while end < len(part) and part[end] in NO_START and over + advance(part[end]) <= room + HANG + 1e-9:
        over += advance(part[end])
        end += 1
    if end > j and (end >= len(part) or part[end] not in NO_START):
        return end
    end = j
    if part[end] in NO_START:
        back = end
        while back > i + 1 and end - back < PUSH_OUT and (part[back] in NO_START or part[back - 1] in NO_END):
            back -= 1
        if part[back] not in NO_START and back > i:
            return back
        return end
    if IS_WORD.match(part[end]) and IS_WORD.match(part[end - 1]):
        back = end
        while back > i and IS_WORD.match(part[back - 1]):
            back -= 1
        if back > i:
            end = back
    while end > i + 1 and part[end - 1] in NO_END:
        end -= 1
    return end


SCALES = (1.0, 0.72, 0.48, 0.28, 0.14, 0.06)
BULLETS = "•◦▪"


def block_lines(b: dict, p: Params) -> tuple[list[Line], float, dict]:
    """Lines of a block, its font size and its place among its neighbours."""
    kind, text, level = b["kind"], b["text"] or "", b["level"] or 1
    size, indent, role = p.font_size, 0.0, {}
    if kind == "heading":
        size = p.font_size * (1 + max(p.heading_base - 1, 0.2) * SCALES[min(max(level, 1), 6) - 1])
        role = {"keep": True}
    elif kind == "paragraph":
        indent = p.indent
    elif kind == "list_item":
        mark = f"{b['order_index']}. " if b.get("ordered") and b.get("order_index") is not None else BULLETS[min(b["level"] or 0, 2)] + " "
        text = mark + text
    elif kind == "code":
        size = p.font_size * 0.8
    elif kind == "math":
        size = p.font_size * 1.05
    return break_lines(text, p.width / size, indent), size, role


def paginate(blocks: list[dict], p: Params = Params()) -> Iterator[dict]:
    """Rows ``page_index, elem_ord, block_index, y, font_size, width, hang, text`` of a document's lines.

    A page break begins a page; a heading stays with two lines of what follows; the first or last line of a
    paragraph does not stand alone on a page.
    """
    page, y, order = 0, 0.0, 0
    laid = [(b, *block_lines(b, p)) for b in blocks]
    for k, (b, lines, size, role) in enumerate(laid):
        pitch = size * p.line_height
        if b["kind"] == "page_break":
            if y > 0:
                page, y, order = page + 1, 0.0, 0
            continue
        if b["kind"] in ("hr", "image"):
            if y + pitch > p.height:
                page, y, order = page + 1, 0.0, 0
            yield _row(page, order, b, y, size, 0.0, 0.0, "")
            y, order = y + pitch, order + 1
            continue
        need = pitch * min(2, len(lines))
        if role.get("keep"):
            after = laid[k + 1] if k + 1 < len(laid) else None
            need = pitch * len(lines) + (after[2] * p.line_height * min(2, len(after[1])) if after and after[0]["kind"] != "page_break" else 0.0)
        if y > 0 and y + need > p.height + 1e-6 and need <= p.height:
            page, y, order = page + 1, 0.0, 0
        for i, line in enumerate(lines):
            left = len(lines) - i
            if y > 0 and (y + pitch > p.height + 1e-6 or (left == 2 and y + 2 * pitch > p.height + 1e-6 and len(lines) > 2)):
                page, y, order = page + 1, 0.0, 0
            yield _row(page, order, b, y, size, line.width * size, line.hang * size, line.text)
            y, order = y + pitch, order + 1
        y += p.font_size * p.paragraph_gap if b["kind"] in ("paragraph", "heading", "quote") else 0.0


def _row(page: int, order: int, b: dict, y: float, size: float, width: float, hang: float, text: str) -> dict:
    return {"page_index": page, "elem_ord": order, "block_index": b["block_index"], "y": round(y, 4), "font_size": round(size, 4),
            "width": round(width, 4), "hang": round(hang, 4), "text": text}
