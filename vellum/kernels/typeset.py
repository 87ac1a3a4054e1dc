"""Documents as pages of placed elements: styled text, lists, quotes, code, formulas, tables, images and rules.

A block becomes parts (text of several lines, a rule, an image, a grid, a page break); parts flow over pages.
Characters have the widths of :mod:`.layout`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from ..functions.text import LINE_END_FORBIDDEN, LINE_START_FORBIDDEN
from .layout import BULLETS, SCALES, Line, advance, break_lines, gap


@dataclass(frozen=True)
class Sheet:
    """Page geometry in points, and the rules of a document."""

    width: float = 258.0
    height: float = 346.0
    margin: float = 18.0
    font: float = 12.0
    line_height: float = 1.5
    gap: float = 3.6
    indent: float = 16.0
    inner_indent: float = 0.5
    heading_scale: float = 1.4
    bold_headings: bool = True
    alignment: str = "LEFT"
    orphans: bool = True
    widows: bool = True
    images: str = "TOP_AND_BOTTOM"
    tables: str = "SMART_CARD"

    @property
    def inner(self) -> float:
        return self.width - 2 * self.margin

    @property
    def tall(self) -> float:
        return self.height - 2 * self.margin

    @property
    def pitch(self) -> float:
        return self.font * self.line_height

    @property
    def ratio(self) -> float:
        return min(max(self.inner_indent, 0.1), 1.5)


@dataclass
class Segment:
    text: str
    x: float
    font_size: float
    bold: bool = False
    italic: bool = False
    strikethrough: bool = False


@dataclass
class Row:
    """A line: its segments from the left edge of the text, its width and what may hang over."""

    segments: list[Segment]
    width: float
    hang: float = 0.0

    @property
    def text(self) -> str:
        return "".join(s.text for s in self.segments)

    def moved(self, by: float) -> Row:
        return replace(self, segments=[replace(s, x=s.x + by) for s in self.segments])


@dataclass
class Text:
    rows: list[Row]
    pitch: float
    role: str = "text"
    size: float = 12.0


@dataclass
class Rule:
    pass


@dataclass
class Break:
    pass


@dataclass
class Image:
    width: float
    height: float
    address: str | None = None


@dataclass
class GridRow:
    cells: list[list[Row]]
    pitch: float
    pad: float

    @property
    def lines(self) -> int:
        return max((len(c) for c in self.cells), default=0)

    @property
    def height(self) -> float:
        return max(self.lines, 1) * self.pitch + 2 * self.pad

    def cut(self, at: int) -> tuple[GridRow, GridRow]:
        """The row's first ``at`` lines, and the rest."""
        return replace(self, cells=[c[:at] for c in self.cells]), replace(self, cells=[c[at:] for c in self.cells])


@dataclass
class Grid:
    columns: list[float]
    header: GridRow | None
    rows: list[GridRow]
    size: float
    pad_x: float = 0.0


def styled(runs: list[dict], size: float, **style) -> list[dict]:
    """Runs with a size, and with the given style on top of their own."""
    return [r | {"font_size": r.get("font_size") or size} | {k: v or bool(r.get(k)) for k, v in style.items()} for r in runs if r.get("text")]


def plain(text: str | None) -> list[dict]:
    return [{"text": text, "bold": False, "italic": False, "font_size": None, "color": None, "strikethrough": False}] if text else []


def rows_of(runs: list[dict], width: float, size: float, first: float = 0.0, left: float = 0.0) -> list[Row]:
    """Runs broken into rows of ``width`` points, indented by ``left``, the first one by ``first`` as well."""
    text = "".join(r["text"] for r in runs)
    if not text:
        return []
    style = [k for k, r in enumerate(runs) for _ in r["text"]]
    sizes = [float(r.get("font_size") or size) for r in runs]
    scale = None if all(s == size for s in sizes) else [sizes[k] / size for k in style]
    broken = break_lines(text, max(width - left, size) / size, first / size, scale)
    return [_row(x, runs, style, sizes, size, left + (first if k == 0 else 0.0)) for k, x in enumerate(broken)]


def _row(line: Line, runs: list[dict], style: list[int], sizes: list[float], size: float, x: float) -> Row:
    """A broken line as segments: a new one begins where the style changes and behind every blank left between scripts."""
    out: list[Segment] = []
    last, before = None, ""
    for k, c in enumerate(line.text):
        at = style[line.start + k]
        space = gap(before, c) * size if before else 0.0
        if at != last or space:
            r = runs[at]
            out.append(Segment("", x + space, sizes[at], bool(r.get("bold")), bool(r.get("italic")), bool(r.get("strikethrough"))))
            last = at
        out[-1].text += c
        x += space + advance(c) * sizes[at]
        before = c
    return Row(out, line.width * size, line.hang * size)


def heading_size(level: int | None, p: Sheet) -> float:
    return p.font * (1 + max(p.heading_scale - 1, 0.2) * SCALES[min(max(level or 1, 1), 6) - 1])


CODE_COLUMNS = (36, 52)
ARROWS = "→←↔⇒⇐▶►>"
TREE = "│├└─ \t"


def columns_of(text: str) -> int:
    return sum(2 if advance(c) > 0.5 else 1 for c in text)


def wrapped_code(line: str, target: int) -> list[str]:
    """A line of code or of a diagram cut to ``target`` columns: behind an arrow, else behind a blank, else
    where no mark is parted from its word; what follows keeps the line's tree signs."""
    out = []
    lead = line[: len(line) - len(line.lstrip(TREE))]
    prefix = "".join("│" if c in "│├" else " " for c in lead)
    if columns_of(prefix) * 2 > target:
        prefix = ""
    rest = line
    while columns_of(rest) > target:
        end, used = 0, 0
        while used + columns_of(rest[end]) <= target:
            used += columns_of(rest[end])
            end += 1
        least = max(len(prefix) if out else len(lead), target // 3)
        cut = next((k for k in range(end, least, -1) if rest[k - 1] in ARROWS), None) or next((k for k in range(end, least, -1) if rest[k - 1] == " "), None)
        if cut is None:
            cut = end
            while cut > least + 1 and (rest[cut] in LINE_START_FORBIDDEN or rest[cut - 1] in LINE_END_FORBIDDEN):
                cut -= 1
        out.append(rest[:cut].rstrip())
        rest = prefix + rest[cut:].lstrip()
    return [*out, rest]


DRAWN = frozenset("│┌┐└┘├┤┬┴┼─╭╮╰╯║═╔╗╚╝")
FILLERS = frozenset(" ─-")
WIDE_DIAGRAM = 45


def compacted(lines: list[str]) -> list[str]:
    """A wide diagram without the columns that only fill: one goes if in every drawn line it holds a filler, the
    same as in the column kept before it.  So all lines shrink alike and nothing is displaced."""
    drawn = [k for k, line in enumerate(lines) if DRAWN.intersection(line)]
    wide = max((columns_of(lines[k]) for k in drawn), default=0)
    if wide <= WIDE_DIAGRAM:
        return lines
    cells = []
    for k in drawn:
        row: list[str | None] = []
        for c in lines[k]:
            row += [c, None] if advance(c) > 0.5 else [c]
        cells.append(row + [" "] * (wide - len(row)))
    kept = [0]
    for c in range(1, wide):
        if not all(row[c] in FILLERS and row[c] == row[kept[-1]] for row in cells):
            kept.append(c)
    out = list(lines)
    for k, row in zip(drawn, cells):
        out[k] = "".join(row[c] or "" for c in kept).rstrip()
    return out


CODE_PAD = 3.0


def code_part(text: str, p: Sheet) -> Text:
    """Code on a grid of half-em columns, in a size at which its widest line fits."""
    inner = max(p.inner - 2 * CODE_PAD, 40.0)
    target = min(max(int(inner / (0.78 * p.font * 0.5)), CODE_COLUMNS[0]), CODE_COLUMNS[1])
    source = [line.replace("\t", "    ").rstrip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    lines = [x for line in compacted(source) for x in wrapped_code(line, target)]
    most = max(map(columns_of, lines), default=1)
    size = max(6.5, min(0.8 * p.font, inner / ((most + 1) / 2)))
    rows = [Row([Segment(line, CODE_PAD, size)] if line else [], CODE_PAD + columns_of(line) * size / 2) for line in lines]
    return Text(rows, size * 1.3, "code", size)


def image_part(b: dict, p: Sheet) -> list[Image]:
    """Three quarters of a point a pixel, no wider than the text and no higher than a page; images of unknown
    size are taken for 480 by 360."""
    if p.images == "HIDE_IMAGES":
        return []
    if p.images == "BEHIND_TEXT":
        return [Image(p.width, p.height, b.get("image"))]
    w, h = max(0.75 * (b.get("width_px") or 480), 1.0), max(0.75 * (b.get("height_px") or 360), 1.0)
    scale = min(1.0, p.inner / w)
    scale *= min(1.0, max(p.tall - p.gap, 2 * p.pitch) / (h * scale))
    return [Image(max(w * scale, 1.0), max(h * scale, 1.0), b.get("image"))]


def list_part(b: dict, runs: list[dict], p: Sheet) -> Text:
    """A list item: its mark at the left of its level, its lines beside it."""
    level = b.get("level") or 0
    mark = f"{b.get('order_index')}. " if b.get("ordered") else BULLETS[min(level, 2)] + " "
    step = p.font * 0.85 * p.ratio
    wide = sum(map(advance, mark)) * p.font
    left = min(level * step + max(wide, step, 0.35 * p.font), 0.4 * p.inner)
    sign = Segment(mark, level * step, p.font, bool(b.get("ordered")))
    rows = rows_of(runs, p.inner, p.font, left=left) or [Row([], left)]
    return Text([replace(rows[0], segments=[sign, *rows[0].segments]), *rows[1:]], p.pitch, "item", p.font)


def quote_indent(p: Sheet) -> tuple[float, float]:
    """Where the bar of a quote stands and where its text begins."""
    bar = max(0.45 * p.font * p.ratio, 2.0)
    return bar, bar + max(0.45 * p.font * p.ratio, 3.0)


def grid_columns(natural: list[float], least: float, inner: float) -> list[float]:
    """Widths of columns: in proportion where all fit; else those below the even share keep theirs and the others
    share what is left by a damped weight, all of them where the kept ones take three quarters."""
    n = len(natural)
    if sum(natural) <= inner:
        return [w * inner / max(sum(natural), 1.0) for w in natural]
    kept = [w <= 0.95 * inner / n for w in natural]
    fixed = sum(w for w, k in zip(natural, kept) if k)
    if all(kept) or fixed >= 0.75 * inner:
        kept, fixed = [False] * n, 0.0
    room = max(inner - fixed, kept.count(False) * least)
    weights = [0.0 if k else w**0.72 for w, k in zip(natural, kept)]
    wide = [w if k else max(room * x / max(sum(weights), 0.001), least) for w, k, x in zip(natural, kept, weights)]
    return [w * inner / max(sum(wide), 1.0) for w in wide]


def grid_part(headers: list, rows: list, p: Sheet) -> Grid | None:
    n = max([len(headers), *map(len, rows)], default=0)
    if not n:
        return None
    size = min(max(p.font * {1: 0.90, 2: 0.90, 3: 0.85, 4: 0.78}.get(n, 0.72), 6.2), p.font)
    pad_x, pad_y = max(0.28 * size, 2.2), max(0.25 * size, 2.0)
    least = min(2.2 * size + 2 * pad_x, p.inner / n)

    def wish(cell: list[dict], factor: float) -> float:
        lines = "".join(r["text"] or "" for r in cell).split("\n")
        return max(max(sum(map(advance, x)) for x in lines) * size * factor + 2 * pad_x, least)

    natural = [
        max([least, *([wish(headers[c], 1.08)] if c < len(headers) else []), *(wish(r[c], 1.0) for r in rows if c < len(r))]) for c in range(n)
    ]
    columns = grid_columns(natural, least, p.inner)

    def laid(cells: list, bold: bool) -> GridRow:
        runs = [styled([r | {"font_size": None} for r in cells[c]], size, bold=bold) if c < len(cells) else [] for c in range(n)]
        return GridRow([rows_of(x, max(w - 2 * pad_x, size), size) for x, w in zip(runs, columns)], 1.3 * size, pad_y)

    return Grid(columns, laid(headers, True) if headers else None, [laid(r, False) for r in rows], size, pad_x)


def text_of(cell: list[dict]) -> str:
    return "".join(r["text"] or "" for r in cell).strip()


def as_cards(headers: list, rows: list) -> bool:
    n = max([len(headers), *map(len, rows)], default=0)
    return n >= 3 or (n == 2 and any(len("".join(r["text"] or "" for r in c).encode("utf-16-le")) > 32 for row in rows for c in row))


def card_parts(headers: list, rows: list, p: Sheet) -> list:
    """A table as cards: a rule, a title made of the first cell, a line for each other filled cell."""
    n = max([len(headers), *map(len, rows)], default=0)
    names = [text_of(headers[c]) if c < len(headers) else "" for c in range(n)]
    if not n or not rows:
        return []
    size = 1.05 * p.font
    out: list = []
    for k, row in enumerate(rows):
        first = row[0] if row else []
        title = text_of(first)
        label = f"▪ {names[0]}：" if names[0] and len(title) <= 4 and names[0] not in title else "▪ "
        if not title and label == "▪ ":
            label += f"第 {k + 1} 项"
        out += [Rule(), Text(rows_of(styled(plain(label) + [r | {"font_size": None} for r in first], size, bold=True), p.inner, size), p.pitch, "heading", size)]
        for c in range(1 if title else 0, n):
            cell = row[c] if c < len(row) else []
            if text_of(cell):
                name = styled(plain(f"【{names[c]}】 " if names[c] else "• "), p.font, bold=True)
                out.append(Text(rows_of(name + styled([r | {"font_size": None} for r in cell], p.font), p.inner, p.font), p.pitch, "text", p.font))
    return [*out, Rule()]


def parts_of(b: dict, p: Sheet) -> list:
    """The parts of a block."""
    kind = b["kind"]
    runs = styled(b.get("runs") or plain(b.get("text")), p.font)
    if kind == "page_break":
        return [Break()]
    if kind == "hr":
        return [Rule()]
    if kind == "image":
        return image_part(b, p)
    if kind == "code":
        return [code_part(b.get("text") or "", p)]
    if kind == "table":
        headers, rows = b.get("headers") or [], b.get("rows") or []
        if p.tables == "SMART_CARD" and as_cards(headers, rows):
            return card_parts(headers, rows, p)
        grid = grid_part(headers, rows, p)
        return [grid] if grid else []
    if kind == "list_item":
        return [list_part(b, runs, p)]
    if kind == "heading":
        size = heading_size(b.get("level"), p)
        return [Text(rows_of(styled([r | {"font_size": None} for r in runs], size, bold=p.bold_headings), p.inner, size), max(p.pitch, 1.3 * size), "heading", size)]
    if kind == "math":
        size = 1.05 * p.font
        rows = rows_of(styled(b.get("runs") or plain(b.get("text")), size), p.inner, size)
        return [Text([r.moved(max((p.inner - r.width) / 2, 0.0)) for r in rows], 1.25 * p.pitch, "text", size)]
    if kind == "quote":
        return [Text(rows_of(runs, p.inner, p.font, left=quote_indent(p)[1]), p.pitch, "quote", p.font)]
    first = p.indent if p.alignment in ("LEFT", "JUSTIFY") else 0.0
    return [Text(rows_of(runs, p.inner, p.font, first), p.pitch, "text", p.font)]


BOX_SEARCH = 18


def _edge(text: str, left: str, right: str) -> bool:
    return len(text) >= 3 and text[0] in left and text[-1] in right


def box_height(rows: list[Row], at: int) -> int:
    """Lines of the closed box that begins at a line of a diagram, or right behind a connector; 0 where none does."""
    texts = [r.text.strip() for r in rows[at : at + BOX_SEARCH + 1]]
    head = 1 if texts[0] in ("│", "▼", "▲") and len(texts) > 1 else 0
    if not _edge(texts[head], "┌╭", "┐╮"):
        return 0
    return next((k + 1 for k in range(1, len(texts)) if _edge(texts[k], "└╰", "┘╯")), 0)


@dataclass
class Flow:
    """Parts flowing over pages."""

    p: Sheet
    pages: list[list[dict]] = field(default_factory=lambda: [[]])
    y: float = 0.0
    block: int = -1

    def __post_init__(self):
        self.y = self.p.margin
        self.bottom = self.p.margin + self.p.tall

    @property
    def here(self) -> list[dict]:
        return self.pages[-1]

    def turn(self) -> None:
        if self.here:
            self.pages.append([])
        self.y = self.p.margin

    def fits(self, height: float) -> bool:
        return self.y + height <= self.bottom

    def make_room(self, height: float) -> None:
        if self.here and not self.fits(height):
            self.turn()

    def put(self, kind: str, x: float, y: float, width: float, height: float, row: Row | None = None, size: float = 0.0, first: bool = False, image: str | None = None) -> None:
        left = self.p.margin
        element = {
            "block_index": self.block, "kind": kind, "x": round(x, 4), "y": round(y, 4), "width": round(width, 4), "height": round(height, 4), "font_size": round(size, 4),
            "hang": round(row.hang, 4) if row else 0.0, "text": row.text if row else (image or ""),
            "segments": [vars(s) | {"x": round(left + s.x, 4), "font_size": round(s.font_size, 4)} for s in row.segments] if row else [],
        }
        self.here.insert(0 if first else len(self.here), element)

    def rule(self, part: Rule) -> None:
        tall = 0.7 * self.p.pitch
        self.make_room(tall)
        self.put("rule", self.p.margin, self.y + tall / 2, self.p.inner, 0.0)
        self.y += tall + self.p.gap / 2

    def image(self, part: Image) -> None:
        if self.p.images == "BEHIND_TEXT":
            self.put("image", 0.0, 0.0, part.width, part.height, first=True, image=part.address)
            return
        self.make_room(part.height)
        scale = min(1.0, max(self.bottom - self.y, 1.0) / part.height)
        w, h = part.width * scale, part.height * scale
        self.put("image", self.p.margin + max((self.p.inner - w) / 2, 0.0), self.y, w, h, image=part.address)
        self.y += h + self.p.gap

    def text(self, part: Text) -> None:
        rows, pitch, n = part.rows, part.pitch, len(part.rows)
        if not n:
            return
        code, heading = part.role == "code", part.role == "heading"
        pad = 2.5 if code else 0.0
        if heading:
            self.make_room(n * pitch + self.p.pitch)
        if code:
            whole = n * pitch + 2 * pad
            self.make_room(whole if whole <= 0.75 * self.p.tall else pitch + 2 * pad)
        self.y += pad
        start, begun = self.y, 0

        def turn(k: int) -> None:
            nonlocal start, begun
            self.decorate(part, rows[begun:k], start)
            self.turn()
            self.y += pad
            start, begun = self.y, k

        for k, row in enumerate(rows):
            lone = not heading and not code and ((k == 0 and n > 1 and self.p.orphans) or (k == n - 2 and n >= 3 and self.p.widows))
            box = box_height(rows, k) if code and self.here and self.y > self.p.margin + pad + 2 * pitch else 0
            if (
                (lone and not self.fits(2 * pitch) and self.y > self.p.margin + 1)
                or (box and not self.fits(box * pitch) and box * pitch <= self.p.tall - 2 * pad)
                or (self.here and not self.fits(pitch))
            ):
                turn(k)
            self.put("text", self.p.margin + (row.segments[0].x if row.segments else 0.0), self.y, row.width, pitch, row, row.segments[0].font_size if row.segments else part.size)
            self.y += pitch
        self.decorate(part, rows[begun:], start)
        self.y += pad
        if not heading:
            self.y += self.p.gap

    def decorate(self, part: Text, rows: list[Row], top: float) -> None:
        """The bar beside a quote or the frame around code that has none of its own, on one page."""
        if not rows:
            return
        end = top + len(rows) * part.pitch
        if part.role == "quote":
            lead = max((part.pitch - part.size) / 2, 0.0)
            self.put("rule", self.p.margin + quote_indent(self.p)[0], top + lead, 0.0, max(end - part.pitch + lead + part.size - top - lead, 0.8 * self.p.font))
        elif part.role == "code" and not any(c in "┌─┐│└┘├┤┬┴┼" for r in part.rows for c in r.text):
            high, low, left = max(top - 2.0, self.p.margin), end + 1.5, self.p.margin
            for x, y, w, h in ((left, high, self.p.inner, 0.0), (left, low, self.p.inner, 0.0), (left, high, 0.0, low - high), (left + self.p.inner, high, 0.0, low - high)):
                self.put("rule", x, y, w, h)

    def grid(self, part: Grid) -> None:
        """A table in slices: its header comes again on every page, a row too high for a page is cut between lines."""
        left = deque(part.rows)
        head = part.header
        self.make_room((head.height if head else 0.0) + (left[0].height if left else 0.0))
        if not left and head:
            self.slice(part, [head], True)
        while left:
            taken: list[GridRow] = []
            used = head.height if head else 0.0
            while left and self.y + used + left[0].height <= self.bottom + 0.1:
                used += left[0].height
                taken.append(left.popleft())
            if not taken and self.here:
                self.turn()
                continue
            if not taken:
                row = left.popleft()
                room = max(int((self.bottom - self.y - used - 2 * row.pad) / row.pitch), 1)
                kept, rest = row.cut(room) if room < row.lines else (row, None)
                taken.append(kept)
                if rest:
                    left.appendleft(rest)
            self.slice(part, [*([head] if head else []), *taken], head is not None)
            if left:
                self.turn()
                head = continued(part.header, part.size)
        self.y += self.p.gap

    def slice(self, part: Grid, rows: list[GridRow], headed: bool) -> None:
        top, edges = self.y, [self.p.margin]
        for w in part.columns:
            edges.append(edges[-1] + w)
        wide = edges[-1] - edges[0]
        self.put("rule", edges[0], top, wide, 0.0)
        for row in rows:
            for x, cell in zip(edges, row.cells):
                for k, line in enumerate(cell):
                    if line.segments:
                        moved = line.moved(x - self.p.margin + part.pad_x)
                        self.put("text", x + part.pad_x, self.y + row.pad + k * row.pitch, line.width, row.pitch, moved, part.size)
            self.y += row.height
            self.put("rule", edges[0], self.y, wide, 0.0)
        for x in edges:
            self.put("rule", x, top, 0.0, max(self.y - top, 1.0))

    def place(self, part) -> None:
        if isinstance(part, Break):
            if self.here:
                self.turn()
        else:
            {Rule: self.rule, Image: self.image, Text: self.text, Grid: self.grid}[type(part)](part)


def continued(header: GridRow | None, size: float) -> GridRow | None:
    """A header that says that its table began on an earlier page."""
    if header is None or not header.cells or not header.cells[0]:
        return header
    *above, last = header.cells[0]
    sign = Segment(" (续)", last.width, 0.9 * size, True)
    return replace(header, cells=[[*above, replace(last, segments=[*last.segments, sign], width=last.width + 2 * size)], *header.cells[1:]])


def typeset(blocks: list[dict], p: Sheet = Sheet()) -> Iterator[dict]:
    """Rows ``page_index, elem_ord, block_index, kind, x, y, width, height, font_size, hang, text, segments`` of a
    document; for images ``text`` is their address."""
    flow = Flow(p)
    for b in blocks:
        flow.block = b["block_index"]
        for part in parts_of(b, p):
            flow.place(part)
    for number, page in enumerate(x for x in flow.pages if x):
        for order, element in enumerate(page):
            yield {"page_index": number, "elem_ord": order, **element}
