"""Markdown to blocks: headings, paragraphs, lists, quotes, alerts, code, formulas, tables."""

from __future__ import annotations

import re

from ..functions.text import LOWERED, RAISED
from ..schemas import block, merged, numbered, run
from .latex import formula_runs, shifted

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(.*)$")
QUOTE = re.compile(r"^ {0,3}>\s?(.*)$")
ALERT = re.compile(r"^\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]\s*$", re.I)
TASK = re.compile(r"^\[([ xX])\]\s+(.*)$", re.S)
DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
FOOTNOTE = re.compile(r"^\[\^([^\]]+)\]:\s*(.*)$")
#: Labels of alerts, languages of fences that hold formulas.
ALERTS = {"note": "ℹ️ 说明：", "tip": "💡 提示：", "important": "📌 重要：", "warning": "⚠️ 警告：", "caution": "🚨 注意："}
MATH_LANGUAGES = frozenset({"math", "latex", "tex"})
CONTENTS_HEADING = re.compile(r"(?:目录|contents|table of contents)", re.I)

INLINE = re.compile(
    r"""(?P<escape>\\[\\`*_{}\[\]()#+\-.!|>~=$^])
    | (?P<code>(`+)(?P<code_text>.+?)(?<!`)\3(?!`))
    | (?P<display>\$\$(?P<display_text>.+?)\$\$)
    | (?P<math>\$(?P<math_text>(?=[^\s$])[^$\n]*?(?<=[^\s\\$]))\$(?!\d))
    | (?P<image>!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]+)(?:\s+"[^"]*")?\))
    | (?P<note>\[\^(?P<note_id>[^\]\s]+)\])
    | (?P<link>\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\]\((?P<href>[^)\s]+)(?:\s+"[^"]*")?\))
    | (?P<three>\*\*\*(?P<three_text>(?=\S).+?(?<=\S))\*\*\*)
    | (?P<two>\*\*(?P<two_text>(?=\S).+?(?<=\S))\*\*)
    | (?P<two_under>(?<!\w)__(?P<two_under_text>(?=\S).+?(?<=\S))__(?!\w))
    | (?P<one>\*(?P<one_text>(?=[^\s*])[^*]*?(?<=[^\s*]))\*)
    | (?P<one_under>(?<!\w)_(?P<one_under_text>(?=[^\s_])[^_]*?(?<=[^\s_]))_(?!\w))
    | (?P<strike>~~(?P<strike_text>(?=\S).+?(?<=\S))~~|<(?:del|s)>(?P<strike_html>.*?)</(?:del|s)>)
    | (?P<mark>==(?P<mark_text>(?=\S).+?(?<=\S))==|<mark>(?P<mark_html>.*?)</mark>)
    | (?P<sub>~(?P<sub_text>[^\s~]+)~|<sub>(?P<sub_html>.*?)</sub>)
    | (?P<sup>\^(?P<sup_text>[^\s^]+)\^|<sup>(?P<sup_html>.*?)</sup>)
    | (?P<kbd><kbd>(?P<kbd_text>.*?)</kbd>)
    | (?P<br><br\s*/?>)
    | (?P<tag></?[A-Za-z][^<>]*>)""",
    re.X | re.S,
)


def inline(text: str, bold: bool = False, italic: bool = False, strike: bool = False) -> list[dict]:
    """Runs of inline Markdown.  Strong marks pair by themselves, so they also work between CJK characters."""
    out, at = [], 0
    for m in INLINE.finditer(text):
        if m.start() > at:
            out.append(run(text[at : m.start()], bold, italic, strike))
        at = m.end()
        kind, g = m.lastgroup, m.groupdict()
        if g["escape"]:
            out.append(run(m[0][1:], bold, italic, strike))
        elif g["code"]:
            out.append(run(g["code_text"].strip() or g["code_text"], bold, italic, strike))
        elif g["display"] or g["math"]:
            out += [r | {"bold": r["bold"] or bold} for r in formula_runs(g["display_text"] or g["math_text"])]
        elif g["image"]:
            out.append(run(g["alt"], bold, italic, strike))
        elif g["note"]:
            out.append(run("[" + shifted(g["note_id"], RAISED, "^") + "]", bold, italic, strike))
        elif g["link"]:
            out += inline(g["label"], bold, italic, strike)
        elif g["three"]:
            out += inline(g["three_text"], True, True, strike)
        elif g["two"] or g["two_under"]:
            out += inline(g["two_text"] or g["two_under_text"], True, italic, strike)
        elif g["one"] or g["one_under"]:
            out += inline(g["one_text"] or g["one_under_text"], bold, True, strike)
        elif g["strike"]:
            out += inline(g["strike_text"] or g["strike_html"] or "", bold, italic, True)
        elif g["mark"]:
            out += inline(g["mark_text"] or g["mark_html"] or "", True, italic, strike)
        elif g["sub"]:
            out.append(run(shifted(g["sub_text"] or g["sub_html"] or "", LOWERED, "_"), bold, italic, strike))
        elif g["sup"]:
            out.append(run(shifted(g["sup_text"] or g["sup_html"] or "", RAISED, "^"), bold, italic, strike))
        elif g["kbd"]:
            out.append(run(f"[{g['kbd_text']}]", True, italic, strike))
        elif g["br"]:
            out.append(run("\n", bold, italic, strike))
        del kind
    if at < len(text):
        out.append(run(text[at:], bold, italic, strike))
    return merged(out)


def _joined(lines: list[str]) -> str:
    """Lines of a paragraph as one: a soft break is a blank only between ASCII characters."""
    text = lines[0].strip() if lines else ""
    for before, line in zip(lines, lines[1:]):
        line = line.strip()
        if before.endswith("  ") or before.endswith("\\"):
            text = text.rstrip("\\") + "\n" + line
        else:
            text += (" " if text[-1:].isascii() and line[:1].isascii() and text and line else "") + line
    return text


def pipe_cells(row: str) -> list[str]:
    row = re.sub(r"^\||(?<!\\)\|$", "", row.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


def _table(rows: list[str]) -> dict:
    head = pipe_cells(rows[0])
    width = len(head)
    body = [(pipe_cells(r) + [""] * width)[:width] for r in rows[2:]]
    return block("table", headers=[inline(c, bold=True) for c in head], rows=[[inline(c) for c in r] for r in body])


def _blocks(lines: list[str], depth: int = 0) -> list[dict]:
    out: list[dict] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            text = _joined(para)
            note = FOOTNOTE.match(text)
            out.append(block("paragraph", [run(f"[{note[1]}] "), *inline(note[2])] if note else inline(text)))
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if fence := FENCE.match(line):
            flush()
            end = i + 1
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[end]):
                end += 1
            body, language = "\n".join(lines[i + 1 : end]), fence[2].lower()
            if language in MATH_LANGUAGES:
                out.append(block("math", formula_runs(body), latex=body))
            else:
                out.append(block("code", language=language or None, text=body))
            i = end + 1
            continue
        if line.strip().startswith("$$"):
            first = line.strip()
            end = i
            if first.count("$$") < 2:
                end = i + 1
                while end < len(lines) and "$$" not in lines[end]:
                    end += 1
            body = "\n".join(lines[i : end + 1]).strip()
            closed = re.fullmatch(r"\$\$(.*?)\$\$", body, re.S)
            if closed or end >= len(lines):
                flush()
                body = closed[1] if closed else body[2:]
                out.append(block("math", formula_runs(body), latex=body.strip()))
                i = end + 1
                continue
        if "|" in line and i + 1 < len(lines) and DELIMITER.match(lines[i + 1]) and "|" in lines[i + 1]:
            flush()
            end = i + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            out.append(_table(lines[i:end]))
            i = end
            continue
        if not line.strip():
            flush()
        elif heading := HEADING.match(line):
            flush()
            out.append(block("heading", inline(heading[2] or "", bold=True), level=len(heading[1])))
        elif para and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            text = _joined(para)
            para.clear()
            out.append(block("heading", inline(text, bold=True), level=1 if "=" in line else 2))
        elif RULE.match(line):
            flush()
            out.append(block("hr"))
        elif QUOTE.match(line):
            flush()
            inner = []
            while i < len(lines) and (q := QUOTE.match(lines[i])):
                inner.append(q[1])
                i += 1
            out += _quote(inner, depth)
            continue
        elif ITEM.match(line) and (not para or not line.startswith("    ")):
            flush()
            i = _list(lines, i, out, depth)
            continue
        elif line.startswith("    ") and not para:
            end = i
            while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            out.append(block("code", text="\n".join(x[4:] for x in lines[i:end]).rstrip()))
            i = end
            continue
        else:
            para.append(line)
        i += 1
    flush()
    return out


def _quote(lines: list[str], depth: int) -> list[dict]:
    label = []
    if lines and (alert := ALERT.match(lines[0].strip())):
        label = [run(ALERTS[alert[1].lower()], bold=True)]
        lines = lines[1:]
    out = []
    for b in _blocks(lines, depth):
        runs = b["runs"] or []
        if b["kind"] == "list_item":
            runs = [run("• " if not b["ordered"] else f"{b['order_index']}. "), *runs]
        if b["kind"] in ("paragraph", "list_item", "heading", "quote"):
            out.append(block("quote", [*label, *runs]))
            label = []
        else:
            out.append(b)
    return out or ([block("quote", label)] if label else [])


def _list(lines: list[str], i: int, out: list[dict], depth: int) -> int:
    """One list from line ``i`` on; returns the first line after it."""
    base = len(ITEM.match(lines[i])[1].expandtabs(4))
    number = None
    while i < len(lines):
        m = ITEM.match(lines[i])
        if not m or RULE.match(lines[i]):
            break
        indent = len(m[1].expandtabs(4))
        if indent >= base + 2:
            i = _list(lines, i, out, depth + 1)
            continue
        if indent < base:
            break
        ordered = m[2][0].isdigit()
        number = (int(m[2][:-1]) if number is None else number + 1) if ordered else None
        text = [m[3]]
        i += 1
        while i < len(lines) and lines[i].strip() and not ITEM.match(lines[i]) and not FENCE.match(lines[i]) and not HEADING.match(lines[i]):
            text.append(lines[i])
            i += 1
        body = _joined(text)
        box = []
        if task := TASK.match(body):
            box, body = [run("☑ " if task[1] in "xX" else "☐ ")], task[2]
        out.append(block("list_item", [*box, *inline(body)], level=depth, ordered=ordered, order_index=number))
        if i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and ITEM.match(lines[i + 1]):
            i += 1
    return i


def parse(text: str | None) -> list[dict]:
    """Blocks of a Markdown text; null and empty texts have none."""
    if not text:
        return []
    return numbered(_blocks(text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")))


def outline(blocks: list[dict]) -> list[dict]:
    """Outline of the headings; those that a printed table of contents lists are left out, until a heading
    of its level or higher, or a rule, ends it."""
    out, within = [], None
    for b in blocks:
        if b["kind"] == "hr":
            within = None
        if b["kind"] != "heading":
            continue
        if within is not None and b["level"] <= within:
            within = None
        if within is None:
            out.append({"toc_ord": len(out), "title": b["text"], "level": b["level"], "block_index": b["block_index"]})
            if CONTENTS_HEADING.search(b["text"]):
                within = b["level"]
    return out
