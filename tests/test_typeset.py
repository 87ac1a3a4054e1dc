"""Pages of placed elements: tables in slices, cards, images, indents, keeping together."""

from __future__ import annotations

import random

import pytest

from vellum.kernels import typeset
from vellum.kernels.typeset import Sheet


def cell(text, bold=False):
    return [{"text": text, "bold": bold, "italic": False, "font_size": None, "color": None, "strikethrough": False}] if text else []


def table(headers, rows, index=0):
    return {"block_index": index, "kind": "table", "headers": [cell(h) for h in headers], "rows": [[cell(c) for c in r] for r in rows]}


def para(index, text, kind="paragraph", **more):
    return {"block_index": index, "kind": kind, "text": text, **more}


def laid(blocks, **sheet):
    return list(typeset.typeset(blocks, Sheet(**sheet)))


def shown(rows, block=None):
    return "".join(r["text"] for r in rows if r["kind"] == "text" and (block is None or r["block_index"] == block))


def inside(rows, sheet=Sheet()):
    return all(sheet.margin - 0.01 <= r["y"] and r["y"] + r["height"] <= sheet.height - sheet.margin + 2 for r in rows)


def test_grid_keeps_every_row_and_repeats_its_header():
    rows = laid([table(["项", "说明"], [[f"第{i}", f"内容{i}"] for i in range(60)])], tables="COMPACT_GRID")
    assert {r["page_index"] for r in rows} >= {0, 1, 2} and inside(rows)
    text = shown(rows)
    assert all(f"内容{i}" in text for i in range(60))
    for page in {r["page_index"] for r in rows} - {0}:
        first = next(r for r in rows if r["page_index"] == page and r["kind"] == "text")
        assert first["text"] == "项 (续)" and [s["text"] for s in first["segments"]][-1] == " (续)"
    assert "(续)" not in "".join(r["text"] for r in rows if r["page_index"] == 0)


def test_row_too_high_for_a_page_is_cut_between_lines():
    long = "".join(chr(0x4E00 + i) for i in range(1500))
    rows = laid([para(0, "前文"), table(["甲", "乙"], [["短", long], ["后", "末"]], 1)], tables="COMPACT_GRID")
    second = [r for r in rows if r["block_index"] == 1 and r["kind"] == "text"]
    body = "".join(r["text"] for r in second)
    assert all(c in body for c in long) and inside(rows) and len({r["page_index"] for r in second}) > 2


def test_table_without_rows_shows_its_header():
    rows = laid([table(["甲", "乙"], [])], tables="COMPACT_GRID")
    assert shown(rows) == "甲乙" and laid([table([], [])]) == []


def test_columns_fill_the_measure():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randrange(1, 7)
        natural = [rnd.uniform(20, 400) for _ in range(n)]
        widths = typeset.grid_columns(natural, min(20, 222 / n), 222.0)
        assert sum(widths) == pytest.approx(222.0) and all(w > 0 for w in widths)
    assert typeset.grid_columns([50.0, 50.0], 20.0, 200.0) == [100.0, 100.0]


def test_cards_hold_every_cell():
    rows = laid([table(["名称", "年份", "备注"], [["甲", "1999", ""], ["", "2000", "很长的说明"], ["名称很长的一项", "2001", "丙"]])])
    lines = [r["text"] for r in rows if r["kind"] == "text"]
    assert lines == ["▪ 名称：甲", "【年份】 1999", "▪ 名称：", "【年份】 2000", "【备注】 很长的说明", "▪ 名称很长的一项", "【年份】 2001", "【备注】 丙"]
    assert sum(r["kind"] == "rule" for r in rows) == 4
    assert all(s["bold"] for r in rows if r["text"].startswith("▪") for s in r["segments"])


def test_cards_without_a_first_header_are_numbered():
    rows = laid([table(["", "年份", "备注"], [["", "2000", "a"], ["甲", "", ""]])])
    assert [r["text"] for r in rows if r["kind"] == "text"] == ["▪ 第 1 项", "【年份】 2000", "【备注】 a", "▪ 甲"]


def test_images_fit():
    rows = laid([{"block_index": i, "kind": "image", "image": "u", "width_px": w, "height_px": h} for i, (w, h) in enumerate(((100, 50), (4000, 200), (10, 4000), (0, 0)))])
    p = Sheet()
    assert len(rows) == 4 and all(r["width"] <= p.inner + 1e-6 and r["height"] <= p.tall for r in rows)
    assert (rows[0]["width"], rows[0]["height"]) == (75.0, 37.5) and rows[0]["x"] == pytest.approx(18 + (222 - 75) / 2) and rows[1]["width"] == 222.0
    assert laid([{"block_index": 0, "kind": "image"}], images="HIDE_IMAGES") == []
    behind = laid([para(0, "文字"), {"block_index": 1, "kind": "image", "image": "u"}], images="BEHIND_TEXT")
    assert behind[0]["kind"] == "image" and (behind[0]["width"], behind[0]["height"], behind[0]["y"]) == (258.0, 346.0, 0.0)


def test_styles_and_indents():
    runs = [*cell("前"), *cell("粗体", True), *cell("abc")]
    rows = laid([para(0, None, runs=runs)])
    assert [(s["text"], s["bold"]) for s in rows[0]["segments"]] == [("前", False), ("粗体", True), ("abc", False)]
    xs = [s["x"] for s in rows[0]["segments"]]
    assert xs[0] == 18 + 16 and xs[1] == xs[0] + 12 and xs[2] == pytest.approx(xs[1] + 24 + 0.2 * 12)
    text = "文字" * 40
    item = laid([para(0, text, "list_item", level=1, ordered=False)])
    assert item[0]["segments"][0]["text"] == "◦ " and {r["segments"][0]["x"] for r in item[1:]} == {item[0]["segments"][1]["x"]}
    quote = laid([para(0, text, "quote")])
    bar = [r for r in quote if r["kind"] == "rule"]
    assert len(bar) == 1 and bar[0]["width"] == 0 and bar[0]["x"] < quote[0]["x"] and bar[0]["height"] > 3 * 18
    math = laid([para(0, "E=mc", "math")])
    assert math[0]["x"] == pytest.approx(18 + (222 - math[0]["width"]) / 2) and math[0]["height"] == 22.5
    assert laid([para(0, text, alignment="x")], alignment="CENTER")[0]["x"] == 18.0


def test_large_runs_need_more_room():
    big = [cell("大" * 30)[0] | {"font_size": 24.0}]
    rows = laid([para(0, None, runs=big)])
    assert all(r["width"] <= 222 + 24 for r in rows) and len(rows) > len(laid([para(0, "大" * 30)]))


def test_text_is_kept_and_stays_on_its_pages():
    rnd = random.Random(6)
    for _ in range(12):
        blocks = []
        for i in range(60):
            kind = rnd.choice(("paragraph", "heading", "list_item", "quote", "code", "math", "hr", "page_break"))
            text = "".join(rnd.choice("文字版面abc，。 ") for _ in range(rnd.randrange(1, 160))) if kind not in ("hr", "page_break") else None
            blocks.append(para(i, text, kind, level=rnd.randrange(0, 4), ordered=rnd.random() < 0.3, order_index=i))
        rows = laid(blocks)
        assert inside(rows)
        for b in blocks:
            if b["text"] and b["kind"] in ("paragraph", "heading", "quote", "math"):
                assert shown(rows, b["block_index"]).replace(" ", "") == b["text"].replace(" ", "")
        for a, b in zip(rows, rows[1:]):
            assert (a["page_index"], a["elem_ord"]) < (b["page_index"], b["elem_ord"])


def test_headings_stay_with_what_follows():
    for n in range(1, 17):
        rows = laid([para(i, "短") for i in range(n)] + [para(90, "标题", "heading", level=2), para(91, "正文。")])
        page = {b: max(r["page_index"] for r in rows if r["block_index"] == b) for b in (90, 91)}
        assert page[90] == page[91]


def test_code_is_framed_wrapped_and_kept_together():
    code = laid([para(0, "x = 1\n\tif y:", "code")])
    assert [r["text"] for r in code if r["kind"] == "text"] == ["x = 1", "    if y:"] and sum(r["kind"] == "rule" for r in code) == 4
    wide = "├── " + "name → " * 20
    wrapped = typeset.wrapped_code(wide.rstrip(), 40)
    assert all(typeset.columns_of(x) <= 40 for x in wrapped) and all(x.startswith("│") for x in wrapped[1:]) and wrapped[0].endswith("→")
    box = "┌──┐\n│ab│\n│cd│\n└──┘"
    assert not any(r["kind"] == "rule" for r in laid([para(0, box, "code")]))
    rows = laid([para(i, "字") for i in range(13)] + [para(50, "\n".join([box] * 9), "code")])
    pages = [r["page_index"] for r in rows if r["block_index"] == 50 and r["kind"] == "text"]
    assert all(len(set(pages[k : k + 4])) == 1 for k in range(0, 36, 4))
    assert laid([para(0, "", "code")])[0]["text"] == "" and laid([para(0, None)]) == []


def test_wide_diagrams_shrink_alike():
    wide = "┌" + "─" * 60 + "┐\n│ 甲" + " " * 57 + "│\n└" + "─" * 60 + "┘"
    top, middle, bottom = typeset.compacted(wide.split("\n"))
    assert typeset.columns_of(top) == typeset.columns_of(middle) == typeset.columns_of(bottom) < 12
    assert "甲" in middle and middle.endswith("│") and typeset.compacted(["┌──┐", "└──┘"]) == ["┌──┐", "└──┘"] and typeset.compacted([]) == []
    assert typeset.compacted(["no box " * 20]) == ["no box " * 20]
