"""Kernels: formulas, Markdown, page trees, archives, layout, streaming."""

from __future__ import annotations

import io
import struct
import zipfile

from vellum import plans
from vellum.functions.text import LINE_START_FORBIDDEN
from vellum.kernels import archives, articles, layout, markdown, xhtml
from vellum.kernels.latex import formula_runs


def text_of(runs):
    return "".join(r["text"] for r in runs)


def test_formulas():
    runs = formula_runs("E = mc^2")
    assert text_of(runs) == "E = mc²" and any(r["text"] == "E" and r["italic"] for r in runs)
    quadratic = text_of(formula_runs(r"\frac{-b \pm \sqrt{b^2 - 4ac}}{2a}"))
    assert "±" in quadratic and "√(b² - 4ac)" in quadratic and "/ 2a" in quadratic
    integral = text_of(formula_runs(r"$$\int_0^\infty e^{-x} dx = \alpha + \beta$$"))
    assert "∫(0..∞)" in integral and "e⁻ˣ" in integral and "α + β" in integral
    assert text_of(formula_runs(r"\frac{1}{2} \mathbb{R} \sqrt[3]{x} \tag{7}")) == "½ ℝ ∛(x)    (7)"
    assert formula_runs(None) == [] and formula_runs("$$ $$") == [] and text_of(formula_runs(r"\frac{a")) != ""


def test_markdown():
    kinds = lambda s: [(b["kind"], b["text"]) for b in markdown.parse(s)]
    assert kinds("商品标价为 $10，运费为 $5，总计 $15。") == [("paragraph", "商品标价为 $10，运费为 $5，总计 $15。")]
    assert [t for _, t in kinds("- [ ] 甲\n- [x] 乙\n- [X] 丙")] == ["☐ 甲", "☑ 乙", "☑ 丙"]
    assert kinds("H~2~O 与 mc^2^ [^1]") == [("paragraph", "H₂O 与 mc² [¹]")]
    assert [t for _, t in kinds("> [!TIP]\n> 好\n\n> [!WARNING]\n> 小心")] == ["💡 提示：好", "⚠️ 警告：小心"]
    struck = markdown.parse("~~旧~~ <del>删</del> ==亮== <mark>标</mark>")[0]["runs"]
    assert [r["text"] for r in struck if r["strikethrough"]] == ["旧", "删"] and [r["text"] for r in struck if r["bold"]] == ["亮", "标"]
    table = markdown.parse("| 甲 | 乙 |\n|---|:-:|\n| 1 | 2 | 3 |\n| a \\| b |")[0]
    assert table["kind"] == "table" and [text_of(c) for c in table["rows"][1]] == ["a | b", ""]
    assert kinds("```math\n\\sum x\n```") == [("math", "∑ x")] and kinds("```py\na|b\n---\n```")[0] == ("code", "a|b\n---")
    assert markdown.parse(None) == [] and markdown.parse("") == []


def test_markdown_outline_leaves_listed_titles_out():
    text = "# 指南\n## 全书完整目录（导图）\n### 第一篇 列\n- a\n### 第二篇 列\n---\n## 第一篇 正\n### 第 1 章\n"
    blocks = markdown.parse(text)
    assert [e["title"] for e in markdown.outline(blocks)] == ["指南", "全书完整目录（导图）", "第一篇 正", "第 1 章"]
    assert all(blocks[e["block_index"]]["text"] == e["title"] for e in markdown.outline(blocks))


def test_article_tree():
    page = (
        "<div>甲<p>乙 <b>粗</b></p><h2>节</h2><pre><code>x = 1\n</code></pre><table><tr><th>a</th></tr><tr><td>1</td><td>2</td></tr></table>"
        "<div><figure><img data-actualsrc='//x.y/1.jpg'></figure></div><ol><li>一<ul><li>二</li></ul></li></ol><p>丙<img data-src='https://x.y/2.png'></div>"
    )
    got = list(articles.article_blocks(7, "题", page))
    assert [b["kind"] for b in got] == ["heading", "paragraph", "paragraph", "heading", "code", "table", "image", "list_item", "list_item", "paragraph", "image"]
    assert got[3]["level"] == 3 and got[6]["image"] == "https://x.y/1.jpg" and got[7]["order_index"] == 1
    assert list(articles.article_blocks(1, None, None)) == []


def test_extraction():
    page = "<html><head><title>T</title></head><nav>a b c</nav><div class='app-guide-mask'>open</div><article><h1>标题</h1><p>" + "正文，很长。" * 20 + "</p></article><footer>f</footer>"
    title, blocks, truncated, error = articles.main_content(page)
    assert title == "标题" and error is None and not truncated and any("正文" in (b["text"] or "") for b in blocks)
    assert not any("open" in (b["text"] or "") for b in blocks)
    assert articles.main_content("<p>短</p>")[3] == "text too short" and articles.main_content("")[3] == "no text"


def test_epub_round_trip():
    data = archives.build_epub("书", [("甲 & 乙", "<p>正文<i>斜</i></p><h2>小节</h2>"), ("丙", "<p>x</p>")], author="作者", images={"1.png": b"p"})
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert names[0] == "mimetype" and "OEBPS/chapter_002.xhtml" in names and "OEBPS/images/1.png" in names
    book = archives.parse_epub(data)
    assert (book["title"], book["author"], book["error"]) == ("书", "作者", None)
    assert [b["kind"] for b in book["blocks"]] == ["heading", "paragraph", "heading", "page_break", "heading", "paragraph"]
    assert [(t["title"], t["block_index"]) for t in book["toc"]] == [("甲 & 乙", 0), ("丙", 4)]
    assert archives.parse_epub(b"junk")["error"] and archives.parse_epub(b"")["blocks"][0]["kind"] == "paragraph"
    assert archives.normal_path("OEBPS/a/b.opf", "../x%20y.html#z") == "OEBPS/x y.html"


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        "<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>节</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b w:val='0'/><w:i/></w:rPr><w:t>斜</w:t></w:r></w:p>"
        "<w:sdt><w:sdtContent><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>项</w:t></w:r></w:p></w:sdtContent></w:sdt>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    doc = archives.parse_docx(out.getvalue())
    assert [(b["kind"], b["level"]) for b in doc["blocks"]] == [("heading", 2), ("paragraph", None), ("list_item", 0), ("table", None)]
    assert doc["blocks"][1]["runs"][0]["italic"] and not doc["blocks"][1]["runs"][0]["bold"] and len(doc["blocks"][3]["headers"]) == 2
    assert archives.parse_docx(b"x")["error"]


def mobi(text: bytes, compression=1, encryption=0):
    head = bytearray(struct.pack(">HHLHHHH", compression, 0, len(text), 1, 4096, encryption, 0))
    exth_items = struct.pack(">LL", 100, 8 + 6) + "作者".encode() + struct.pack(">LL", 503, 8 + 3) + "书".encode()
    exth = b"EXTH" + struct.pack(">LL", 12 + len(exth_items), 2) + exth_items
    mobi_head = bytearray(232)
    mobi_head[0:4] = b"MOBI"
    mobi_head[4:8] = struct.pack(">L", 232)
    mobi_head[12:16] = struct.pack(">L", 65001)
    mobi_head[112:116] = struct.pack(">L", 0x40)
    record0 = bytes(head) + bytes(mobi_head) + exth
    records = [record0, text, b"\xe9\x8e\r\n"]
    base = 78 + 8 * len(records)
    out = bytes(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records))
    for i in range(len(records)):
        out += struct.pack(">LL", base + sum(map(len, records[:i])), i)
    return out + b"".join(records)


def test_mobi():
    book = archives.parse_mobi(mobi("<h1>甲</h1><p>文<b>粗</b></p><mbp:pagebreak/><h2>乙</h2>".encode()))
    assert (book["title"], book["author"]) == ("书", "作者")
    assert [b["kind"] for b in book["blocks"]] == ["heading", "paragraph", "page_break", "heading"] and [t["level"] for t in book["toc"]] == [1, 2]
    assert archives.parse_mobi(mobi(b"x", encryption=2))["error"] and archives.parse_mobi(b"")["error"]
    assert archives.palmdoc(bytes.fromhex("48656c6c6fc1")) == b"Hello A" and archives.palmdoc(b"ABC\x80\x1b") == b"ABCABCABC"
    assert archives.parse_mobi(mobi(b"plain\ntext"))["blocks"][1]["text"] == "text"


def test_lines():
    text = "这是一个很长的段落，用来检验断行。" * 6 + "supercalifragilistic word" * 3
    found = layout.break_lines(text, 12.0, 2.0)
    assert "".join(x.text for x in found).replace(" ", "") == text.replace(" ", "")
    assert all(x.text[0] not in LINE_START_FORBIDDEN for x in found)
    assert all(x.width <= 12.0 + 1.05 + 1e-6 for x in found)
    assert [x.text for x in layout.break_lines("a\n\nb", 10)] == ["a", "", "b"]


def test_pages_keep_everything():
    blocks = [{"block_index": i, "kind": "heading" if i % 9 == 0 else "paragraph", "level": 1, "ordered": None, "order_index": None, "text": f"第{i}段" + "文字" * 40} for i in range(40)]
    rows = list(layout.paginate(blocks))
    assert {r["block_index"] for r in rows} == set(range(40))
    assert all(r["y"] < layout.Params().height for r in rows)
    for i in range(0, 40, 9):
        heading = max(r["page_index"] for r in rows if r["block_index"] == i)
        assert any(r["page_index"] == heading and r["block_index"] == i + 1 for r in rows)


def test_plans_take_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "t", "")], "article_id long, title string, content_html string")
    assert plans.article_blocks(pages).count() == 1
    assert plans.extracted(pages).where("error is not null").count() == 2
    texts = spark.createDataFrame([(1, None), (2, "# a")], "doc_id long, text string")
    assert plans.markdown_blocks(texts).count() == 1 and plans.markdown_outline(texts).count() == 1


def test_stream(spark, tmp_path):
    from vellum.streaming import inbox

    data = spark.createDataFrame([(1, "https://a.b/p?utm_id=1", "<p>x</p>"), (2, "http://A.b/p#y", "<p>y</p>")], "article_id long, url string, content_html string").selectExpr("*", "timestamp'2025-01-01' as clipped_at")
    data.write.parquet(str(tmp_path / "in"))
    stream = inbox.first_clips(inbox.clips(spark, str(tmp_path / "in"), data.schema))
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 1
    q = inbox.to_blocks(inbox.clips(spark, str(tmp_path / "in"), data.schema), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_safe_bodies():
    html = '<div onclick="x()"><script>bad()</script><custom>a &amp; b&nbsp;<b class="q">c</b></custom><a href="/p?x=1&amp;y=2">l</a><a href="javascript:x">m</a><img data-src="//cdn.x/1.png" src="data:image/svg+xml,x" alt="q&quot;" width="3"><br><figure><img src="r.png"></figure><!-- gone --></div>'
    body, images = xhtml.safe_body(html, "https://h.example/a/b")
    assert body == (
        '<div>a &amp; b&#160;<b>c</b><a href="https://h.example/p?x=1&amp;y=2">l</a><a>m</a><img src="https://cdn.x/1.png" alt="q&quot;"/><br/>'
        '<figure><img src="https://h.example/a/r.png"/></figure></div>'
    )
    assert images == ["https://cdn.x/1.png", "https://h.example/a/r.png"]
    assert "img" not in xhtml.safe_body(html, None, images=False)[0] and xhtml.safe_body(None, None) == ("", [])
    deep = "<div><p>" * 5000 + "x" + "</p></div>" * 5000
    assert "x" in xhtml.safe_body(deep, None)[0]
    from xml.dom import minidom

    minidom.parseString(f"<r>{body}</r>")


def test_books_hold_their_images(spark):
    import io
    import zipfile

    pages = [(1, "https://h.example/1", "T", '<p><b>x</b> <i>y</i></p><ul><li>z</li></ul><img src="https://c/1.png"><img src="https://c/2.png"><img src="https://c/1.png">'), (2, None, None, None)]
    df = spark.createDataFrame(pages, "article_id long, url string, title string, content_html string")
    images = spark.createDataFrame([("https://c/1.png", b"\x89PNG\r\n\x1a\n" + b"0" * 9), ("https://c/1.png", b"\x89PNG\r\n\x1a\n" + b"0" * 9), ("https://other", b"x")], "url string, content binary")
    books = {r["article_id"]: bytes(r["epub"]) for r in plans.epub_packages(df, images).collect()}
    with zipfile.ZipFile(io.BytesIO(books[1])) as z:
        chapter = z.read("OEBPS/chapter_001.xhtml").decode()
        assert z.namelist()[0] == "mimetype" and z.read("OEBPS/images/img_001.png").startswith(b"\x89PNG")
        assert chapter.count('"../images/img_001.png"') == 2 and '"https://c/2.png"' in chapter and "<ul><li>z</li></ul>" in chapter and "<b>x</b>" in chapter
        assert "images/img_001.png" in z.read("OEBPS/content.opf").decode()
    plain = {r["article_id"]: bytes(r["epub"]) for r in plans.epub_packages(df).collect()}
    with zipfile.ZipFile(io.BytesIO(plain[1])) as z:
        assert "<img" not in z.read("OEBPS/chapter_001.xhtml").decode()
    assert set(plain) == {1, 2}


def test_hidden_parts_and_late_images():
    from vellum.kernels.tree import parse

    long = "folded text " * 30
    root = articles.cleaned_page(parse(f'<div style="display: none">{long}</div><div hidden>advert</div><p class="related">r</p><p id="related">kept</p><noscript><img src="//c/n.png"></noscript><img data-src="//c/1.png" src="x">'))
    text = articles.without_hidden(root).text()
    assert "folded" in text and "advert" not in text and "kept" in text and ">r<" not in text
    assert [e.attrs["src"] for e in root.walk() if e.tag == "img"] == ["https://c/n.png", "https://c/1.png"]


def epub(chapters, ncx):
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _) in enumerate(chapters))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        z.writestr("OPS/b.opf", f'<package><manifest><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{spine}</spine></package>')
        z.writestr("OPS/t.ncx", "<ncx><navMap>" + "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{s}"/></navPoint>' for t, s in ncx) + "</navMap></ncx>")
        for n, body in chapters:
            z.writestr(f"OPS/{n}", f"<html><body>{body}</body></html>")
    return out.getvalue()


def test_epub_anchors_are_exact():
    one = '<p>same</p><p id="b">same</p><a id="c"/><p>next <b id="d">x</b></p><ul id="e"><li>i</li><li><p id="f">k</p></li></ul><table id="g"><tr><td>v</td></tr></table><pre id="h">code</pre><p id="b">again</p><div id="z"/>'
    two = '<p id="B">other</p><img id="i" src="x.png"/><p>end</p>'
    toc = [("b", "one.xhtml#b"), ("c", "one.xhtml#c"), ("d", "one.xhtml#d"), ("e", "ONE.xhtml#E"), ("f", "one.xhtml#f"), ("g", "one.xhtml#g"), ("h", "one.xhtml#h"), ("B", "gone.xhtml#B"), ("file", "one.xhtml#none"), ("fuzzy", "x/two.xhtml"), ("drop", "no.xhtml#no"), ("z", "one.xhtml#z")]
    book = archives.parse_epub(epub([("one.xhtml", one), ("two.xhtml", two)], toc))
    blocks = book["blocks"]
    assert not any("" in str(b) for b in blocks)
    at = {t["title"]: t["block_index"] for t in book["toc"]}
    text = {t: blocks[i]["text"] for t, i in at.items()}
    assert at["b"] == 1 and text["c"] == "next x" and text["d"] == "next x" and text["e"] == "i" and text["f"] == "k" and blocks[at["g"]]["kind"] == "table"
    assert text["h"] == "code" and text["B"] == "other" and at["file"] == 0 and text["fuzzy"] == "other" and "drop" not in at and text["z"] == "again"
    assert archives.normal_path("OPS/b.opf", "./.hidden/../.x.html") == "OPS/.x.html" and archives.normal_path("a/b", "/c//d") == "c/d" and archives.normal_path("b", "../../c") == "c"


def test_mobi_newer_form():
    import struct

    old = mobi(b"<p>old</p>")
    count = struct.unpack(">H", old[76:78])[0]
    offsets = [struct.unpack(">L", old[78 + 8 * i : 82 + 8 * i])[0] for i in range(count)] + [len(old)]
    records = [bytearray(old[a:b]) for a, b in zip(offsets, offsets[1:])]
    exth = records[0].find(b"EXTH")
    number = struct.unpack(">L", records[0][exth + 8 : exth + 12])[0]
    records[0][exth + 8 : exth + 12] = struct.pack(">L", number + 1)
    records[0][exth + 12 : exth + 12] = struct.pack(">LLL", 121, 12, len(records))
    head = bytearray(300)
    head[0:2], head[8:10] = struct.pack(">H", 1), struct.pack(">H", 1)
    head[16:20], head[20:24] = b"MOBI", struct.pack(">L", 232)
    records += [head, bytearray(b"<p>newer</p>")]
    table, at = b"", 78 + 8 * len(records)
    for r in records:
        table += struct.pack(">LL", at, 0)
        at += len(r)
    data = old[:76] + struct.pack(">H", len(records)) + table + b"".join(records)
    assert [b["text"] for b in archives.parse_mobi(data)["blocks"]] == ["newer"]
