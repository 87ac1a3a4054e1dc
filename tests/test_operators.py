"""Relational operators on small inputs: fixtures, nulls, empty inputs, ties, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import urls as U
from vellum.operators import articles, html_blocks, lines, links, outline, page_setting, runs, tables, txt, volumes
from vellum.sources import decode, formats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


NOVEL = "序言\n\n 本书讲述。\r\n第一章 初入江湖\n　　正文一。\r第二章 风波又起\n正文二。\n尾声\n完。"


def test_chapters_become_headings(spark):
    got = rows(txt.blocks(spark.createDataFrame([(1, NOVEL, 5), (2, None, 5), (3, "", 5), (4, " \n\t", 5)], "doc_id long, text string, level int")), "block_index")
    assert [r[4] for r in got if r[2] == "heading"] == ["序言", "第一章 初入江湖", "第二章 风波又起", "尾声"]
    assert len(got) == 8 and got[3][4] == "正文一。"


def test_html_scan(spark):
    page = "<head><title>x</title></head>a<h2>T &amp;lt; &#x20AC;&#8364;</h2><p>one<br>two</p><hr/><img src='u.png'><script>no</script>z"
    got = rows(html_blocks.blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "article_id long, content_html string")), "block_index")
    assert [(r[2], r[3], r[4]) for r in got] == [
        ("paragraph", None, "a"), ("heading", 2, "T < €€"), ("paragraph", None, "one"), ("paragraph", None, "two"), ("hr", None, ""),
        ("image", None, "u.png"), ("paragraph", None, "z"),
    ]


def test_urls(spark):
    assert one(spark, "https://a.b/c?utm_source=x&id=3&SCENE=1#f", U.sanitized) == "https://a.b/c?id=3#f"
    assert one(spark, "https://a.b/c?utm_source=x", U.sanitized) == "https://a.b/c"
    assert one(spark, "https://www.zhihu.com/question/1/answer/2?x=1#y", U.sanitized) == "https://www.zhihu.com/question/1/answer/2"
    assert one(spark, "https://a.b/c", U.sanitized) == "https://a.b/c"
    assert one(spark, "not a url?utm_source=1", U.sanitized) == "not a url?utm_source=1"
    assert one(spark, "看 https://a.b/c。和http://d.e/f), https://a.b/c", U.found_urls) == ["https://a.b/c", "http://d.e/f"]
    assert one(spark, None, U.sanitized) is None
    globs = spark.createDataFrame([("*://*.zhihu.com/*", "https://www.zhihu.com/p/1", True), ("https://a.com/x?y", "https://a.com/x?y", True), ("https://a.com/*", "https://b.com/", False)], "g string, u string, hit boolean")
    assert [r["m"] for r in globs.withColumn("r", U.glob_regex(F.col("g"))).withColumn("m", F.expr("u rlike r") == F.col("hit")).collect()] == [True] * 3


def test_text_functions(spark):
    assert one(spark, "😀a", T.utf16_length) == 3
    assert one(spark, "　 x　", T.trim_control) == "x"
    assert one(spark, "2n+1", T.superscript) == "²ⁿ⁺¹"
    assert one(spark, "字", T.superscript) == "^字" and one(spark, "ab字", T.subscript) == "_(ab字)"
    assert one(spark, "汉字ab", T.em_width) == 3.0
    assert one(spark, "完。", T.optical_hang) == 0.75 and one(spark, "", T.optical_hang) == 0.0
    assert one(spark, "&amp;#65; &#x110000000; &#65;", T.decode_entities) == "A &#x110000000; A"


def test_formats_and_charsets(spark):
    files = [
        (1, "a.TXT", "文".encode()), (2, "b", b"%PDF-1.4"), (3, None, b"PK\x03\x04[Content_Types].xml"), (4, "c.bin", b"PK\x03\x04"),
        (5, "x.azw3", b""), (6, "d", None), (7, "e", bytes(60) + b"BOOKMOBI" + bytes(20)),
    ]
    df = spark.createDataFrame(files, "doc_id long, file_name string, content binary")
    assert [r[2] for r in rows(formats.routed(df), "doc_id")] == ["txt", "pdf", "docx", "epub", "mobi", "txt", "mobi"]
    texts = [b"\xef\xbb\xbfa", "文".encode("gbk"), "文".encode(), "文".encode("utf-16"), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content binary")
    assert [r[0] for r in df.orderBy("doc_id").select(formats.charset(F.col("content"))).collect()] == ["utf-8-bom", "gbk", "utf-8", "utf-16le", "gbk"]
    assert [r[1] for r in rows(decode.file_texts(df), "doc_id")] == ["a", "文", "文", "文", None]
    assert decode.decode_page("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert decode.decode_page(b"<meta charset=gbk>" + "文".encode("gbk")).endswith("文")


def chapters(spark, n, every, doc=1):
    data = [(doc, i, "heading" if i % every == 0 else "paragraph", 1, f"第{i // every + 1}章" if i % every == 0 else "正文" * 20) for i in range(n)]
    return spark.createDataFrame(data, "doc_id long, block_index int, kind string, level int, text string")


def no_toc(spark):
    return spark.createDataFrame([], "doc_id long, toc_ord int, title string, level int, block_index int")


def test_volumes(spark):
    blocks = chapters(spark, 60, 6)
    toc = blocks.where("kind = 'heading'").select("doc_id", F.col("block_index").alias("toc_ord"), F.col("text").alias("title"), "level", "block_index")
    two = rows(volumes.volumes(blocks, toc, 2), "vol_index")
    assert [(r[3], r[4], r[5]) for r in two] == [("上册", 0, 30), ("下册", 30, 60)]
    entries = rows(volumes.volume_outline(blocks, toc, 2), "vol_index", "toc_ord")
    assert len(entries) == 10 and entries[5][5] == 0 and entries[5][3] == "第6章"
    assert [r[4] for r in rows(volumes.volumes(blocks, toc, 3), "vol_index")] == [0, 18, 42]
    assert [r[3] for r in rows(volumes.volumes(blocks, toc, 4), "vol_index")] == ["第1卷", "第2卷", "第3卷", "第4卷"]
    plain = spark.createDataFrame([(1, i, "paragraph", None, "x") for i in range(50)], "doc_id long, block_index int, kind string, level int, text string")
    assert sum(r[5] - r[4] for r in rows(volumes.volumes(plain, no_toc(spark), 3), "vol_index")) == 50
    assert rows(volumes.volumes(plain.limit(1), no_toc(spark), 3), "doc_id")[0][3] == "全一卷"
    heads = chapters(spark, 16, 2)
    assert {r[4] for r in rows(volumes.volumes(heads, no_toc(spark), 2), "vol_index")} == {0, 8}


def test_auto_volumes(spark):
    long = spark.createDataFrame([(1, i, "paragraph", "这是一个句子。" * 60) for i in range(500)] + [(2, 0, "code", None)], "doc_id long, block_index int, kind string, text string")
    got = {r["doc_id"]: r for r in volumes.document_sizes(long).collect()}
    assert got[1]["n_chars"] == 500 * 420 and got[1]["est_pages"] == 840 and got[1]["auto_volumes"] == 2
    assert got[2]["auto_volumes"] == 1 and got[2]["n_chars"] == 0


def test_printed_contents(spark):
    texts = [("heading", "目录"), ("paragraph", "第一章 天色"), ("paragraph", "第二章 风起"), ("heading", "第一章 天色"), ("paragraph", "天色微明，山道上有人独行。"), ("heading", "第二章 风起"), ("paragraph", "风从谷口吹来，卷起落叶。")]
    blocks = spark.createDataFrame([(1, i, k, 1 if k == "heading" else None, t) for i, (k, t) in enumerate(texts)], "doc_id long, block_index int, kind string, level int, text string")
    assert rows(outline.contents_span(blocks), "doc_id") == [(1, 0, 3)]
    left = rows(outline.without_contents(blocks), "block_index")
    assert left[0][4] == "第一章 天色" and [r[1] for r in left] == [0, 1, 2, 3]
    again = outline.without_contents(outline.without_contents(blocks))
    assert rows(again, "block_index") == left


def test_outline(spark):
    toc = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 2), (1, 2, "c", 3), (1, 3, "d", 2), (1, 4, "e", 1)], "doc_id long, toc_ord int, title string, level int")
    assert [r[4] for r in rows(outline.parents(toc), "toc_ord")] == [None, 0, 1, 0, None]


def test_links(spark):
    data = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 2, 0)], "link_id long, ord int, batch int")
    assert {r["link_id"]: r["new_ord"] for r in links.moved(data, 1, 2).collect()} == {1: 2, 2: 0, 3: 1}
    assert {r["link_id"]: r["new_ord"] for r in links.moved(data, 1, -1).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["link_id"]: r["new_ord"] for r in links.moved(data, 3, -1).collect()} == {1: 0, 2: 2, 3: 1}
    new = links.ingest(spark.createDataFrame([("http://a.b/?utm_id=1 http://c.d/",)], "text string"), spark.createDataFrame([("http://c.d/",)], "url string"))
    assert [r[0] for r in new.collect()] == ["http://a.b/"]


def test_merged_runs(spark):
    schema = "run_id long, doc_id long, block_index int, run_index int, text string, bold boolean, italic boolean, font_size float, color int, strikethrough boolean"
    data = [(1, 1, 0, 0, "a", True, None, None, None, None), (2, 1, 0, 1, "b", True, None, None, None, None), (3, 1, 0, 2, "c", None, None, None, None, None), (3, 1, 0, 2, "c", None, None, None, None, None), (4, 1, 0, 3, None, True, None, None, None, None)]
    assert [(r["text"], r["bold"]) for r in runs.merged(spark.createDataFrame(data, schema)).orderBy("seg").collect()] == [("ab", True), ("c", None)]


def test_tables(spark):
    t = spark.createDataFrame([("t", ["甲", "乙", "丙"], [["1", "", "3"], ["", "x"]])], "table_id string, headers array<string>, rows array<array<string>>")
    assert [(r[3], r[4]) for r in rows(tables.cards(t), "row_no", "line_no")] == [("title", "1"), ("field", "【丙】 3"), ("title", "第 2 项"), ("field", "【乙】 x")]
    w = rows(tables.column_widths(t, inner=100.0), "col_no")
    assert abs(sum(r[3] for r in w) - 100) < 1e-6
    assert one(spark, r"| a \| b | c |", tables.pipe_cells) == ["a | b", "c"]
    assert spark.range(1).select(tables.fitted(F.array(F.lit("a")), F.lit(3))).first()[0] == ["a", "", ""]


def test_glyph_lines(spark):
    glyphs = spark.createDataFrame([(1, 0, 10.0, 0.0, 5.0, 10.0, "a"), (1, 0, 11.0, 5.0, 5.0, 10.0, "b"), (1, 0, 10.5, 30.0, 5.0, 10.0, "c"), (1, 0, 40.0, 0.0, 5.0, 10.0, "7")], "doc_id long, page int, y double, x double, w double, h double, ch string")
    found = lines.glyph_lines(glyphs)
    assert [r[4] for r in rows(found, "line_no")] == ["ab c", "7"]
    assert [r[4] for r in rows(lines.without_running_heads(found, 400.0), "line_no")] == []
    para = spark.createDataFrame([(1, 0, 0, "甲"), (1, 0, 1, "乙"), (1, 0, 2, " "), (1, 0, 3, "丙")], "doc_id long, page int, line_no int, text string")
    assert [r[3] for r in rows(lines.paragraphs(para), "par_no")] == ["甲乙", "丙"]


def test_image_choice_skips_what_cannot_be_used(spark):
    rows = [
        (1, "http://x.y/a/b.html", '<img data-src="about:blank" src="https://x.y/1.png">'), (2, "http://x.y/a/b.html", '<img data-original="data:image/svg+xml,x" data-src="c.png">'),
        (3, "http://x.y", '<img src="//cdn.x/1.png?a=1&amp;b=2"><img src="/r.png"><img src="r.png">'), (4, None, '<img src="r.png"><img src="//cdn.x/2.png">'), (5, "http://x.y/", None),
        (6, "http://x.y/", '<img data-ks-lazyload="https://no/1.png">'),
    ]
    got = {(r[0], r[1]): r[2] for r in articles.image_urls(spark.createDataFrame(rows, "article_id long, url string, content_html string")).collect()}
    assert got == {
        (1, 0): "https://x.y/1.png", (2, 0): "http://x.y/a/c.png", (3, 0): "http://cdn.x/1.png?a=1&b=2", (3, 1): "http://x.y/r.png", (4, 0): "https://cdn.x/2.png",
    }


def test_outline_of_any_depth(spark):
    rows = [(1, 0, "a", 2), (1, 1, "b", 9), (1, 2, "c", 10), (1, 3, "d", 10), (1, 4, "e", 3), (1, 5, "f", None), (1, 6, "g", 12), (1, 7, "h", 0), (2, 0, "x", 5)]
    got = {(r["doc_id"], r["toc_ord"]): r["parent_ord"] for r in outline.parents(spark.createDataFrame(rows, "doc_id long, toc_ord int, title string, level int")).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 0, (1, 5): None, (1, 6): 4, (1, 7): None, (2, 0): None}


def test_bookmarks_look_ahead(spark):
    toc = [(1, 0, "One", 1, 0), (1, 1, "Two!", 1, None), (1, 2, "One", 2, None), (1, 3, "One", 1, 5), (1, 4, "…", 1, None), (1, 5, "Nowhere", 1, None)]
    lines = [(1, 0, 0, "One"), (1, 2, 3, "T w o"), (1, 3, 5, "One"), (1, 4, 6, "Two")]
    got = [(r["toc_ord"], r["page_index"]) for r in outline.bookmarks(
        spark.createDataFrame(toc, "doc_id long, toc_ord int, title string, level int, block_index int"), None,
        spark.createDataFrame(lines, "doc_id long, page_index int, block_index int, text string"),
    ).orderBy("toc_ord").collect()]
    assert got == [(0, 0), (1, 2), (2, 3)]


def test_fallbacks_a_font_has(spark):
    row = spark.createDataFrame([("╭✓ₓℝ○a",)], "t string")
    assert row.select(page_setting.with_fallbacks(F.col("t"))).first()[0] == "+vxR·a"
    assert row.select(page_setting.with_fallbacks(F.col("t"), "╭ℝ")).first()[0] == "┌✓ₓR○a"
    assert row.select(page_setting.with_fallbacks(F.col("t"), "")).first()[0] == "╭✓ₓℝ○a"


def test_image_headers(spark):
    import base64 as b64
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0)
    gif, bmp = b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 6, b"BM" + b"\0" * 16 + struct.pack("<II", 10, 20) + b"\0" * 4
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 200, 300) + b"\3"
    rows = [(1, png), (2, gif), (3, bmp), (4, jpg), (5, b"nothing"), (6, None), (7, b"")]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r["id"]: tuple(r["s"]) if r["s"] else None for r in df.select("id", formats.image_size(F.col("content")).alias("s")).collect()}
    assert got == {1: (640, 480), 2: (3, 4), 3: (10, 20), 4: (300, 200), 5: None, 6: None, 7: None}
    assert {r["id"] for r in formats.shown_images(df).collect()} == {1, 3, 4}
    url = "data:image/png;base64," + b64.b64encode(png).decode()
    urls = spark.createDataFrame([(url,), ("data:image/png;base64,@@",), ("https://x",), (None,)], "u string")
    assert [r[0] and bytes(r[0]) for r in urls.select(formats.inline_image(F.col("u"))).collect()] == [png, None, None, None]


def test_page_setting_by_brute_force(spark):
    rows = [(1, 0, 0, 0, 0.0, 12.0, 200.0, 0.0, "x" * 21), (1, 0, 1, 0, 18.0, 12.0, 250.0, 0.0, "y" * 11), (1, 0, 2, 0, 36.0, 12.0, 262.0, 9.0, "z" * 5), (1, 0, 3, 0, 54.0, 12.0, 100.0, 0.0, "w")]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, elem_ord int, block_index int, y double, font_size double, width double, hang double, text string")
    got = {r["elem_ord"]: (round(r["spacing"], 4), round(r["shift"], 4)) for r in page_setting.justified(df, 255.0).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.5, 0.0), 2: (0.5, 0.0), 3: (0.0, 0.0)}
    ys = [r["new_y"] for r in page_setting.aligned_vertically(df, 340.0).orderBy("elem_ord").collect()]
    free = 340.0 - 72.0
    assert ys == pytest.approx([0.0, 18.0 + free / 3, 36.0 + 2 * free / 3, 54.0 + free])
