"""Setting of lines, presets, scripts, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.kernels import splitting
from vellum.operators import page_setting
from vellum.sources import presets

LINES = "doc_id long, page_index int, elem_ord int, block_index int, y double, font_size double, width double, hang double, text string"


def test_justification(spark):
    rows = [(1, 0, 0, 0, 0.0, 10.0, 97.0, 0.0, "一二三四五六七八九十"), (1, 0, 1, 0, 15.0, 10.0, 60.0, 0.0, "一二三四五六"), (1, 0, 2, 1, 30.0, 10.0, 105.0, 7.5, "一二三四五六七八九。"), (1, 0, 3, 1, 45.0, 10.0, 108.0, 0.0, "一二三四五六七八九十"), (1, 0, 4, 1, 60.0, 10.0, 5.0, 0.0, "")]
    df = spark.createDataFrame(rows, LINES)
    got = [(round(r["spacing"], 4), r["shift"]) for r in page_setting.justified(df, 100.0).orderBy("elem_ord").collect()]
    assert got == [(0.3333, 0.0), (0.0, 0.0), (0.2778, 0.0), (-0.8889, 0.0), (0.0, 0.0)]
    centred = page_setting.justified(df, 100.0, "CENTER").orderBy("elem_ord").collect()
    assert centred[1]["shift"] == 20.0


def test_vertical_alignment(spark):
    rows = [(1, 0, k, k, 15.0 * k, 10.0, 50.0, 0.0, "x") for k in range(3)]
    df = spark.createDataFrame(rows, LINES)
    assert [r["new_y"] for r in page_setting.aligned_vertically(df, 65.0).orderBy("elem_ord").collect()] == [0.0, 25.0, 50.0]
    assert [r["new_y"] for r in page_setting.aligned_vertically(df, 65.0, "CENTER").orderBy("elem_ord").collect()] == [10.0, 25.0, 40.0]
    assert [r["new_y"] for r in page_setting.aligned_vertically(df, 65.0, "TOP").orderBy("elem_ord").collect()] == [0.0, 15.0, 30.0]


def test_presets(spark):
    df = spark.createDataFrame([(1, '{"fontSize": 14, "textAlignment": "CENTER"}'), (2, '{"textAlignment": "NOWHERE"}'), (3, "junk"), (4, None)], "i int, j string")
    got = [r["p"] for r in df.orderBy("i").select(presets.params_from_json(F.col("j")).alias("p")).collect()]
    assert got[0]["fontSize"] == 14.0 and got[0]["textAlignment"] == "CENTER" and got[0]["pageWidth"] == 258.0
    assert all(p["textAlignment"] == "LEFT" and p["tableDisplayMode"] == "SMART_CARD" for p in got[1:])
    assert len(got[0]) == 24
    own = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, params string")
    new = presets.saved(own, spark.createDataFrame([("b", "3")], "name string, params string"))
    assert {tuple(r) for r in new.collect()} == {("a", "1"), ("b", "3")}
    kept = presets.backup(new, spark.createDataFrame([("k", "v")], "key string, value string"))
    assert {tuple(r) for r in presets.restored(kept).collect()} == {("a", "1"), ("b", "3")}


def test_scripts(spark):
    script = "// ==UserScript==\n// @name 甲\n// @match https://*.a.com/*\n// @match *://b.com/*\n// ==/UserScript==\nx"
    got = spark.createDataFrame([(script,), ("none",)], "s string").select(presets.script_meta(F.col("s")).alias("m")).collect()
    assert got[0]["m"]["name"] == "甲" and got[0]["m"]["matches"] == ["https://*.a.com/*", "*://b.com/*"] and got[0]["m"]["run_at"] == "document-idle"
    assert got[1]["m"] is None


def test_fallbacks_and_grid(spark):
    df = spark.createDataFrame([(1, 0, "code", "├─ 甲\nab"), (1, 1, "code", None)], "doc_id long, block_index int, kind string, text string")
    assert df.select(page_setting.with_fallbacks(F.col("text"))).first()[0] == "+— 甲\nab"
    assert [(r["columns"], r["target"]) for r in page_setting.code_grid(df, 222.0).collect()] == [(5, 47)]


def test_split_bytes():
    data = "".join(f"这是第 {i} 行文本正文数据。\n" for i in range(100)).encode()
    for n in (1, 2, 5):
        got = splitting.parts(data, n)
        assert b"".join(got) == data and len(got) == n and all(p.endswith(b"\n") for p in got)
    assert splitting.parts(None, 2) == [] and splitting.parts(b"", 2) == [] and b"".join(splitting.parts(b"abc", 9)) == b"abc"
