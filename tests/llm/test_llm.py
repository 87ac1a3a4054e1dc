"""Training-text operators against brute force, public tokenizers, round trips and edge cases."""

from __future__ import annotations

import base64
import html
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import arrow, bpe, charset, lookalike, mainbody, markup, mixing, queries, repetition, residue, site_lines, web, wrapper

TOKENIZER = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")
ARTICLE = "article_id long, url string, title string, content_html string"
SENTENCES = [f"第{i}天，{a}把{b}放在{c}旁边。" for i, (a, b, c) in enumerate((a, b, c) for a in "甲乙丙丁戊" for b in "书灯琴舟" for c in "桥楼井树")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pages(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        body = "\n".join(f"<p>{rnd.choice(SENTENCES)}{i}</p>" for _ in range(3))
        rows.append((i, f"https://Big.example/p/{i // 2}?x={i}", "t", f"<p>已有 {i} 人&nbsp;读过</p>\n{body}\n<div>转载请注明</div>"))
    rows += [(100 + i, f"http://small.example/{i}", None, "<p>same</p>\n<p>one\ttwo</p>") for i in range(3)]
    rows += [(200, None, "x", "<p>转载请注明</p>"), (201, "https://big.example/p/900", None, None), (202, "https://big.example/p/901", "", ""), (0, rows[0][1], "t", rows[0][3])]
    return frame(spark, rows, ARTICLE), rows


def test_p1_equals_brute_force(spark):
    df, rows = pages(spark)
    site_pages, seen, places = {}, {}, {}
    for a, u, _, c in rows:
        m = re.match(r"\w+://([^/?#]+)([^?#]*)", u or "")
        if not m:
            continue
        site, page = m[1].lower(), m[1].lower() + m[2]
        site_pages.setdefault(site, set()).add(page)
        for no, line in enumerate((c or "").split("\n")):
            text = re.sub("[0-9]+", "0", " ".join(html.unescape(re.sub("<[^>]*>", "", line)).split()))
            if text:
                seen.setdefault((site, text), set()).add(page)
                places.setdefault((site, text), set()).add((a, no))
    want = {x for k, p in seen.items() if len(p) >= 4 and len(p) >= 0.1 * len(site_pages[k[0]]) for x in places[k]}
    assert {tuple(r) for r in site_lines.found_lines(df).collect()} == want and want
    assert site_lines.found_lines(df.limit(0)).count() == 0
    clean = {r[0]: r[1] for r in site_lines.without_lines(df, site_lines.found_lines(df)).collect()}
    assert "转载" not in clean[5] and clean[201] is None and clean[202] == ""


def test_p1_blocks_of_several_lines(spark):
    rows = [(i, f"https://s.example/{i}", "t", f"<p>a</p>\n<p>b</p>\n<p>c {i}x</p>\n<p>u{'xyz' * i}</p>\n<p>a</p>") for i in range(6)]
    got = {(r["length"], r["pos"]) for r in site_lines.repeated_blocks(frame(spark, rows, ARTICLE)).where("article_id = 2").collect()}
    assert {(1, 0), (1, 1), (2, 0)} <= got and all(n < 4 for n, _ in got)


def test_p1_maximal_blocks(spark):
    rows = [(i, f"https://s.example/{i}", "t", f"<p>own {'q' * i}</p>\n" + "\n".join(f"<p>{c}</p>" for c in "abcdefg") + f"\n<p>{'z' * i}</p>\n<p>c</p>\n<p>d</p>") for i in range(5)]
    at = site_lines.symbols(frame(spark, rows + rows[:1] + [(9, None, None, "<p>a</p>"), (10, "https://s.example/0", None, None)], ARTICLE))
    got = {(r["pos"], r["length"], r["pages"]) for r in site_lines.maximal_blocks(at, site_lines.block_rounds(at)).where("article_id = 3").collect()}
    assert got == {(1, 7, 5), (9, 2, 5)}
    assert {r["block_lines"] for r in site_lines.block_report(frame(spark, rows, ARTICLE)).collect()} == {2, 7}
    assert site_lines.block_report(frame(spark, rows[:2], ARTICLE)).count() == 0


def test_p2_restores(spark):
    good = [(i, s) for i, s in enumerate(SENTENCES * 4)] + [(1000 + i, f"Le café numéro {i} était déjà fermé à l’heure.") for i in range(60)]
    bad = [
        (5000, SENTENCES[3].encode().decode("cp1252", "replace").replace("�", "")), (5001, SENTENCES[4].encode("gbk").decode("latin-1")),
        (5002, SENTENCES[5].encode().decode("latin-1")), (5003, "Le cafÃ© est fermÃ©."), (5004, "锟斤拷锟斤拷锟斤拷"), (5005, "abc�def"),
        (5006, SENTENCES[6].encode().decode("gb18030", "replace")),
    ]
    clean = [(9000, "屏幕上只剩下「锟斤拷」几个字。"), (9001, None), (9002, ""), (9003, "plain"), (9004, "Em AÇÃO 3 ela leu.")]
    df = frame(spark, good + bad + bad[:1] + clean, "run_id long, text string")
    got = {r["run_id"]: r for r in charset.repaired_runs(df).collect()}
    assert set(got) == {5000, 5001, 5002, 5003, 5004, 5005, 5006}
    assert got[5001]["restored"] == SENTENCES[4] and got[5002]["restored"] == SENTENCES[5] and got[5003]["restored"] == "Le café est fermé."
    assert not got[5004]["complete"] and got[5001]["complete"]
    assert charset.repaired_runs(df.limit(0)).count() == 0


def test_p2_short_garbles_and_rare_pairs_beside_them(spark):
    good = [(i, s) for i, s in enumerate(SENTENCES * 4)] + [(1000 + i, f"Le café numéro {i} était fermé.") for i in range(60)]
    lone = [(5000, "Le cafГ© est grand."), (5001, "Г\xa0 la carte"), (5002, "20В°C outside")]
    short = [(5003, "鼷龘" + SENTENCES[3][:4] + SENTENCES[4][3:8].encode().decode("gb18030", "replace") + SENTENCES[5][5:] + "鼷龘")]
    clean = [(9000, "В\xa0доме, пункт «Г», С\xa0Windows и 220\xa0В…"), (9001, "鼷龘" + SENTENCES[3]), (9002, "Группа «Г»")]
    got = {r["run_id"]: r["restored"] for r in charset.repaired_runs(frame(spark, good + lone + short + clean, "run_id long, text string")).collect()}
    assert set(got) == {5000, 5001, 5002, 5003}
    assert got[5000] == "Le café est grand." and got[5001] == "à la carte" and got[5002] == "20°C outside"


@pytest.mark.parametrize("text", ["{{ page.title }}", "By %AUTHOR% on %DATE%", "来源：{source_name}", "502 Bad Gateway", "Lorem ipsum dolor, amet sit elit magna.", "请开启 JavaScript 后继续浏览", "页面不存在", "示例文字示例文字示例文字", "TODO: write the copy", "[TITLE HERE]", "Just a moment…"])
def test_p3_residue(text):
    assert residue.is_residue(text)


@pytest.mark.parametrize("text", ["开启脚本后可以使用评论功能", "访问旧地址只会得到 404，大家慢慢清洗着水边的暗房。", r"\emph{heavy} rain", "{{cite|t=a|p=3}}", "Nobody had replaced the lorem ipsum in the draft.", "x_{1}^2", "", "first_name"])
def test_p3_leaves_prose_and_markup(text):
    assert not residue.is_residue(text)


def test_p3_code_is_no_residue():
    assert residue.line_residue("<p>写 <code>{{ title }}</code> 处</p>", "写 {{ title }} 处", False) == (False, False)
    assert residue.line_residue("<%= x %>", "", True) == (False, False) and residue.line_residue("<p><%= body %></p>", "", False)[0]


def verdict(content, title="t", url="https://a.example/1", hosts=()):
    row = next(mainbody.features(1, url, title, content))
    lines = [(x["line_no"], x["flags"], x["width"], x["ending"], False, x["line_no"] in hosts, x["tail"], x["chars"], x["bytes"]) for x in row[4]]
    return mainbody.decide(lines)


PROSE = "<p>The old house near the border was rebuilt in the spring, and the history of the place is told by the people of the town who were there.</p>"


def test_p3_messages_in_long_lines_need_the_page():
    long = "<p>Error 404: the page could not be found on this server, please go back to where you came from and try again in a little while.</p>"
    assert verdict(long)[0] and verdict("<p>We are sorry. " + long[3:])[0]
    assert not verdict(long + "\n" + PROSE)[0]


def test_p3_titles_of_prose_about_messages():
    assert verdict(PROSE, "Access denied")[0] and verdict(PROSE, "404 Not Found")[0]
    assert not verdict(PROSE, "Access denied: a history of the border")[0] and verdict("<p>short</p>", "Access denied: a history of the border")[0]
    assert verdict(PROSE, "{{ title }} of the border history")[0]


def test_p3_responses_of_many_hosts():
    page = "<p>Zugriff auf diesen Inhalt leider gerade nicht vorgesehen</p>"
    assert verdict(page, "Der alte Garten", hosts=(0,))[0] and not verdict(page, "Der alte Garten")[0]
    assert not verdict(page, "Zugriff und Inhalt", hosts=(0,))[0] and not verdict(page, "x", "https://a.example/inhalt-der-seite.html", hosts=(0,))[0]
    assert not verdict(page + "\n" + PROSE, "Der alte Garten", hosts=(0,))[0]


@pytest.mark.parametrize("text", ["[YOUR NAME]", "ページが見つかりませんでした", "undefined undefined", "null, null", "<<NAME>>"])
def test_p3_more_residue(text):
    assert residue.is_residue(text)


def test_p4_ends():
    whole = "<p>这是一个完整的长段落，它把话说完了，没有留下什么。</p>\n"
    assert verdict(whole)[2][0] == mainbody.WHOLE
    assert verdict(whole + "<p>这是另一个段落，说到一半")[2][0] == mainbody.CUT
    assert verdict(whole + "<p>这是另一个段落，说到一…</p>\n<div class='unfold'>展开全文</div>")[2][0] == mainbody.CUT
    assert verdict(whole + "<p>后面的事情大家都知道了……</p>")[2][0] == mainbody.WHOLE
    assert verdict(whole + "<ul>\n<li>没有句号</li>\n</ul>")[2][0] == mainbody.WHOLE
    assert verdict(whole + "<p>（未完待续）</p>")[2][0] == mainbody.WHOLE
    assert verdict(whole + "<p>这是另一个段落，说到</p>")[2][0] == mainbody.OPEN_QUESTION
    assert verdict(None)[2][0] == mainbody.WHOLE and verdict("")[1] == []


def test_p7_labels():
    page = "<nav>\n<li><a href='/1'>首页</a></li>\n</nav>\n<p>这是一个完整的长段落，它把话说完了，没有留下什么。</p>\n<h2>尾声</h2>\n<ul>\n<li><a href='https://x.example/p/1'>书</a></li>\n</ul>\n<p>责编：甲 校对：乙</p>\n<footer>\n<div>© 2020 a</div>\n</footer>"
    labels = dict(verdict(page)[1])
    assert [n for n, x in labels.items() if x == mainbody.CHROME_LABEL] == [1, 8, 10]


def test_p7_nearest_neighbour():
    body, chrome, none = mainbody.BODY_LABEL, mainbody.CHROME_LABEL, mainbody.UNSURE
    assert mainbody.second_pass([body, 0, 0, 0, 0, 0, chrome]) == [body, body, body, body, chrome, chrome, chrome]
    assert mainbody.second_pass([chrome, 0, 0, body]) == [chrome, chrome, body, body]
    assert mainbody.second_pass([0, body, 0]) == [body] * 3 and mainbody.second_pass([0, 0]) == [chrome] * 2 and mainbody.second_pass([]) == []
    assert none == 0


def test_p7_menus_of_plain_lists_and_long_notices(spark):
    menu = "<ul>\n<li><a href='/a'>Garden</a></li>\n<li><a href='/b'>Kitchen</a></li>\n</ul>"
    notice = "<p>" + "We and our partners keep cookies of kinds too many to list in one breath, and by reading on you agree to all of them at once. " * 4 + "</p>"

    def body(i):
        word = "".join(chr(97 + int(d)) for d in str(1000 + i))
        return f"<p>The old house {word} near the border was rebuilt in the spring by the people of {word}, and that is the whole of the story.</p>"

    rows = [(i, f"https://s{i % 20}.example/{i}", f"title {i}", f"{menu if i % 20 == 0 else ''}\n{body(i)}\n<h2>Part</h2>\n{notice if i < 20 else ''}") for i in range(200)]
    got = {tuple(r) for r in mainbody.page_lines(frame(spark, rows, ARTICLE)).collect()}
    assert {(i, n) for i in range(0, 200, 20) for n in (1, 2)} <= got  # the menu stands on all pages of its site
    lines = {i: rows[i][3].split("\n") for i in range(20)}
    assert {(i, len(lines[i]) - 1) for i in range(20)} <= got  # the notice stands on twenty sites
    assert not any("old house" in rows[a][3].split("\n")[n] for a, n in got)


def test_p3_p4_p7_on_frames(spark):
    def body(i):
        return f"<p>这是{chr(0x4E10 + i)}写的一个完整的长段落，它把{chr(0x5E10 + i)}的话说完了，没有留下什么。</p>"

    rows = [(i, f"https://s{i % 6}.example/{i}", "t", f"{body(i)}\n<p>扫一扫看世界第{i}回</p>") for i in range(60)]
    rows += [(90, "https://s1.example/x", "404 Not Found", body(90)), (91, None, None, None), (92, "https://s1.example/y", "t", ""), (93, "https://s1.example/z", "t", body(93) + "\n<p>这是另一个段落，说到一")]
    df = frame(spark, [(*r, "clash") for r in rows], ARTICLE + ", lines string")
    assert [r[0] for r in mainbody.residue_articles(df).collect()] == [90]
    assert {tuple(r) for r in mainbody.page_lines(df).collect()} == {(i, 1) for i in range(60)}
    cut = mainbody.cut_verdicts(df)
    assert [r[0] for r in cut.where("is_cut").collect()] == [93] and cut.count() == 63
    assert mainbody.residue_articles(df.limit(0)).count() == 0 and mainbody.cut_verdicts(df.limit(0)).count() == 0


def test_p4_spikes(spark):
    rows = [(i, 1, 1000 + i, 1, 7, 900 if i < 20 else 500 + 37 * i, 1800 + i * 11) for i in range(40)]
    ends = frame(spark, rows, "article_id long, site_key long, page_key long, verdict int, tail long, chars int, bytes int")
    got = mainbody.length_spikes(ends).collect()
    assert {(r["site_key"], r["unit"], r["size"], r["n_pages"]) for r in got} == {(1, "chars", 900, 20), (None, "chars", 900, 20)}


def test_p4_a_word_is_final_by_its_share(spark):
    def body(i):
        return f"<p>{chr(0x4E10 + i)}在河堤上写了{chr(0x5E10 + i)}的一个完整的长段落，它把话说完了，没有留下渡口。</p>"

    rows = [(i, f"https://s{i}.example/{i}", "t", body(i) + (f"\n<p>后来{chr(0x6E10 + i)}的人都走到了这条长长的河堤。</p>" if i < 4 else "")) for i in range(120)]
    rows += [(200 + i, f"https://s3.example/3?x={i}", "t", rows[3][3]) for i in range(9)]
    rows += [(300, "https://t.example/1", "t", body(300) + "\n<p>这是另一个段落，说到了河堤</p>"), (301, "https://t.example/2", "t", body(301) + "\n<p>这是另一个段落，说到了渡口</p>")]
    assert {r[0] for r in mainbody.cut_verdicts(frame(spark, rows, ARTICLE)).where("is_cut").collect()} == {300}
    assert mainbody.tail_words("It’s a 3-day “trip” 去河堤") == {"it’s", "a", "3", "day", "trip", " 去", "去河", "河堤"}


def test_p4_repeated_lines_and_words_are_read_together():
    import pyarrow as pa

    text = "It’s over, he said. 他走了。“好！” 剩下 3. Wait... 'tis a 3-day 'trip' end\uff13。"
    lines = web.lines_of(f"<p>{text}</p>\n<pre>\nno word of code is read, however long it is.\n</pre>\n<p>The second paragraph of it ends here.</p>")
    words, ends, pairs, end_pairs = mainbody.words_and_pairs(lines)
    second = "The second paragraph of it ends here."
    shown = {mainbody._code(w) for x in (text, second) for w in mainbody.tail_words(x)}
    assert words | set(pairs.tolist()) == shown | ends and {"said", "wait", "here"} == ends
    assert {mainbody._word(c) for c in end_pairs.tolist()} == {"走了", "“好"}
    mainbody._kept_line.cache_clear()
    found = [next(mainbody.features(i, f"https://a.example/{i}", "t", f"<p>{'同' * 9}</p>\n<p>own {'x' * i}</p>")) for i in range(1, 4)]
    assert mainbody._kept_line.cache_info().hits == 2 and len({x["line_key"] for row in found for x in row[4] if x["line_no"] == 0}) == 1
    column = pa.array([[1, None], None, [], [1 << 60]], pa.list_(pa.int64()))
    assert arrow.values(column) == column.to_pylist() and arrow.values(column.slice(2)) == [[], [1 << 60]] and arrow.values(pa.array(["a", None])) == ["a", None]


def test_p4_collector_is_paused_and_comes_back():
    import gc

    with pytest.raises(KeyError), arrow.no_cycles():
        assert not gc.isenabled()
        raise KeyError
    assert gc.isenabled()


def test_p5_pairs(spark):
    runs = [(1, "ＡＢＣ　１２"), (2, "ABC 12"), (3, "АВС  12"), (4, "abc 12"), (5, "cafe\u0301"), (6, "café"), (7, "⽔面"), (8, "水\u200b面"), (9, None), (10, " \u200b"), (11, "①"), (12, "1"), (2, "ABC 12"), (13, "ABC 12")]
    got = {tuple(r) for r in lookalike.equal_looking_pairs(frame(spark, runs, "run_id long, text string"), frame(spark, [(1, None, "Ｘ", None), (2, None, "X", None)], ARTICLE)).collect()}
    assert got == {("run", 1, 2), ("run", 1, 3), ("run", 2, 3), ("run", 1, 13), ("run", 3, 13), ("run", 5, 6), ("run", 7, 8), ("title", 1, 2)}
    assert lookalike.look("x²") != lookalike.look("x2") and lookalike.look("ｶﾞ") == lookalike.look("ガ")


def test_p2_any_text_is_read():
    judge = charset.Judge(np.zeros(1 << (charset.MODEL_BITS - 6), dtype=np.uint64))
    signs = [chr(c) for c in (*range(0x80, 0x500), *range(0x2000, 0x2700, 3), 0xFFFD, 0xE000, 0xE765, 0x1F600, 0xD800)]
    for a in signs[::5] + ["Р", "С", "В", "Г"]:
        for b in "\xb8\xa0°ёЂ\x98�":
            judge.repair(f"x{a}{b}y {b}{a}")


def test_p5_automaton():
    trie = lookalike.Trie(["paper", "caf\u00e9", "ﬁne", "第一", "pa\u200bper"])
    for raw in ("paper", "ｐａｐｅｒ", "pа\u200bper", "рарer", "\u00adpaper"):
        assert trie.walk(raw) == ("paper", 0) and trie.spell(raw) == "paper"
    assert trie.walk("cafe\u0301") == ("caf\u00e9", 0) and trie.walk("fine") == ("ﬁne", 0) and trie.walk("第⼀") == ("第一", 0)
    assert trie.walk("papers") is None and trie.walk("papers", 1) == ("paper", 1) and trie.walk("pper", 1) == ("paper", 1) and trie.walk("pyper", 1) == ("paper", 1)
    assert trie.walk("") is None and trie.spell("\u200b") == "" and trie.canonical(" \u200b ｐaper\u3000x ") == "paper x"
    marks = lookalike.Trie(["a\u0323\u0301"])
    assert marks.walk("a\u0301\u034f\u0323") is None and marks.spell("a\u0301\u034f\u0323") == "a\u0323\u0301"


def test_p5_forms_agree_where_looks_agree(spark):
    rnd = random.Random(2)
    alike = {"a": "aа\uff41ɑ", "e": "eе\uff45", "o": "oоο", "s": "sѕ", " ": " \u00a0\u3000"}
    texts = ["".join(rnd.choice(alike.get(c, c)) + rnd.choice(("", "", "\u200b")) for c in rnd.choice(("some paper", "a rose", "one two", "ones"))) for _ in range(300)]
    trie = lookalike.Trie(lookalike.vocabulary(frame(spark, [(t,) for t in texts], "text string")))
    assert trie.by_look and len({(lookalike.look(t), trie.canonical(t)) for t in texts}) == len({lookalike.look(t) for t in texts}) == len({trie.canonical(t) for t in texts})
    assert lookalike.vocabulary(frame(spark, [(t,) for t in texts], "text string"), size=0) == [] and lookalike.vocabulary(frame(spark, [], "text string")) == []


def test_p5_a_spelling_of_many_rows(spark):
    runs = [(i, "paper") for i in range(300)] + [(1000, "рaper"), (1001, "pap\u0435r"), (1, "paper")]
    got = {tuple(r)[1:] for r in lookalike.equal_looking_pairs(frame(spark, runs, "run_id long, text string"), frame(spark, [], ARTICLE)).collect()}
    assert got == {(i, k) for i in range(300) for k in (1000, 1001)} | {(1000, 1001)}


@pytest.mark.parametrize(
    "text,kind",
    [("a<br/>b", "html"), ("&lt;b", "html"), ("</div>", "html"), ("<!-- x -->", "html"), ("**粗**", "markdown"), ("# 题", "markdown"), ("> 引", "markdown"), ("[a](/b)", "markdown"), ("`x`", "markdown"),
     ("[[页|名]]", "wiki"), ("{{cite|t=a|p=3}}", "wiki"), ("'''粗'''", "wiki"), ("== 节 ==", "wiki"), (r"\emph{x}", "latex"), ("字$x_{1}^2$字", "latex"), (r"\(x^{2}\)", "latex"), (" \\alpha_{0} ", "latex"),
     ("标价 $71，运费 $74，", None), ("a < b 且 b > 79", None), ("27% <= 0.5", None), ("C:\\books\\vol47", None), ("snake_case_46 与 other_name", None), ("x ~ 5 & y ~ 7", None), ("C# 与 F#", None), ("#58 笨重", None),
     ("好。 [9]", None), ("见 (*) 处。", None), ("{40, 41}", None), ("{{title}}", None), ("1 << 8 >> 2", None), (None, None), ("", None)],
)
def test_p6_kinds(text, kind):
    assert markup.markup_kind(text) == kind


def test_p6_cleaning(spark):
    assert markup.cleaned("# 题\n**粗** [a](/b) '''x''' \\emph{y} &amp; <b>z</b>\n* 项") == "# 题\n粗 a x y & z\n- 项"
    assert markup.cleaned("```\n**x**\n```") == "```\n**x**\n```" and markup.cleaned(None) is None and markup.cleaned("") == ""
    rows = [(i, f"https://s.example/{i}", "t", f"<div><p>固定的一行</p><h2>节{i}</h2><p>内容{'甲乙丙丁'[i % 4] * (i + 2)}</p><pre><code>x = {i}</code></pre></div>") for i in range(8)]
    got = {r[0]: r[1] for r in markup.clean_pages(frame(spark, rows + [(99, None, None, None)], ARTICLE)).collect()}
    assert got[3] == "## 节3\n内容丁丁丁丁丁\n```\nx = 3\n```" and got[99] is None and len(got) == 9
    found = markup.with_markup(frame(spark, [(1, "a**b**"), (1, "a**b**"), (2, None)], "run_id long, text string"), frame(spark, [(5, None, None, "<p>&lt;b&gt;</p>"), (6, None, None, "<code>&lt;b&gt;</code>")], ARTICLE))
    assert {tuple(r) for r in found.collect()} == {("run", 1), ("article", 5)}


def test_p6_clips_of_one_page_are_no_template(spark):
    clips = [(i, f"https://s.example/a?from={i}", "t", f"<div><p>固定的一行</p><p>文章<b>一</b>。</p><p>共同的正文</p><p>第{i}版</p></div>") for i in range(30)]
    others = [(100 + i, f"https://s.example/{i}", "t", f"<div><p>固定的一行</p><p>文章<b>{i}</b>。</p><p>内容{i}</p></div>") for i in range(6)]
    got = {r[0]: r[1] for r in markup.clean_pages(frame(spark, clips + others, ARTICLE)).collect()}
    assert len(got) == 36 and all(got[i] == f"文章一。\n共同的正文\n第{i}版" for i in range(30)) and got[103] == "文章3。\n内容3"


def test_p6_places_are_aligned_nodes(spark):
    def page(i):
        tea, other = "Tea *and* cake", f"Own *text* {i}"
        first, second = (tea, other) if i < 3 else (other, tea) if i < 6 else (other, other + "x")
        return f"<div><h2>First</h2><p>{first}</p></div><div><h2>Second</h2><p>{second}</p><p>All *rights* {'' if i % 2 else '<b>are</b> '}ours</p></div>"

    rows = [(i, f"https://s.example/{i}", "t", page(i)) for i in range(12)]
    rows += [(100 + i, f"https://u.example/{i}", "t", f"<p>{'*a* ' * (i + 1)}</p>" + "".join(f"<p>only {i} {j}</p>" for j in range(i % 3)) + "<p>Made *by* us</p>") for i in range(70)]
    got = {r["article_id"]: (r["n_slots"], r["n_templates"]) for r in markup.markup_places(frame(spark, rows, ARTICLE)).collect()}
    # a text on three pages in one place and on three in another is no template of a site of twelve, which needs four
    assert got == {**{i: (2, 1) for i in range(12)}, **{100 + i: (1, 1) for i in range(70)}}


def test_p6_alignment():
    def paths(content, w):
        root = markup.tree(content)
        w.name(root)
        return {text: path for path, _, text in markup.units(root)}

    first, second = "<div><p>one</p><p>end</p></div>", "<div><p>two</p><ul><li>x</li><li>z</li></ul><p>more</p><p>end</p></div><div><p>c</p><p>d</p></div>"
    w = wrapper.induced(markup.tree(x) for x in (first, second))
    assert [p.tag for p in w.root.children[0].children] == ["p", "ul", "p", "p"] and len(w.root.children) == 2
    a, b = paths("<div><p>three</p><p>end</p></div>", w), paths("<div><p>c</p><p>new</p></div><div><p>end</p><ul><li>y</li><li>x</li></ul></div><table><tr><td>t</td></tr></table>", w)
    assert a["end"] == a["three"] == b["end"] == "/div#2/p/#text" and b["new"] == "/div/p/#text" and b["t |"] == "/table/tr/td/#text"
    deep, long = "<div>" * 3000 + "x", "<ul>" + "".join(f"<li><p>{i}</p><p>x</p></li>" for i in range(1500)) + "</ul>"
    w = wrapper.induced(markup.tree(x) for x in (deep, long, long.replace("<li><p>7</p><p>x</p></li>", "")))
    whole, less = paths(long, w), paths(long.replace("<li><p>7</p><p>x</p></li>", ""), w)
    assert paths(deep, w) and len({p for t, p in whole.items() if t != "x"}) == 1500 and less["9"] == whole["9"] != whole["8"]


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_p8_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(TOKENIZER, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["", None, " ", "\n\n  a", "a" * 3000, "aaaa" * 500 + "b", "<|endoftext|>", "👩‍👩‍👧 𝔘𝔫𝔦 ไทย العربية", "don't I'll", "\u3000\u00a0x\t\n"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x4E00, 0x9FFF), rnd.randrange(0x400, 0x450), 32])) for _ in range(rnd.randrange(1, 300))) for _ in range(200)]
    df = frame(spark, [(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r[0]: list(r[1]) for r in bpe.document_ids(df).collect()}
    assert got == {i: encoding.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_p6_pages_of_any_depth():
    deep = "<div><p>" * 20000 + "x *y*" + "<pre>a\nb</pre>"
    assert [u[2] for u in markup.units(markup.tree(deep))] == ["x *y*", "```\na\nb\n```"]
    assert markup.markup_kind("*" + "word " * 60 + "end*") == "markdown" and markup.markup_kind("$x " + "+ y " * 60 + "= z$") == "latex"


def test_p9_weights_meet_targets():
    rnd = random.Random(2)
    targets = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 4)}
    cells = [(s, lang, f, rnd.randrange(50, 900)) for s in "abcx" for lang in ("zh", "en") for f in ("prose", "notes")]
    w = mixing.raked(cells, targets)
    got = {s: sum(w[c[:3]] * c[3] for c in cells if c[0] == s) for s in "abc"}
    assert all(abs(got[s] / sum(got.values()) - targets[s][0]) < 1e-6 for s in "abc")
    assert all(0 <= w[c[:3]] <= targets[c[0]][1] + 1e-9 for c in cells if c[0] in targets) and not any(k[0] == "x" for k in w)
    assert mixing.raked([], targets) == {}


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_p9_caps():
    cells = [("a", "en", "prose", 1000), ("b", "en", "prose", 1_000_000), ("c", "de", "notes", 500_000)]
    for none in (0, -1):
        w = mixing.raked(cells, {"a": (0.2, none), "b": (0.4, 1), "c": (0.4, 2)})
        assert set(k[0] for k in w) == {"b", "c"} and w["b", "en", "prose"] * 1_000_000 == pytest.approx(w["c", "de", "notes"] * 500_000)
    bound = mixing.raked(cells, {"a": (0.2, 5), "b": (0.4, 1), "c": (0.4, 2)})
    assert bound["a", "en", "prose"] == pytest.approx(5) and bound["b", "en", "prose"] == pytest.approx(0.01)
    short = mixing.raked(cells, {"a": (0.2, 5), "b": (0.4, 1), "c": (0.4, 2)}, total_tokens=1_000_000)
    assert short["a", "en", "prose"] == pytest.approx(5) and short["b", "en", "prose"] == pytest.approx(0.4) and short["c", "de", "notes"] == pytest.approx(0.8)
    assert mixing.raked(cells, {"a": (1.0, 0)}) == {}


def test_p9_reports(spark):
    docs = [(i, "word " * (10 + i % 7), "en" if i % 3 else "de", "abc"[i % 3]) for i in range(300)]
    df = frame(spark, docs, "doc_id long, text string, lang string, source string")
    targets = frame(spark, [("a", 0.3, 1), ("b", 0.3, 4), ("c", 0.4, 0), ("d", 0.0, 3)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.actual_shares(df, targets).collect()}
    assert got["c"]["tokens"] == 0 and got["a"]["actual_share"] == pytest.approx(0.5, abs=0.02) and got["a"]["at_cap"] and not got["b"]["at_cap"] and got["d"]["tokens"] == 0
    margins = mixing.margins(df, targets).collect()
    assert {r["axis"] for r in margins} == {"lang", "form"} and sum(r["actual_share"] for r in margins) == pytest.approx(2) and sum(r["wanted_share"] for r in margins) == pytest.approx(2)
    none = mixing.actual_shares(df, frame(spark, [("a", 1.0, None)], "source string, target_share double, max_repeats int")).collect()
    assert [(r["tokens"], r["actual_share"]) for r in none] == [(0, 0.0)] and mixing.margins(df.limit(0), targets).count() == 0


def test_p9_mix(spark):
    rnd = random.Random(4)
    docs = [(i, "word " * rnd.randrange(5, 60), rnd.choice(["en", "EN", None]), rnd.choice(["a", "a", "b", "c", None])) for i in range(900)]
    docs += [(5000, None, "en", "a"), (5001, "", "en", "b"), (5002, " ", None, "zzz")]
    df = frame(spark, docs, "doc_id long, text string, lang string, source string")
    targets = frame(spark, [("a", 0.4, 1), ("b", 0.35, 2), ("c", 0.25, 3)], "source string, target_share double, max_repeats int")
    rows = mixing.actual_shares(df, targets).collect()
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 and r["most_repeats"] <= r["max_repeats"] for r in rows) and len(rows) == 3
    assert mixing.mixed(df.limit(0), targets).count() == 0


def brute_repeated(text, words=5, chars=10):
    """Covered letters of a text in one script, by sets of what stood earlier."""
    unspaced = any("\u3040" <= c <= "\u9fff" for c in text)
    if unspaced:
        s = re.sub(r"[0-9]+", "0", "".join(c.lower() for c in text if c.isalnum()))
        seen, hit = set(), [False] * len(s)
        for i in range(len(s) - chars + 1):
            g = s[i : i + chars]
            if g in seen:
                hit[i : i + chars] = [True] * chars
            seen.add(g)
        return sum(hit) / max(len(s), 1)
    toks = re.findall(r"[^\W_]+", text.lower())
    seen, hit = set(), [False] * len(toks)
    for i in range(len(toks) - words + 1):
        g = tuple(toks[i : i + words])
        if g in seen:
            hit[i : i + words] = [True] * words
        seen.add(g)
    return sum(len(t) for t, h in zip(toks, hit) if h) / max(sum(map(len, toks)), 1)


def test_p10_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(80):
        words = [rnd.choice("the cat sat on a mat and ran far away home now".split()) for _ in range(rnd.randrange(1, 120))]
        texts.append(" ".join(words) + rnd.choice(["", ". " + " ".join(words[:30])]))
        texts.append("".join(rnd.choice(SENTENCES[:9]).replace("第", "") if rnd.random() < 0.8 else rnd.choice("山川湖海云雨") for _ in range(rnd.randrange(1, 14))))
    texts = [re.sub("[0-9]", "", t) for t in texts]
    got = repetition.shares(repetition.Stream(texts))
    assert np.allclose(got, [brute_repeated(t) for t in texts], atol=1e-9)
    order = repetition.measured_order(repetition.Stream(texts[:20]), 0.4)
    for o in (order, list(repetition.BOUNDS), []):
        assert (repetition.much_repeated(repetition.Stream(texts), o, 0.4) == (got >= 0.4)).all()
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "!!!"), (903, "ha" * 50), (903, "ha" * 50)]
    df = frame(spark, rows, "doc_id long, text string")
    assert {r[0] for r in repetition.repetitive(df).collect()} == {i for i, x in enumerate(got) if x >= 0.4} | {903}
    shares = {r[0]: r[1] for r in repetition.repeated_shares(df).collect()}
    assert shares[900] == shares[901] == shares[902] == 0.0 and repetition.repetitive(df.limit(0)).count() == 0


def test_digits_case_and_punctuation_make_no_difference():
    a = "In the year 1990 the old house burned down quickly."
    assert repetition.shares(repetition.Stream([a + " " + a.upper().replace("1990", "7").replace(" ", ", ")]))[0] > 0.45


def test_every_problem_has_its_query():
    names = queries.queries()
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_ids", "p9_mix"} <= set(names)
    assert arrow and web.site_and_page("HTTP://User@A.B:80/c?d#e") == ("a.b:80", "a.b:80/c") and web.site_and_page("x") == (None, None)
    assert F is not None


def test_p6_pages_by_wrapper(spark):
    def page(i, extra=""):
        return f"<div><p>Part of the *site* set</p><p>own text {chr(97 + i)}</p>{extra}</div>"

    rows = [(i, f"https://s.example/{i}", "t", page(i, "<p>see [a](https://x.example)</p>" if i == 3 else "")) for i in range(8)]
    rows += [(20, None, "t", "<p>**b**</p>"), (21, "https://t.example/1", None, None), (22, "https://t.example/2", "t", ""), (23, "https://t.example/3", "t", "<p>plain * text</p><pre>**x**</pre>")]
    rows += [(24, "https://t.example/4", "t", "<p>list</p>\n<p>- one</p>\n<p>- two</p>"), (0, rows[0][1], "t", rows[0][3])]
    got = {r["article_id"]: (r["n_slots"], r["n_templates"]) for r in markup.markup_places(frame(spark, rows, ARTICLE)).collect()}
    assert got == {**{i: (0, 1) for i in range(8)}, 3: (1, 1), 20: (1, 0), 24: (1, 0)}
    none = frame(spark, [], "run_id long, text string")
    assert {tuple(r) for r in markup.with_markup(none, frame(spark, rows, ARTICLE)).collect()} == {("article", i) for i in got}
    assert markup.with_markup(none, frame(spark, [], ARTICLE)).count() == 0
