"""Problems 3, 4 and 7: what each line of a clipped page is, and what that says about the page.

One pass over the pages gives every line a few features and two keys.  Two counts over the whole corpus
follow: on how many pages of its site a line stands, and on how many sites it stands once the site's own
name is masked.  Lines, with these counts, then meet again by article, where two passes of block rules
decide: first every line by itself (stop-word density, length, link density, mark-up and the counts),
then short undecided lines by their nearest decided neighbours.

Only keys and numbers are shuffled, never text.  Null or blank contents have no lines; an article
without a host has no counts; repeated rows of one article_id are taken as one article; lines of any
length are read whole; empty tables give empty results and columns not named here are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import cut_lineage, ship_package, spread
from .arrow import map_rows, no_cycles
from .residue import MESSAGE_WIDTH, PLACEHOLDER, is_residue, line_residue, message, says_message, terms, width
from .web import brand, key, lines_of, same_text, site_and_page

LIST, CODE, PAGE, HEAD, QUOTE, TABLE, ITEM, LINKED, LONG, CHROME, CRUMB, NOSCRIPT, RESIDUE, WEAK, IMAGE, TITLE, NEXT, SIGN, UNFOLD, OPEN, LAST, STYLED, SAID, MATCHED = (
    1 << i for i in range(24)
)
#: Lengths by which blocks are classified, in columns: a prompt, a notice by its words, one line of a page, and a block
#: set apart by its mark-up are no longer than this; a block is long, and a whole sentence is prose, from this on.
PROMPT_WIDTH, NOTICE_WIDTH, LINE_WIDTH, SET_WIDTH, LONG_WIDTH, SENTENCE_WIDTH = 72, 80, 120, 160, 90, 28
#: How a line ends.
END_NONE, END_STOP, END_DOTS, END_WORD, END_CUT = 0, 1, 2, 3, 4
GOES_ON = frozenset(",，、:：-–—―(（[【“‘「『《<\\/&%$#@+=*_ー々〆")

HREF = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.I | re.S)
MEDIA = re.compile(r"<(?:img|video|audio|picture|svg|iframe|embed|figure)\b", re.I)
#: End tags, dots and blanks at the end of a line: what is left after a cut.
CLOSING = re.compile(r"(?:</[A-Za-z0-9]+\s*>|<br\s*/?>)$")
#: A long quotation, such as a title inside a prompt to share the page.
QUOTED = re.compile(r"《.{10,}》|“.{10,}”|「.{10,}」|『.{10,}』|\".{10,}\"")
#: Several short labels in a row, as in a menu on one line.
MENU = re.compile(
    r"^(?:[^\s/|·•.。，！？]{1,12}(?: [^\s/|·•.。，！？]{1,12})?\s*[/|·•]\s*){2,}[^\s/|·•.。，！？]{1,12}(?: [^\s/|·•.。，！？]{1,12})?$"
    r"|^(?:[぀-鿿]{2,8} ){2,}[぀-鿿]{2,8}$|^(?:[A-Z][a-z]+ ){3,}[A-Z][a-z]+$"
)
#: Parts of class and id names that mark a line as the site's.
ASIDE = re.compile(
    r"""<\w+[^>]*\b(?:class|id)\s*=\s*["']?[^"'>]*(?:\btip|meta|share|notice|advert|related|nav|menu|foot|sidebar|copyright|cookie|consent|promo|unfold|more-box|banner|subscribe|breadcrumb)""",
    re.I,
)
#: A whole line set apart by its styling.
APART = re.compile(r"""^\s*(?:<section\b|<p\b[^>]*\bstyle\s*=\s*["'][^"']*color|<p[^>]*>\s*<(strong|b|em)\b[^>]*>.*</\1>\s*</p>\s*$)|^\s{2,}<p>\s""", re.I)
BARE = re.compile(r"^(?:\s*<(?:a|b|em|i|span|strong)\b[^>]*>|[^<]).*<br\s*/?>\s*$", re.I)
CRUMBS = re.compile(r"\S\s*(?:>|»|›|→)\s*\S[^>»›→]*\s*(?:>|»|›|→)\s*\S")
#: Words of a site's own notices, prompts and bylines, for sites too small for counts.
NOTICE = re.compile(
    r"cookie|©|\(c\) ?\d|copyright|all rights|privacy|terms of|newsletter|subscri|sign in|log in|follow us|share (?:this|on)|rss\b|"
    r"site map|read more|^(?:words|text|photos?|drawings|edited|written|posted|published|filed|reprinted|by)\b.{0,60}$|readers found|"
    r"^(?:related(?: (?:articles|posts|stories))?|you may also like|most read|sponsored|latest comments|tags|trending|advertisement)$",
    re.I,
)
#: Signs of which one stands in a text that NOTICE matches.
NOTICE_SIGNS = re.compile(r"[A-Za-z©\u0130\u0131\u017f\u212a]")
#: The same in unspaced text: anywhere, and from the beginning of the line on.
NOTICE_UNSPACED = re.compile(
    r"隐私|备案|版权|转载|扫码|关注|订阅|客户端|免责|不代表|侵权|友情链接|保留.{0,4}权利|点赞|收藏|举报|在看|人读过|写下你的想法|星标|发给朋友|"
    r"クッキー|規約|転載|無断|編集室|新着|栞|友だち|人が読みました|公開$|会社案内|個人情報|ページの先頭"
)
NOTICE_FIRST = re.compile(
    r"(?:撰文|制图|摄影|编辑|校对|责编|文|图|図)[ \u3000]\S{1,16} ?[/／|｜] ?\S|"
    r"(?:相关阅读|相关文章|猜你喜欢|热门推荐|大家都在看|最新评论|标签云|广告|関連記事|人気の記事|おすすめ|タグ|広告|新着)$|"
    r"(?:责编|编辑|校对|撰文|作者|文|图|来源|发布于|摄影|制图|审校)\s*[:：]|发布于|(?:文|図|写真|編集|校正)\s*[:：]"
)
#: Prompts to go on reading elsewhere.
UNFOLDS = re.compile(
    r"^[\s.…·]*(?:(?:展开|显示|查看|阅读|加载|点击|打开)[^。，]{0,12}(?:全文|更多|全部|APP|加载|展开|原文)[^。，]{0,8}|继续(?:阅读|浏览|看)[^。，]{0,8}|(?:剩余|还有|余下)\s*\d[^。]{0,24}|"
    r"read (?:the )?(?:full|more|rest)\b.{0,20}|show (?:more|all)|continue (?:reading|in)\b.{0,20}|load more|open in.{0,20}|see more|\d+ ?% (?:left|remaining)|"
    r"続きを?読む.{0,10}|もっと(?:見る|読む)|残り.{0,12}|全文を.{0,8})[\s.…↓»>→]*$",
    re.I,
)
#: Announcements of a next part, which end a whole text.
NEXT_PART = re.compile(r"^\W*(?:未完待续|待续|下(?:篇|期|回|集|章|周|一(?:篇|期|回|章|部分))|つづく|続く|次回|to be continued|next (?:week|part|time|chapter|month)|in the next)", re.I)
#: A line set between two dashes, as sites set their mottoes.
FRAMED = re.compile(r"^[—–-]\s*[^—–\s].*[^—–\s]\s*[—–-]$")
SIGNATURE = re.compile(r"^\s*(?:——|―|--|—)\s*\S")
#: Frequent function words, by script.
FUNCTION_CJK = "的了在是和把为之のをにがはとる"
FUNCTION_WORDS = (" the ", " of ", " and ", " a ", " to ", " in ", " was ", " is ", " that ", " и ", " на ", " не ", " в ", " le ", " la ", " de ", " et ", " der ", " die ", " und ", " o ", " e ")
FUNCTION_ASCII = tuple(w for w in FUNCTION_WORDS if w.isascii())

COLUMNS = ("line_no", "flags", "width", "ending", "tail", "chars", "bytes", "line_key", "mask_key")
#: Flags that settle the label of a line whatever its counts.
SETTLED = CODE | PAGE | NOSCRIPT | UNFOLD | IMAGE | ITEM | CRUMB | CHROME
FEATURES = (
    "article_id long, site_key long, page_key long, finals array<long>, lines array<struct<line_no:int,flags:int,width:int,ending:int,"
    "tail:long,chars:int,bytes:int,line_key:long,mask_key:long>>"
)
CUT_MARK = re.compile(r"\s(?:\.\.\.|…)\s*$")
TRAILING = ("……", "......", "⋯⋯")


def _ending(text: str) -> int:
    """Whether a text ends a sentence, trails off in dots, or breaks off.

    A mark that goes on (comma, colon, dash, opening bracket) breaks off like a word; any other sign,
    such as a closing quote or a smiley, ends the sentence.
    """
    t = text.rstrip()
    if t.endswith(TRAILING):
        return END_STOP
    if t.endswith(("…", "...", "⋯")):
        return END_CUT if CUT_MARK.search(text) else END_DOTS
    last = t[-1:]
    return END_WORD if last.isalnum() or last in GOES_ON else END_STOP


def _notice(text: str) -> bool:
    if NOTICE_SIGNS.search(text) and NOTICE.search(text):
        return True
    if not text.isascii() and (NOTICE_UNSPACED.search(text) or NOTICE_FIRST.match(text)):
        return True
    return FRAMED.match(text) is not None


def _tail(text: str) -> str:
    """The last word of a text, or its last two characters where it is unspaced."""
    i = len(text)
    while i and not text[i - 1].isalnum():
        i -= 1
    if i and text[i - 1] >= "぀":
        return text[max(0, i - 2) : i]
    k = i
    while k and (text[k - 1].isalnum() or text[k - 1] in "’'") and text[k - 1] < "぀":
        k -= 1
    return text[k:i].lower()


def _closing(raw: str) -> int:
    """Length of the end tags, dots and blanks at the end of a line."""
    t = raw
    while True:
        cut = t.rstrip(" \t\r\n\u3000\xa0.…")
        if cut.endswith(">") and (m := CLOSING.search(cut, max(0, len(cut) - 24))):
            cut = cut[: m.start()]
        if len(cut) == len(t):
            return len(raw) - len(t)
        t = cut


def _prose(text: str) -> bool:
    """Stop-word density of running text.  Words are counted until there are enough."""
    if not text.isascii() and max(text) >= "぀":
        left = len(text)
        for c in FUNCTION_CJK:
            left -= 25 * text.count(c)
            if left <= 0:
                return True
        return False
    padded = f" {text.lower()} "
    words, times = (FUNCTION_ASCII, 12) if text.isascii() else (FUNCTION_WORDS, 15)
    left = text.count(" ")
    if left <= 0:
        return True
    for w in words:
        left -= times * padded.count(w)
        if left <= 0:
            return True
    return False


def _matched(wanted: set[str], texts: list[str]) -> bool:
    """Whether any of the terms stands in the texts."""
    whole = "\n".join(texts).lower()
    return any(t in whole for t in wanted)


def _about(title: str, prose: list[str]) -> bool:
    """Whether a title that begins like a message is that of prose which goes on about it: half of the terms
    that follow the message stand in long lines of the body."""
    if not prose or PLACEHOLDER.search(title):
        return False
    rest = message(title)
    asked = terms(rest) if rest else set()
    whole = "\n".join(prose)
    return bool(asked) and 2 * sum(t in whole for t in asked) >= len(asked)


def slug_terms(url: str | None) -> set[str]:
    """Terms of the last part of an address that has words."""
    path = (url or "").split("?")[0].split("#")[0].rsplit("/", 1)[-1]
    return terms(path.rsplit(".", 1)[0].replace("-", " ").replace("_", " "))


def line_features(raw: str, text: str, in_list: bool, in_code: bool, in_page_tag: bool, noscript: bool, tag: str) -> tuple:
    """What a line shows by itself, wherever it stands: its width, flags, ending and tail word; the tail again if it
    ends a sentence; the length of what stands after a cut; the text to be counted, and its key where the site's
    name isn't in it."""
    w = width(text)
    flags = (LIST if in_list else 0) | (CODE if in_code else 0) | (PAGE if in_page_tag else 0) | (NOSCRIPT if noscript else 0)
    if tag[:1] == "h" and tag[1:].isdigit():
        flags |= HEAD
    elif tag == "blockquote":
        flags |= QUOTE
    elif tag in ("table", "th"):
        flags |= TABLE
    elif tag == "li":
        flags |= ITEM
    if "<a" in raw:
        linked = sum(len(x) for x in HREF.findall(raw))
        if linked * 2 > len(text):
            flags |= LINKED
    residue, weak = line_residue(raw, text, in_code, in_list)
    said = w > MESSAGE_WIDTH and not (residue or in_code or in_list) and says_message(text)
    flags |= (RESIDUE if residue else 0) | (WEAK if weak else 0) | (SAID if said else 0)
    ending = _ending(text)
    if w <= PROMPT_WIDTH and UNFOLDS.match(text):
        flags |= UNFOLD
    elif w <= NOTICE_WIDTH and not flags & (LIST | CODE | ITEM | HEAD) and _notice(text):
        flags |= CHROME
    elif (w >= LONG_WIDTH or (w >= SENTENCE_WIDTH and ending != END_WORD)) and _prose(text):
        flags |= LONG
    if w <= LINE_WIDTH and not flags & (LIST | CODE | ITEM) and (
        ((">" in text or "»" in text or "›" in text or "→" in text) and CRUMBS.search(text)) or (not flags & LONG and MENU.match(text))
    ):
        flags |= CRUMB
    if w <= SET_WIDTH and "<" in raw and not flags & (LIST | CODE | ITEM) and ((("class" in raw or "id=" in raw) and ASIDE.search(raw)) or (ending == END_WORD and BARE.match(raw))):
        flags |= CHROME
    if w <= LINE_WIDTH and ending == END_WORD and "<" in raw and not flags & (LIST | CODE | ITEM | HEAD) and APART.match(raw):
        flags |= STYLED
    if w <= LINE_WIDTH and not flags & (LIST | CODE | ITEM | LONG):
        if NEXT_PART.search(text):
            flags |= NEXT
        if SIGNATURE.match(text):
            flags |= SIGN
    tail = final = same = mask = None
    closing = 0
    if ending != END_STOP or (w >= SENTENCE_WIDTH and not flags & (ITEM | CODE)):
        word = _tail(text)
        tail = key(word)
        if ending != END_STOP:
            closing = _closing(raw)
        elif word and not word[-1].isdigit():  # a number may end anywhere
            final = tail
    if flags & (WEAK | LIST) or not flags & SETTLED:
        same = same_text(text)
        if not flags & (LIST | HEAD):  # headings and list items of articles are alike on many sites
            mask = _mask_key(same)
    return w, flags, ending, tail, final, closing, same, mask


def _mask_key(masked: str) -> int:
    if quoted := QUOTED.search(masked):
        masked = masked.replace(quoted[0], "\x02")
    return key(masked)


#: Lines up to this length are looked up if they came before, as those of a site do; so many are kept.
KEPT_LENGTH, LINES_KEPT = 240, 1 << 14
_kept_line = lru_cache(maxsize=LINES_KEPT)(line_features)


def features(article_id, url, title, content, lines=None) -> Iterator[tuple]:
    """The features of one article, with a dict for each of its lines."""
    for *keys, rows in feature_rows(article_id, url, title, content, lines):
        yield *keys, [dict(zip(COLUMNS, r)) for r in rows]


def feature_rows(article_id, url, title, content, lines=None) -> Iterator[tuple]:
    """The features of one article (``lines`` if they were read already): its keys and a row for the title (line_no -1) and for every line that
    shows text or an image.  Only lines on which the counts can have a say carry keys to be counted."""
    site, page = site_and_page(url)
    site_key, page_key, name = (key(site), key(page), brand(site)) if site else (None, None, None)
    plain_title = " ".join(title.split()) if title else ""
    content = content or ""
    shown = {}
    finals = set()
    raws = content.split("\n")
    ends, at = [], 0
    for raw in raws:
        at += len(raw) + 1
        ends.append(at - 1)
    flat, read, size_read = content.isascii(), 0, 0
    open_end = not content.rstrip().endswith(">")
    last_no = len(raws) - 1
    while last_no > 0 and not raws[last_no].strip():
        last_no -= 1
    lines = lines_of(content) if lines is None else lines
    for no, raw, text, *where in lines:
        w, flags, ending, tail, final, closing, same, mask = (_kept_line if len(raw) <= KEPT_LENGTH else line_features)(raw, text, *where)
        chars = size = 0
        if final is not None:
            finals.add(final)
        elif ending != END_STOP:
            chars = ends[no] - closing
            if not flat:
                size_read += len(content[read:chars].encode("utf-8", "replace"))
                read = chars
            size = chars if flat else size_read
        if no == last_no:
            flags |= (OPEN if open_end else 0) | LAST
        line_key = None
        if not site or flags & OPEN or same is None:  # beginnings of cut sentences are alike
            mask = None
        else:
            line_key = key(site, same)
            if mask is not None and name and name in text:
                mask = _mask_key(same_text(text.replace(name, "\x01")))
        shown[no] = (no, flags, w, ending, tail, chars, size, line_key, mask)
    if "<" in content and MEDIA.search(content):
        for no, raw in enumerate(raws):
            if no not in shown and "<" in raw and MEDIA.search(raw):
                shown[no] = (no, IMAGE, 0, 0, None, 0, 0, None, None)
    own = [x.text for x in lines if not shown[x.no][1] & (CHROME | CRUMB | PAGE | NOSCRIPT | UNFOLD) and not (plain_title and plain_title in x.text)]
    flags = TITLE | (RESIDUE if is_residue(plain_title) and not _about(plain_title, [x.text.lower() for x in lines if shown[x.no][1] & LONG]) else 0) | (MATCHED if _matched(terms(plain_title) | slug_terms(url), own) else 0)
    out = [(-1, flags, len(plain_title), 0, key(plain_title) if plain_title else None, 0, 0, None, None), *shown.values()]
    yield article_id, site_key, page_key, sorted(finals), out


def page_features(articles: DataFrame) -> DataFrame:
    """One row per row of ``articles``."""
    return map_rows(articles.select("article_id", "url", "title", "content_html"), lambda: feature_rows, FEATURES)


#: Least pages and least share of a site's pages on which a notice of that site stands; share for headings and
#: list items, which articles of one site have in common.
SITE_PAGES, SITE_SHARE, SET_SHARE = 4, 0.02, 0.1
#: Least number of sites on which a notice stands with the site's name masked, and of different titles it stands
#: under: the lines of an article that many sites copied stand under one or two.  Sentences of running text may
#: agree by chance and need more sites.
HOSTS, PROSE_HOSTS, TITLES = 4, 12, 4

CHROME_LABEL, BODY_LABEL, UNSURE = 1, 2, 0


def first_pass(flags: int, w: int, on_site: bool, on_hosts: bool) -> int:
    """Label of a line by itself."""
    if flags & (PAGE | NOSCRIPT | UNFOLD):
        return CHROME_LABEL
    if flags & (CODE | IMAGE):
        return BODY_LABEL
    if flags & NEXT and not flags & (ITEM | LINKED | LIST):
        return BODY_LABEL
    if on_site or on_hosts:
        return CHROME_LABEL
    if flags & (LIST | HEAD):
        return BODY_LABEL
    if flags & (ITEM | CRUMB):
        return CHROME_LABEL
    if flags & CHROME:
        return CHROME_LABEL
    if flags & (LONG | QUOTE | TABLE | SIGN):
        return BODY_LABEL
    if flags & (LINKED | STYLED):
        return CHROME_LABEL
    if w >= LONG_WIDTH:
        return BODY_LABEL
    return UNSURE


def second_pass(labels: list[int]) -> list[int]:
    """Undecided lines take the label of the nearest decided line, of two equally near ones that of the body.

    Where no line is decided all are the page's.
    """
    n = len(labels)
    far = n + 1
    before, last = [], -far
    for i, x in enumerate(labels):
        if x:
            last = i
        before.append(last)
    out, after = list(labels), n + far
    for i in range(n - 1, -1, -1):
        if labels[i]:
            after = i
            continue
        left = labels[before[i]] if before[i] >= 0 else UNSURE
        right = labels[after] if after < n else UNSURE
        if left and right and left != right:
            near, other = i - before[i], after - i
            out[i] = BODY_LABEL if near == other else left if near < other else right
        else:
            out[i] = left or right or CHROME_LABEL
    return out


def response(shown: list[tuple[tuple, int]], matched: bool) -> bool:
    """Whether a page without long text of its own is a response in place of an article.

    A sign in a line is confirmed where the line stands on many hosts, or where it is a message within a long
    line.  Without a sign, a line is a response if many hosts show it but the pages of the site don't, it
    isn't set apart as the site's, and no term of address and title stands in the body.
    """
    if any(x == BODY_LABEL and r[1] & LONG and not r[1] & (WEAK | SAID) and not r[5] for r, x in shown):
        return False
    if any((r[1] & WEAK and r[5]) or r[1] & SAID for r, _ in shown):
        return True
    return not matched and any(
        r[5] and not r[4] and not r[1] & (CHROME | CRUMB | ITEM | LIST | HEAD | PAGE | NOSCRIPT | UNFOLD | LINKED | STYLED | NEXT | SIGN | CODE) for r, _ in shown
    )


def decide(lines: list[tuple]) -> tuple[bool, list[tuple[int, int]], tuple[int, int | None, int, int]]:
    """(residue page, [(line_no, label)], (verdict, tail, chars, bytes)) of one article.

    ``lines``: (line_no, flags, width, ending, on_site, on_hosts, tail, chars, bytes), in any order,
    repeats allowed.  The verdict on the end of the body is one of WHOLE, CUT and OPEN_QUESTION.
    """
    rows = sorted({r[0]: r for r in lines}.values(), key=lambda r: r[0])
    residue = any(r[1] & RESIDUE for r in rows)
    body = [r for r in rows if r[0] >= 0]
    labels = second_pass([first_pass(r[1], r[2], r[4], r[5]) for r in body])
    if not residue:
        shown = [(r, x) for r, x in zip(body, labels) if not r[1] & IMAGE]
        matched = any(r[1] & MATCHED for r in rows if r[0] < 0)
        residue = response(shown, matched)
    return residue, [(r[0], x) for r, x in zip(body, labels) if not r[1] & IMAGE], end_of_body(body, labels)


WHOLE, CUT, OPEN_QUESTION = 0, 1, 2


def end_of_body(body: list[tuple], labels: list[int]) -> tuple[int, int | None, int, int]:
    """Verdict on the last line of the body, with its tail word and its distance from the start of the field."""
    at = max((i for i, x in enumerate(labels) if x == BODY_LABEL), default=None)
    if at is None:
        return WHOLE, None, 0, 0
    _, flags, _, ending, _, _, tail, chars, size = body[at]
    unfold = any(r[1] & UNFOLD for r in body[at + 1 :])
    if ending in (END_STOP, END_NONE):
        return WHOLE, None, chars, size
    if flags & OPEN or ending == END_CUT:
        return CUT, tail, chars, size
    if flags & (CODE | IMAGE | NEXT | SIGN | HEAD | TABLE) or (flags & LIST and not (flags & LAST or unfold)):
        return WHOLE, None, chars, size
    return CUT if unfold else OPEN_QUESTION, tail, chars, size


JUDGED = "article_id long, site_key long, page_key long, residue boolean, chrome array<int>, verdict int, tail long, chars int, bytes int"


#: What decide() needs of the lines, besides the counts.
LINE_FIELDS = ("line_no", "flags", "width", "ending", "tail", "chars", "bytes")


def _decide_kernel():
    def kernel(article_id, site_key, page_key, on_site, on_hosts, *fields):
        s, h = set(on_site or ()), set(on_hosts or ())
        rows = [(n, f, w, e, n in s, n in h, t, c, b) for n, f, w, e, t, c, b in zip(*fields)]
        residue, labels, (verdict, tail, chars, size) = decide(rows)
        yield article_id, site_key, page_key, residue, [n for n, x in labels if x == CHROME_LABEL], verdict, tail, chars, size

    return kernel


def widely_shown(pages: DataFrame) -> DataFrame:
    """``article_id, on_site, on_hosts``: numbers of the lines that stand widely on their site, and on many sites.

    Each count first makes (key, page) or (key, site) pairs distinct, which combines before the shuffle.
    Only keys that stand widely are kept, so the joined sides are small and Spark broadcasts them when
    their measured size allows it; otherwise both are shuffled and hot keys are split at run time.
    """
    hosted = pages.where("site_key is not null")
    each = hosted.select("article_id", "site_key", "page_key", F.col("lines")[0]["tail"].alias("title_key"), F.explode("lines").alias("x")).select(
        "article_id", "site_key", "page_key", "title_key", "x.line_no", "x.line_key", "x.mask_key", (F.col("x.flags").bitwiseAND(LIST | HEAD) != 0).alias("set"),
        (F.col("x.flags").bitwiseAND(LONG) != 0).alias("prose"),
    )
    per_site = hosted.select("site_key", "page_key").distinct().groupBy("site_key").agg(F.count(F.lit(1)).alias("n_pages"))
    on_site = (
        each.where("line_key is not null").groupBy("site_key", "line_key", "page_key").agg(F.bool_and("set").alias("set"))
        .groupBy("site_key", "line_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("set").alias("set")).where(F.col("n") >= SITE_PAGES)
        .join(per_site, "site_key").where(F.col("n") >= F.when(F.col("set"), SET_SHARE).otherwise(SITE_SHARE) * F.col("n_pages")).select("line_key")
    )
    on_hosts = (
        each.where("mask_key is not null").groupBy("mask_key", "site_key").agg(F.min("title_key").alias("a"), F.max("title_key").alias("b"), F.bool_and("prose").alias("prose"))
        .groupBy("mask_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("prose").alias("prose"), F.approx_count_distinct("a").alias("na"), F.approx_count_distinct("b").alias("nb"))
        .where((F.col("n") >= F.when(F.col("prose"), PROSE_HOSTS).otherwise(HOSTS)) & (F.greatest("na", "nb") >= TITLES)).select("mask_key")
    )
    none = F.lit(None).cast("int")
    hits = (
        each.join(on_site, "line_key", "left_semi").select("article_id", F.col("line_no").alias("s"), none.alias("h"))
        .unionByName(each.join(on_hosts, "mask_key", "left_semi").select("article_id", none.alias("s"), F.col("line_no").alias("h")))
    )
    return hits.groupBy("article_id").agg(F.collect_set("s").alias("on_site"), F.collect_set("h").alias("on_hosts"))


def judged(pages: DataFrame) -> DataFrame:
    """One row per article: residue or not, its lines that are the page's, the verdict on the end of its body."""
    marked = pages.join(widely_shown(pages), "article_id", "left")
    fields = [F.col("lines")[name].alias(name) for name in LINE_FIELDS]  # arrays of numbers cost less than arrays of structs
    return map_rows(marked.select("article_id", "site_key", "page_key", "on_site", "on_hosts", *fields), _decide_kernel, JUDGED)


def analysed(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, judgement) per article.  The features are written once and read by every later step."""
    pages = cut_lineage(page_features(articles))
    return pages, judged(pages)


def residue_articles(articles: DataFrame) -> DataFrame:
    """``article_id`` of articles that show template residue, filler, an error or a demand for scripts."""
    return analysed(articles)[1].where("residue").select("article_id")


def page_lines(articles: DataFrame) -> DataFrame:
    """``article_id, line_no`` of the lines with visible text that are not the article's own body."""
    _, verdicts = analysed(articles)
    return verdicts.where("not residue").select("article_id", F.explode("chrome").alias("line_no"))


#: A length is a limit where so many pages of a site end at it exactly, and so many times more than at lengths near it.
SPIKE_PAGES, SPIKE_TIMES, SPIKE_NEAR = 3, 8, 64
#: A word can end a sentence if it does so on this share of the pages that show it.
FINAL_SHARE = 0.05
#: Places of the bit map of the pages with several clips that tasks receive.
PAGE_BITS = 23
#: Words that a task counts before it passes the counts on.
WORDS_HELD = 1 << 18
#: Pairs of characters that it holds before it counts them.
PAIRS_HELD = 1 << 20
#: What ends a sentence inside a line, as does a full stop where a blank or nothing follows.
STOPS = "。！？!?．｡"
LINE_STOPS = STOPS + "."


def length_spikes(ends: DataFrame) -> DataFrame:
    """``site_key, unit, size``: lengths, in characters or bytes, at which texts of a site stop too often;
    under the null ``site_key`` those of all sites together, for limits that sites share.

    The histogram has one bar per length and counts pages, so that clips of one page count once.  A bar
    is a spike if it holds SPIKE_TIMES the mean of its neighbourhood.
    """
    sizes = ends.where("site_key is not null and verdict <> 0").select(
        "site_key", "page_key", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s")
    )
    pages = sizes.select("site_key", "page_key", "s.unit", "s.size").distinct()
    own = pages.groupBy("site_key", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    every = own.groupBy("unit", "size").agg(F.sum("n").alias("n")).select(F.lit(None).cast("long").alias("site_key"), "unit", "size", "n")
    bars = own.unionByName(every)
    near = W.partitionBy("site_key", "unit").orderBy("size").rangeBetween(-SPIKE_NEAR, SPIKE_NEAR)
    around = F.sum("n").over(near) - F.col("n")
    return (
        bars.withColumn("around", around)
        .where((F.col("n") >= SPIKE_PAGES) & (F.col("n") * 2 * SPIKE_NEAR >= SPIKE_TIMES * F.col("around")))
        .select("site_key", "unit", "size", F.col("n").alias("n_pages"))
    )


def tail_words(text: str) -> set[str]:
    """Every word of a line that would be its tail if the line broke off there."""
    words = spaced_words(text.lower()) if min(text) < "\u3040" else set()
    if max(text) >= "\u3040":
        words.update(a + b for a, b in {*zip("\n" + text, text)} if b >= "\u3040" and b.isalnum())
        if text[0] >= "\u3040" and text[0].isalnum():
            words.add(text[0])
    return words


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, first = [], 0
    for i, c in enumerate(codes):
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{codes[first]:08x}-\\U{c:08x}")
            first = i + 1
    return "".join(out)


#: Runs of letters, digits and apostrophes of spaced scripts.
SPACED = re.compile("[" + _ranges([c for c in range(0x3040) if chr(c).isalnum() or chr(c) in "'’"]) + "]+")


def spaced_words(text: str) -> set[str]:
    """Words of spaced scripts in a text, as _tail() takes them: apostrophes at their end are left out."""
    words = set(SPACED.findall(text))
    if "'" in text or "’" in text:
        words = {w.rstrip("'’") if w[-1] in "'’" else w for w in words}
        words.discard("")
    return words


UNSPACED_SIGN, DIGIT, STOP, FULL_STOP, BLANK, ANY_STOP = 1, 2, 4, 8, 16, 12


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """What each code point is: a letter or digit of unspaced scripts and of all blocks after them, a digit, a stop, a blank."""
    every = "".join(map(chr, range(0x40000)))  # no later plane has letters, digits or blanks
    table = np.zeros(0x110000, np.uint8)
    table[[m.start() for m in re.finditer(r"\s", every)]] = BLANK
    table[0x3040:][[m.start() for m in re.finditer(r"[^\W_]", every[0x3040:])]] = UNSPACED_SIGN
    table[[m.start() for m in re.finditer(r"\w", every) if m[0].isdigit()]] |= DIGIT
    for x in STOPS:
        table[ord(x)] |= STOP
    table[ord(".")] |= FULL_STOP
    return table


def _once(codes: np.ndarray) -> np.ndarray:
    """Each code once, in order."""
    if len(codes) < 2:
        return codes
    codes = np.sort(codes)
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))]


def _code(word: str) -> int | str:
    """A word as a key: the code points of its last two characters where it is unspaced, else itself."""
    return (ord(word[-2]) if len(word) > 1 else 0) << 21 | ord(word[-1]) if word[-1:] >= "\u3040" else word


def _word(code: int | str) -> str:
    if isinstance(code, str):
        return code
    return (chr(code >> 21) if code >> 21 else "") + chr(code & 0x1FFFFF)


NO_PAIRS = np.zeros(0, np.int64)


def page_words(lines: list) -> tuple[set[int | str], set[int | str]]:
    """The words that long lines of a page show, as tail_words() has them, and those that end a sentence there; as
    keys of _code()."""
    words, ends, pairs, end_pairs = words_and_pairs(lines)
    return words.union(pairs.tolist()), ends.union(end_pairs.tolist())


def words_and_pairs(lines: list) -> tuple[set[str], set[str], np.ndarray, np.ndarray]:
    """page_words(): words and ends of spaced scripts, then those of unspaced ones, each once.  The lines are read together."""
    texts = [x.text for x in lines if not (x.in_code or x.in_page_tag or width(x.text) < SENTENCE_WIDTH)]
    if not texts:
        return set(), set(), NO_PAIRS, NO_PAIRS
    whole = "\n".join(texts)
    codes = np.frombuffer(("\n" + whole + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    signs = _signs()[codes]
    left, right = codes[:-2], codes[1:-1]
    pairs = np.where(left == 10, 0, left) << 21 | right
    unspaced = (signs[1:-1] & UNSPACED_SIGN) != 0
    stops = np.flatnonzero(signs[2:-1] & ANY_STOP) + 1  # places in the text; a stop that begins it ends nothing
    kinds, before = signs[1 + stops], signs[stops]
    stops = stops[((kinds & STOP) != 0) & ((before & STOP) == 0) | ((kinds & FULL_STOP) != 0) & ((signs[2 + stops] & BLANK) != 0)]
    before = signs[stops]
    after_pair = (before & UNSPACED_SIGN) != 0
    final = {_tail(whole[max(at - 80, 0) : at].rpartition("\n")[2]) for at in stops[~after_pair].tolist()}
    final.update(_tail(x) for x in texts if not (x[-1] in LINE_STOPS and x[-2:-1].isalnum()) and _ending(x) == END_STOP)  # the others stand before a stop
    other = {_code(w) for w in final if w and not w[-1].isdigit()}
    ends = {w for w in other if isinstance(w, str)}
    end_pairs = _once(np.concatenate((pairs[stops[after_pair & ((before & DIGIT) == 0)] - 1], np.fromiter((w for w in other if not isinstance(w, str)), np.int64))))
    return spaced_words(whole.lower()) | ends, ends, _once(np.concatenate((pairs[unspaced], end_pairs))), end_pairs


def _page_kernel():
    def kernel(url):
        page = site_and_page(url)[1]
        if page:
            yield (key(page),)

    return kernel


def clipped_again(articles: DataFrame) -> bytes:
    """Bit map of the pages that have several clips, of a fixed size; other pages may share their bits."""
    mask = (1 << PAGE_BITS) - 1
    pages = map_rows(articles.select("url"), _page_kernel, "page long").groupBy("page").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.col("page").bitwiseAND(mask)
    rows = pages.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast((page & {mask}) & 63 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    bits = bytearray(1 << (PAGE_BITS - 3))
    for w, v in rows.toLocalIterator():
        bits[8 * w : 8 * w + 8] = (v & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    return bytes(bits)


WORDS = "word_page long, shown array<struct<tail:long,final:boolean>>, words array<struct<tail:long,n:long,n_final:long>>"


def features_and_words(articles: DataFrame) -> DataFrame:
    """Features as of page_features(), and what is needed to tell which words end sentences.

    The words of a page with one clip are added up within the task and come as rows of their own, with
    ``words`` and nothing else.  A page with several clips must count once: its clips carry their words in
    ``shown``, to be made distinct by ``word_page``; so do clips without a page, by their content.
    """
    again = articles.sparkSession.sparkContext.broadcast(clipped_again(articles))  # 2**PAGE_BITS bits
    out = _parse_datatype_string(f"{FEATURES}, {WORDS}")
    target = to_arrow_schema(out)
    no_lines = (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shown_in, final_in = again.value, Counter(), Counter()
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        known: dict[int | str, int] = {}

        def number(word: int | str) -> int:
            if word not in known:
                if len(known) >= WORDS_HELD:
                    known.clear()
                known[word] = key(_word(word))
            return known[word]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

        def add_held() -> None:
            for counts, arrays in zip((shown_in, final_in), held.values()):
                if arrays:
                    pairs, n = np.unique(np.concatenate(arrays), return_counts=True)
                    counts.update(dict(zip(pairs.tolist(), n.tolist())))
                    arrays.clear()

        def counted() -> pa.RecordBatch:
            row = (*no_lines, None, None, [(key(_word(w)), n, final_in[w]) for w, n in shown_in.items()])
            shown_in.clear()
            final_in.clear()
            return batch_of([row])

        def read(batch: pa.RecordBatch) -> Iterator[tuple]:
            n_held = 0
            for article_id, url, title, content in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(content)
                row = next(feature_rows(article_id, url, title, content, lines))
                words, ends, pairs, end_pairs = words_and_pairs(lines)
                page = row[2]
                at = (page or 0) & ((1 << PAGE_BITS) - 1)
                if page is None or bits[at >> 3] >> (at & 7) & 1:
                    ends.update(end_pairs.tolist())
                    shown = [(number(w), w in ends) for w in (*words, *pairs.tolist())]
                    yield *row, page if page is not None else key(content or ""), shown, None
                    continue
                shown_in.update(words)
                final_in.update(ends)
                held[0].append(pairs)
                held[1].append(end_pairs)
                n_held += len(pairs)
                if n_held >= PAIRS_HELD:
                    add_held()
                    n_held = 0
                yield *row, None, None, None
            add_held()

        for batch in batches:
            with no_cycles():
                rows = list(read(batch))
                out_batch = batch_of(rows) if rows else None
                del rows
            if out_batch is not None:
                yield out_batch
            if len(shown_in) >= WORDS_HELD:
                yield counted()
        if shown_in:
            yield counted()

    ship_package(articles.sparkSession)
    return spread(articles.select("article_id", "url", "title", "content_html")).mapInArrow(run, out)


def final_words(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """``tail``: those of ``asked`` that end a sentence on FINAL_SHARE of the distinct pages that show them.

    ``pages`` comes from features_and_words().
    """
    tails = asked.where("tail is not null").select("tail").distinct()
    once = pages.where("words is not null").select(F.explode("words").alias("w")).select("w.tail", "w.n", "w.n_final")
    again = pages.where("shown is not null").select("word_page", F.explode("shown").alias("w")).select("w.tail", "word_page", "w.final")
    distinct = again.join(tails, "tail", "left_semi").groupBy("tail", "word_page").agg(F.max("final").alias("final"))
    each = distinct.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.count_if("final").alias("n_final"))
    return (
        once.unionByName(each).groupBy("tail").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))
        .where(F.col("n_final") >= FINAL_SHARE * F.col("n")).join(tails, "tail", "left_semi").select("tail")
    )


def cut_verdicts(articles: DataFrame) -> DataFrame:
    """One row per article that is no residue page: ``article_id, site_key, is_cut``.

    A body is cut if its last line shows it by itself (an open element, a mark of omission after a
    blank, a prompt to unfold the rest), or if it breaks off without terminal punctuation and either
    stops at a length spike of its site or at a word that seldom ends a sentence where it stands in the corpus.
    """
    pages = cut_lineage(features_and_words(articles))
    verdicts = judged(pages.where("words is null"))
    ends = cut_lineage(verdicts.where("not residue").select("article_id", "site_key", "page_key", "verdict", "tail", "chars", "bytes"))
    finals = final_words(pages, ends.where(F.col("verdict") == OPEN_QUESTION)).withColumn("final", F.lit(True))
    spikes = length_spikes(ends)
    shared = spikes.where("unit = 'chars' and site_key is null").select(F.col("size").alias("chars"), F.lit(True).alias("spike_a"))
    spikes = spikes.where("site_key is not null")
    by_chars = spikes.where("unit = 'chars'").select("site_key", F.col("size").alias("chars"), F.lit(True).alias("spike_c"))
    by_bytes = spikes.where("unit = 'bytes'").select("site_key", F.col("size").alias("bytes"), F.lit(True).alias("spike_b"))
    asked = (
        ends.where(F.col("verdict") == OPEN_QUESTION)
        .join(finals, "tail", "left").join(by_chars, ["site_key", "chars"], "left").join(by_bytes, ["site_key", "bytes"], "left")
        .join(shared, "chars", "left")
        .select("article_id", "site_key", (F.col("final").isNull() | F.col("spike_c").isNotNull() | F.col("spike_b").isNotNull() | F.col("spike_a").isNotNull()).alias("is_cut"))
    )
    known = ends.where(F.col("verdict") != OPEN_QUESTION).select("article_id", "site_key", (F.col("verdict") == CUT).alias("is_cut"))
    return known.unionByName(asked)


def truncation_report(articles: DataFrame) -> DataFrame:
    """Per site: articles judged, how many are cut and their share.  Articles without a host stand under null."""
    sites = map_rows(articles.select("url").distinct(), _site_kernel, "site_key long, site string").distinct()
    counts = cut_verdicts(articles).groupBy("site_key").agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if("is_cut").alias("n_cut")
    )
    return counts.join(sites, "site_key", "left").select("site", "n_articles", "n_cut", (F.col("n_cut") / F.col("n_articles")).alias("cut_share"))


def _site_kernel():
    def kernel(url):
        site, _ = site_and_page(url)
        if site is not None:
            yield key(site), site

    return kernel
