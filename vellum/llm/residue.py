"""Problem 3: detectors of template residue, filler, error messages and demands for scripts in one line.

The patterns look at form where there is one (placeholder syntax, repeated units, status codes) and at
the wording of messages otherwise.  A message that is its whole line decides by itself.  A longer line
that only holds one, in any of its sentences, is a sign that the page has to confirm: by the lack of other
long text, or by how many hosts show the line.  Code that shows such things stands in code elements,
which are left out here.  The word lists are this module's own.
"""

from __future__ import annotations

import html
import re

from .web import TAG

INLINE_CODE = re.compile(r"<(code|kbd|samp|tt)\b[^>]*>.*?</\1\s*>|`[^`]*`", re.I | re.S)

#: Unfilled placeholders: the syntaxes of common template languages around a name.
PLACEHOLDER = re.compile(
    r"""
    \{\{\{?\s*[A-Za-z_][\w.\-]*(?:\s*\|\s*\w+)?\s*\}?\}\}
    | \{%-?\s*\w+[^%{}]*%\}
    | [$\#]\{\s*[A-Za-z_][\w.]*\s*\}
    | <%[=\-]?[^<>]*%>
    | (?<![\w%])%[A-Z][A-Z_]{2,}%(?!\w)
    | @@[A-Z][A-Z_]*@@
    | (?<![\w])__[A-Z][A-Z_]*__(?![\w])
    | \[\[[A-Z][A-Z_]*\]\]
    | (?<![\\\w^}{$\#])\{[a-z][a-z_]*\}(?!\})
    | \[(?:[A-Z]+\ )+HERE\] | \[(?:YOUR|INSERT|ENTER|ADD)(?:\ [A-Z]+)+\] | <<[A-Z][A-Z_\ ]*>>
    | \[(?:在此|此处|在这里)[^\[\]]{1,12}\]
    | %\([A-Za-z_]\w*\)[sd](?![\w])
    | \[object\ Object\]
    """,
    re.X,
)
PLACEHOLDER_SIGNS = re.compile(r"[{\[%@]|__[A-Z]|<<")

#: The words of the usual filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split()
)
UNIT = re.compile(r"^(.{2,24}?)(?:[\s,，.。、]*\1){2,}[\s,，.。、0-9]*(?:\w+ ?){0,2}$", re.S)

#: Wording of filler, errors and notices, each at the start of its sentence.
MESSAGE = re.compile(
    r"""^(?:
    # filler
    your\ (?:text|title|content)\ (?:goes\ )?here | insert\ (?:paragraph|text|title)\b.{0,12}\bhere | todo:\ | tbd\b
    | (?:asdf|qwer)\b | placeholder\ (?:text|title) | untitled(?:\ document)?(?:\ \d+)?$ | new\ document(?:\ \d+)?$
    | (?:这里是)?占位(?:段落|文字|内容) | 此处填写 | 请(?:输入|填写)(?:标题|正文|内容) | (?:示例|标题|测试)(?:文字|文本|标题)
    | (?:正文|标题)测试 | 无标题(?:文档)? | 未命名(?:文档)? | ダミーテキスト | (?:タイトル|本文)を入力 | 無題(?:ドキュメント)?
    # errors
    | (?:(?:http\ )?error\ )?[45]\d\d(?:\ |:|\ -|$)[^，。]{0,50}(?:not\ found|gateway|unavailable|forbidden|error|timeout|denied|不存在|错误|禁止)
    | (?:http\ )?error\ \d+\b | (?:internal\ )?server\ error | bad\ gateway | service\ (?:temporarily\ )?unavailable | page\ not\ found
    | access\ denied | access\ to\ this\ page | the\ connection\ (?:timed\ out|was\ reset) | (?:sorry,?\ |oops!?,?\ )?something\ went\ wrong
    | this\ (?:post|page|article|content)\ is\ (?:no\ longer|not)\ available | the\ (?:page|article)\ you
    | too\ many\ requests | your\ session\ has\ expired | (?:undefined|null|nan)(?:[\s,:|/\-]+(?:undefined|null|nan))*$
    | (?:抱歉|对不起)[，,\ ].{0,20}(?:删除|不存在|无法|找不到|出错) | (?:该|此|您访问的|你访问的)?(?:页面|链接|网页|内容)(?:不存在|已失效|已被删除|无法|找不到|出错)
    | (?:该|此|本)(?:文章|内容|页面)(?:审核中|已被?删除|暂时?无法|不存在) | 系统(?:繁忙|错误|异常|维护) | 服务器(?:繁忙|错误|开小差|内部错误)
    | (?:您|你)?(?:没有|暂无|无)(?:访问)?权限 | 登录已(?:过期|失效) | 访问(?:过于频繁|被拒绝|受限) | 请求(?:过于频繁|超时|失败) | 网络(?:错误|异常|超时)
    | (?:お探しの)?ページが見つかり | サーバー(?:が混み合|エラー|内部) | アクセス(?:が拒否|できません|が集中) | エラーが発生
    # scripts and browser checks
    | javascript\ (?:is\ )?(?:required|disabled|must) | this\ (?:page|app|site)\ (?:requires|needs)\ (?:javascript|scripts)
    | just\ a\ moment | checking\ your\ browser | verify(?:ing)?\ (?:that\ )?you\ are | please\ (?:complete|verify|wait\ while) | are\ you\ a\ (?:human|robot)
    | attention\ required | one\ moment,\ please
    | 安全(?:验证|检查) | 请(?:完成|进行|拖动).{0,6}(?:验证|滑块) | 正在(?:检查|验证|检测).{0,8}(?:浏览器|安全)
    | javascript\ ?を有効 | スクリプトを(?:有効|許可) | ブラウザを(?:確認|更新)
    )""",
    re.X | re.I,
)
#: A demand for scripts anywhere in the line.
DEMAND = re.compile(
    r"\b(?:enable|turn on|allow|activate) (?:javascript|scripts?|cookies and javascript)\b"
    r"|(?:需要|请先?|必须)(?:开启|启用|打开|允许).{0,3}(?:脚本|javascript)|浏览器.{0,6}(?:不支持|版本过低|禁用|未启用)",
    re.I,
)
#: A notice about one feature of the page, not about its content.
SIDE_FEATURE = re.compile(r"comment|评论|コメント|留言|播放器|player|share button|分享", re.I)
#: Words that make a line worth a look at how many hosts show it.
WEAK = re.compile(
    r"error|denied|expired|unavailable|timed? ?out|not found|\bjavascript|\bscripts?\b|reload|retry|forbidden|captcha|"
    r"错误|失败|异常|超时|失效|过期|禁止|拒绝|刷新|重试|脚本|验证|无法(?:显示|访问|查看|加载)|エラー|見つかり|失敗|スクリプト|再読み込み",
    re.I,
)

#: The same for text in lower case, written so that the first letters are looked for; and letters that only WEAK takes for others.
WEAK_LOWER = re.compile(
    r"error|denied|expired|unavailable|timed? ?out|not found|j(?<=\bj)avascript|s(?<=\bs)cripts?\b|reload|retry|forbidden|captcha|"
    r"错误|失败|异常|超时|失效|过期|禁止|拒绝|刷新|重试|脚本|验证|无法(?:显示|访问|查看|加载)|エラー|見つかり|失敗|スクリプト|再読み込み"
)
FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")

#: Parts of those words, to look for first.
WEAK_PARTS = (
    "rror", "enied", "xpired", "available", "ime", "ot found", "cript", "eload", "etry", "orbidden", "aptcha",
    "错误", "失败", "异常", "超时", "失效", "过期", "禁止", "拒绝", "刷新", "重试", "脚本", "验证", "无法", "エラー", "見つかり", "失敗", "スクリプト", "再読み込み",
)

WEAK_SPACED = tuple(x for x in WEAK_PARTS if x.isascii())
WEAK_UNSPACED = re.compile("|".join(x for x in WEAK_PARTS if not x.isascii()))

#: A line up to so many columns is a message if it begins with one; a longer one may be prose that mentions it.
MESSAGE_WIDTH = 100
SENTENCE = re.compile(r"[.!?。！？;；]+\s*")
WORD = re.compile(r"[^\W\d_\u3040-\U0010ffff]{4,}")
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]{2,}")


def width(text: str) -> int:
    """Columns, from the bytes of the text: a wide character counts two, an accented letter one and a half."""
    n = len(text)
    return n if text.isascii() else n + (len(text.encode("utf-8", "replace")) - n) // 2


def terms(text: str) -> set[str]:
    """Words of four letters and more, and pairs of characters of unspaced text."""
    found = set(WORD.findall(text.lower()))
    for part in UNSPACED.findall(text):
        found.update(map("".join, zip(part, part[1:])))
    return found


def _filler(text: str) -> bool:
    words = re.findall(r"[a-z]+", text.lower())
    return len(words) >= 4 and sum(w in LOREM for w in words) >= 0.75 * len(words)


def _demand(text: str) -> bool:
    return ("cript" in text or "脚本" in text or "浏览器" in text) and DEMAND.search(text) is not None


def message(text: str) -> str | None:
    """What follows the message a text begins with, empty if it demands scripts; None if it holds none of both."""
    m = MESSAGE.match(text)
    if (m or _demand(text)) and not SIDE_FEATURE.search(text):
        return text[m.end() :] if m else ""
    return None


def is_residue(text: str) -> bool:
    """Whether a whole line or title, code left out, is residue, filler, an error or a demand for scripts."""
    if not text:
        return False
    if PLACEHOLDER_SIGNS.search(text) and PLACEHOLDER.search(text):
        return True
    if "orem" in text and _filler(text):
        return True
    if text.count(text[:2]) > 2 and UNIT.match(text) is not None:
        return True
    return len(text) <= MESSAGE_WIDTH and width(text) <= MESSAGE_WIDTH and message(text) is not None


def says_message(text: str) -> bool:
    """Whether a line too long to be a message has one in any of its sentences."""
    return any(message(x) is not None for x in SENTENCE.split(text) if x)


def line_residue(raw: str, text: str, in_code: bool, in_list: bool = False) -> tuple[bool, bool]:
    """(residue, weak sign) of a raw line of ``content_html`` with the visible ``text``."""
    if in_code:
        return False, False
    if "<code" in raw or "`" in raw or "<%" in raw or "<<" in raw:
        if "<pre" in raw:
            return False, False
        bare = INLINE_CODE.sub("", raw)
        if ("<%" in bare or "<<" in bare) and PLACEHOLDER.search(bare):
            return True, True
        text = TAG.sub("", bare)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
    if is_residue(text):
        return True, True
    if in_list or not (any(map(text.__contains__, WEAK_SPACED)) or (not text.isascii() and WEAK_UNSPACED.search(text))):
        return False, False
    weak = WEAK_LOWER.search(text.lower()) if text.isascii() or not FOLDED.search(text) else WEAK.search(text)
    return False, weak is not None and not SIDE_FEATURE.search(text)
