"""Problem 5: texts that look the same but differ in their characters.

A vocabulary of the most frequent tokens is kept in a trie of their raw characters.  A weighted edit
automaton walks it with the raw tokens of each text: look-alikes cost nothing to exchange, ignorable
characters nothing to insert or delete, any other edit costs one.  A token that reaches a leaf at no cost
takes that leaf's canonical spelling, the most frequent one of its look; every other token is normalised by
the table of looks.  Two values look the same exactly if their canonical forms agree.

The vocabulary is limited to VOCABULARY tokens (a documented bound, since it is sent to every task); the
limit changes which spelling is shown, never which values agree.  Null, blank and wholly invisible values
take no part.  Repeated rows count once; texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package, spread
from .arrow import map_rows

VOCABULARY = 1 << 16

#: Letters of other scripts drawn like Latin letters: Cyrillic, Greek, Armenian, Latin extensions, Lisu, Cherokee.
LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ґ": "r", "ӏ": "l", "ү": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ϲ": "c",
    "ϳ": "j", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "ɑ": "a", "ɡ": "g", "ı": "i", "ſ": "s",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓤ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C",
    "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W",
    "Ꮓ": "Z",
}
#: Characters of CJK blocks drawn like an ideograph or kana.
HAN = {
    "へ": "ヘ", "㇐": "一", "ㄧ": "一", "〇": "○", "〡": "丨", "⺀": "冫", "⺄": "乙", "⺅": "亻", "⺈": "刀", "⺉": "刂", "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣",
    "⺐": "尢", "⺑": "尣", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺",
    "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻",
    "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺳": "网", "⺴": "罓", "⺵": "罓", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "耂", "⺺": "肀", "⺻": "聿",
    "⺼": "月", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝",
    "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨",
    "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻞": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼",
    "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
#: Other signs drawn alike.
SIGNS = {
    "˗": "-", "‐": "-", "‑": "-", "−": "-", "⁃": "-", "﹣": "-", "‚": ",", "٫": ",", "꞉": ":", "։": ":", "׃": ":", "∶": ":", "﹕": ":", "⁄": "/",
    "∕": "/", "․": ".", "‧": "·", "・": "·", "･": "·", "᛫": "·", "•": "·", "∙": "·", "⋅": "·", "ǃ": "!", "⧵": "\\", "﹨": "\\", "❘": "|", "∣": "|",
    "ǀ": "|", "ˈ": "'", "ʹ": "'", "ʼ": "’", "﹐": ",", "﹒": ".", "﹔": ";", "﹖": "?", "﹗": "!", "﹟": "#", "﹠": "&", "﹡": "*", "﹢": "+", "﹤": "<",
    "﹥": ">", "﹦": "=", "﹩": "$", "﹪": "%", "﹫": "@", "～": "~", "∼": "~",
}
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤﾠ"
SPACES = re.compile(r"\s+")


def _table() -> dict[int, str | None]:
    """Code point to look class, over canonically decomposed text."""
    table: dict[int, str | None] = {ord(c): None for c in IGNORABLE}
    table |= dict.fromkeys([*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xE0000, 0xE0080), 0xFEFF])
    for lo, hi in ((0x2F00, 0x2FE0), (0x2E80, 0x2F00), (0xFF01, 0xFFEF), (0xFB00, 0xFB07), (0x2160, 0x2180), (0x1D400, 0x1D800)):
        for cp in range(lo, hi):
            form = unicodedata.normalize("NFKD", chr(cp))
            if form != chr(cp):
                table[cp] = form
    table |= {ord(c): like for c, like in (LATIN | HAN | SIGNS).items()}
    # what a class maps to may itself be drawn like something else
    for cp, form in table.items():
        if form:
            table[cp] = "".join(table.get(ord(c), c) or "" for c in form)
    return table


TABLE = _table()


def look(text: str) -> str:
    """The look class of a text: equal for texts that look the same."""
    if text.isascii():
        return " ".join(text.split())
    folded = unicodedata.normalize("NFD", text).translate(TABLE)
    return unicodedata.normalize("NFC", SPACES.sub(" ", folded).strip())


class Node:
    """A place in the trie.  ``edges``: by the first stroke of their character, the strokes that follow it and
    the node below; the edges of ignorable characters are under the empty string."""

    __slots__ = ("edges", "leaf")

    def __init__(self):
        self.edges: dict[str, list[tuple[str, Node]]] = {}
        self.leaf: str | None = None


def strokes(c: str) -> str:
    """What a character shows: nothing for ignorable ones, several strokes for ligatures and the like."""
    like = TABLE.get(ord(c), c)
    return "" if like is None else like


class Trie:
    """Vocabulary of canonical spellings, and the weighted edit automaton that walks it.

    The trie holds the characters of the spellings as they are.  A state of the automaton is a node and what
    is left of the strokes of the edge that leads to it, with the cost so far.  A stroke of a raw token may
    be matched by an edge of any character that is drawn alike, at no cost; ignorable characters on either
    side are inserted or deleted at no cost; any other substitution, insertion or deletion costs EDIT.
    States beyond ``limit`` are dropped; texts that look the same are those within a limit of 0.
    """

    EDIT = 1

    def __init__(self, spellings: list[str]):
        self.root = Node()
        self.by_look: dict[str, str] = {}
        for word in spellings:
            if self.by_look.setdefault(look(word), word) != word:
                continue  # one spelling of each look
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                shown = strokes(c)
                below = node.edges.setdefault(shown[:1], [])
                for rest, child in below:
                    if rest == shown[1:]:
                        node = child
                        break
                else:
                    node_below = Node()
                    below.append((shown[1:], node_below))
                    node = node_below
            node.leaf = word
        self.seen: dict[str, str] = {}

    def _closed(self, states: dict[tuple[Node, str], int], limit: int) -> dict[tuple[Node, str], int]:
        """With the states that are reached without a stroke: past ignorable edges, and by deletions."""
        todo = [k for k in states if not k[1] and ("" in k[0].edges or limit)] if not limit else list(states)
        while todo:
            at = todo.pop()
            node, rest = at
            cost = states[at]
            if rest:
                steps = [((node, rest[1:]), cost + self.EDIT)]
            else:
                steps = [((child, more), cost + (self.EDIT if first else 0)) for first, below in node.edges.items() if limit or not first for more, child in below]
            for to, price in steps:
                if price <= limit and price < states.get(to, limit + 1):
                    states[to] = price
                    todo.append(to)
        return states

    def walk(self, token: str, limit: int = 0) -> tuple[str, int] | None:
        """The spelling that a raw token reaches at the least cost within ``limit``, and that cost."""
        states = self._closed({(self.root, ""): 0}, limit)
        for c in unicodedata.normalize("NFD", token):
            for stroke in strokes(c):
                after: dict[tuple[Node, str], int] = {}
                for (node, rest), cost in states.items():
                    if rest:
                        steps = [((node, rest[1:]), cost if rest[0] == stroke else cost + self.EDIT)]
                    elif limit:
                        steps = [((child, more), cost if first == stroke else cost + self.EDIT) for first, below in node.edges.items() if first for more, child in below]
                    else:
                        steps = [((child, more), cost) for more, child in node.edges.get(stroke, ())]
                    if limit:
                        steps.append(((node, rest), cost + self.EDIT))
                    for to, price in steps:
                        if price <= limit and price < after.get(to, limit + 1):
                            after[to] = price
                states = self._closed(after, limit)
                if not states:
                    return None
        ends = [(cost, node.leaf) for (node, rest), cost in states.items() if not rest and node.leaf is not None]
        return min(ends)[::-1] if ends else None

    def spell(self, token: str) -> str:
        """Canonical spelling of a token: that which the automaton reaches at no cost, else its form by the table.

        Combining marks in another order than the canonical one, across an ignorable character, escape the
        automaton; the form by the table tells whether the token has the look of a spelling all the same.
        """
        done = self.seen.get(token)
        if done is None:
            reached = self.walk(token)
            if reached:
                done = reached[0]
            else:
                done = " ".join(self.by_look.get(part, part) for part in look(token).split(" "))
            if len(self.seen) < VOCABULARY:
                self.seen[token] = done
        return done

    def canonical(self, text: str) -> str:
        """Canonical form of a text: its tokens spelt canonically, one space between them, wholly invisible ones left out."""
        return " ".join(form for token in text.split() if (form := self.spell(token)))


#: Tokens counted before a task passes them on.
TOKENS_HELD = 1 << 17
#: Longest token of the vocabulary.
LONGEST_TOKEN = 24


def _counted_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, look, n``: tokens of a task, added up before they are shuffled."""
    counts: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        tokens = list(counts)
        out = pa.RecordBatch.from_pydict({"token": tokens, "look": [look(t) for t in tokens], "n": [counts[t] for t in tokens]})
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(t for t in (text or "").split() if 1 < len(t) <= LONGEST_TOKEN and t[0].isalpha())
            if len(counts) >= TOKENS_HELD:
                yield rows()
    if counts:
        yield rows()


def vocabulary(values: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent spelling of each of at most ``size`` most frequent look classes of tokens.

    A histogram of the counts, by eighths of a power of two, tells from which count on there are at most
    ``size`` classes; only these are collected.  Tokens that stand once are never among them.
    """
    ship_package(values.sparkSession)
    tokens = spread(values.select("text")).mapInArrow(_counted_tokens, "token string, look string, n long")
    counts = tokens.groupBy("look", "token").agg(F.sum("n").alias("n"))
    best = counts.groupBy("look").agg(F.sum("n").alias("n"), F.max_by("token", F.struct("n", "token")).alias("token"))
    graded = cut_lineage(best.where("n > 1").select("token", F.floor(F.log2("n") * 8).cast("int").alias("grade")))
    total, least = 0, None
    for grade, n in sorted(((r["grade"], r["count"]) for r in graded.groupBy("grade").count().collect()), reverse=True):  # at most 8 x 63 rows
        if total + n > size:
            break
        total, least = total + n, grade
    return [r["token"] for r in graded.where(F.col("grade") >= least).select("token").collect()] if total else []


FORMS = "record_kind string, id long, form string, k1 long, k2 long, chars long"


@lru_cache(maxsize=1)
def _trie(digest: int, spellings: tuple[str, ...]) -> Trie:
    """The trie of a vocabulary, built once in each worker process."""
    return Trie(list(spellings))


def _form_kernel(words):
    def make():
        digest, spellings = words.value
        trie = _trie(digest, spellings)

        def kernel(kind, record_id, text):
            form = trie.canonical(text or "")
            if form:
                h = xxhash.xxh3_128_intdigest(form)
                yield (
                    kind, record_id, form, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63),
                    xxhash.xxh3_64_intdigest(text) - (1 << 63),
                )

        return kernel

    return make


def values_of(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """``record_kind, id, text`` of all runs and titles."""
    run = runs.select(F.lit("run").alias("record_kind"), F.col("run_id").alias("id"), "text")
    title = articles.select(F.lit("title").alias("record_kind"), F.col("article_id").alias("id"), F.col("title").alias("text"))
    return run.unionByName(title).where("text is not null")


def canonical_forms(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """``record_kind, id, form`` with the keys of form and characters, one row per record and text."""
    values = values_of(runs, articles)
    words = tuple(sorted(vocabulary(values)))  # at most VOCABULARY tokens of LONGEST_TOKEN characters
    sent = values.sparkSession.sparkContext.broadcast((xxhash.xxh3_64_intdigest("\n".join(words)), words))
    return map_rows(values, _form_kernel(sent), FORMS)


#: Parts into which the rows of one spelling are dealt when they are joined.
SALTS = 16


def equal_looking_pairs(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """``record_kind, id_a, id_b``: pairs that look the same and differ in their characters.

    Keys are computed once and written.  Spellings of one look are paired first, then each pair is expanded
    by the rows of both, so that nothing is joined but what comes out.  The rows of the more frequent
    spelling are dealt out over SALTS parts, to each of which the rows of the other are copied: no
    spelling, however frequent, stands in one task.
    """
    look_key = ["record_kind", "k1", "k2"]
    columns = [*look_key, "id", "chars"]
    forms = cut_lineage(canonical_forms(runs, articles).select(*columns))
    spellings = forms.distinct().groupBy(*look_key, "chars").agg(F.count(F.lit(1)).alias("n"))
    several = spellings.groupBy(*look_key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*look_key)
    spellings = cut_lineage(spellings.join(several, look_key, "left_semi"))
    rows = cut_lineage(forms.join(several, look_key, "left_semi").distinct().select("record_kind", F.xxhash64("k1", "k2", "chars").alias("spelling"), "id"))

    def named(name: str) -> DataFrame:
        return spellings.select(*look_key, F.xxhash64("k1", "k2", "chars").alias(name), F.struct("n", "chars").alias(f"size_{name}"))

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    pairs = named("more").join(named("less"), look_key).where("size_more > size_less").select("record_kind", "more", "less")
    left = rows.select("record_kind", F.col("spelling").alias("more"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    right = rows.select("record_kind", F.col("spelling").alias("less"), F.col("id").alias("y"), salts)
    found = left.join(pairs.select("*", salts), ["record_kind", "more", "salt"]).join(right, ["record_kind", "less", "salt"]).where("x <> y")
    return found.select("record_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
