"""Problem 2: text that was decoded with the wrong character encoding.

Adjacent character pairs of the whole corpus are counted, and every pair gets its share of the corpus'
mutual information.  The pairs with the smallest shares, together PAIR_MASS of all pair occurrences, are
improbable.  In each text the maximum-scoring segments of improbable pairs are isolated, and only inside
these runs inverse mappings (encode with the wrong charset, decode with the right one) are tried; one is
taken if the result reads markedly better by the same pair model.

Garbling that is frequent enough makes its own pairs common, so runs whose characters have the byte
pattern of a multi-byte encoding read by single bytes are isolated as well.  Where the original is lost
(replacement characters, or their own garbled form) the text is found and what is left is kept.

The model that tasks receive is a bit map of the probable pairs of 2**MODEL_BITS bits, whatever the size
of the corpus.  Null, empty, blank and pure ASCII texts are clean.  Repeated rows give one row per
run_id; texts are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package, spread
from .arrow import map_rows

MODEL_BITS = 23
#: Share of all pair occurrences that the improbable pairs make up.
PAIR_MASS = 0.12
#: Least score of a run: so many improbable pairs more than probable ones.
LEAST_SCORE = 2

LOST = re.compile("�|(?:锟斤拷?|拷锟|斤拷){2,}|ï¿½|锛�")
QUOTED = re.compile(r"[「『“‘\"'`《]([^「」『』“”‘’\"'`《》]{1,12})[」』”’\"'`》]")
#: Characters that single-byte charsets show for the first bytes of UTF-8 sequences, and for the bytes after them.
BYTES_1252 = re.compile(r"[Â-ô](?:[\x80-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{1,3})")
BYTES_437 = re.compile(r"[┬├Γ╨╤π┌╞σµτΣσ∩][ -Ͽ -◿]")
BYTES_1251 = re.compile(r"[РСВГ][ -¿ЂЃѓ‚„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈҐЁЄЇІіґёєјЅѕї]")
BYTES_LATIN = re.compile(r"[\xa1-\xff]{4,}")
LONG_LATIN = re.compile(r"[\xa1-\xff]{8,}")
WIDE_SIGNS = re.compile(r"[-\x80-\x9f؀-ۿ߀-߿｡-ﾟ㐀-䶿ㄅ-ㄯ]")

#: Stretches of characters that single-byte charsets have.
NARROW = re.compile(r"[\x80-ӿ\u2010-\u214f\u2200-\u22ff\u2300-\u25ff]{2,}")

WRONG = ("cp1252", "gb18030", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "big5hkscs", "cp932", "cp949")
RIGHT = ("utf-8", "gb18030", "cp932", "euc_jp", "big5", "cp949", "cp1251", "koi8_r")
#: Single-byte charsets by which UTF-8 is most often misread: one character is evidence enough.
COMMON = frozenset({"cp1252", "cp437", "cp1251"})
FAMILY = {"gb18030": "gb", "cp932": "ja", "euc_jp": "ja", "big5": "big5", "big5hkscs": "big5"}


def _single_byte(codec: str) -> dict[int, int]:
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table[b] = b  # undefined bytes are commonly kept as they are
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)
    return table


SINGLE = {c: _single_byte(c) for c in ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r")}
#: What each of them can have shown; a replacement character stands for any byte.
SHOWN = {c: frozenset(map(chr, table)) | {"\ufffd"} for c, table in SINGLE.items()}
OPEN_QUOTES = "「『“‘«„\"'`《("
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
#: How far the borders of a garbled part may lie from those of its maximum-scoring segment.
BORDER = 3


def _gb_user_defined(cp: int) -> bytes | None:
    """Bytes of the user-defined areas of GBK, which charset tables map to the private use area by rule."""
    if 0xE000 <= cp < 0xE234:
        return bytes((0xAA + (cp - 0xE000) // 94, 0xA1 + (cp - 0xE000) % 94))
    if 0xE234 <= cp < 0xE4C6:
        return bytes((0xF8 + (cp - 0xE234) // 94, 0xA1 + (cp - 0xE234) % 94))
    if 0xE4C6 <= cp < 0xE766:
        row, col = divmod(cp - 0xE4C6, 96)
        return bytes((0xA1 + row, 0x40 + col + (col >= 63)))
    return None


class Encoding(dict):
    """Bytes of each character in a charset of several bytes, worked out once; ``lacking``: those it hasn't got."""

    def __init__(self, codec: str):
        super().__init__({"\ufffd": b"\xff"})  # a byte that no charset completes
        self.codec = codec
        self.lacking: set[str] = set()

    def __missing__(self, c: str) -> bytes:
        b = _gb_user_defined(ord(c)) if self.codec == "gb18030" and "\ue000" <= c < "\ue766" else None
        if b is None:
            try:
                b = c.encode(self.codec)
            except UnicodeEncodeError:
                self.lacking.add(c)
                b = b"?"
        self[c] = b
        return b


ENCODINGS = {c: Encoding(c) for c in WRONG if c not in SINGLE}


def to_bytes(text: str, codec: str) -> tuple[bytes, int]:
    """Bytes that ``codec`` would have read as ``text``, and how many characters it can't have produced."""
    if codec in SINGLE:
        text = text.replace("\ufffd", "?")
        raw = codecs.charmap_encode(text, "replace", SINGLE[codec])[0]
        return raw, 0 if SHOWN[codec].issuperset(text) else sum(c not in SHOWN[codec] for c in text)
    known = ENCODINGS[codec]
    raw = b"".join(map(known.__getitem__, text))
    return raw, sum(map(known.lacking.__contains__, text))


#: The class of the sign between two texts.
NUL = 0x110000


def _fold(codes: np.ndarray) -> np.ndarray:
    """ASCII letters, digits and the rest of ASCII fall into classes; Han keeps its characters, NUL is apart."""
    out = codes.copy()
    low = (codes < 128) & (codes > 0)
    out[codes == 0] = NUL
    letters = low & (((codes | 32) >= 97) & ((codes | 32) <= 122))
    digits = low & (codes >= 48) & (codes <= 57)
    out[letters] = 97
    out[digits] = 48
    out[low & ~letters & ~digits & (codes != 32)] = 46
    return out


def _folded(c: str) -> int:
    """The same for one character."""
    if c >= "\x80" or c == " ":
        return ord(c)
    return 97 if c.isalpha() else 48 if c.isdigit() else 46 if c != "\0" else NUL


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def bucket(x, y):
    """Place of a pair in the bit map."""
    return ((x * 0x9E3779B1) ^ (y * 0x85EBCA6B)) >> 7 & ((1 << MODEL_BITS) - 1)


#: Pairs that a task adds up before it passes them on.
PAIRS_HELD = 1 << 20


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``x, y, n``: pairs with one side outside ASCII, added up batch by batch within a task."""
    held_pairs, held_counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def added() -> tuple[np.ndarray, np.ndarray]:
        pairs, place = np.unique(np.concatenate(held_pairs), return_inverse=True)
        return pairs, np.bincount(place, weights=np.concatenate(held_counts), minlength=len(pairs)).astype(np.int64)

    def rows(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs >> 21), pa.array(pairs & 0x1FFFFF), pa.array(counts)], names=["x", "y", "n"])

    for batch in batches:
        codes = _fold(_codes("\x00".join(t for t in batch.column(0).to_pylist() if t)))
        x, y = codes[:-1], codes[1:]
        keep = ((x >= 128) | (y >= 128)) & (x != NUL) & (y != NUL)
        pairs, counts = np.unique((x[keep] << 21) | y[keep], return_counts=True)
        held_pairs.append(pairs)
        held_counts.append(counts)
        if sum(map(len, held_pairs)) >= PAIRS_HELD:
            pairs, counts = added()
            if len(pairs) * 2 > PAIRS_HELD:
                yield rows(pairs, counts)
                pairs, counts = pairs[:0], counts[:0]
            held_pairs, held_counts = [pairs], [counts]
    pairs, counts = added()
    if len(pairs):
        yield rows(pairs, counts)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``x, y, n``: adjacent characters with at least one outside ASCII, counted over all texts.

    A task adds up its own pairs first, so no text is shuffled.
    """
    ship_package(texts.sparkSession)
    counted = spread(texts.where("text is not null").select("text")).mapInArrow(_counted_pairs, "x long, y long, n long")
    return counted.groupBy("x", "y").agg(F.sum("n").alias("n"))


def pair_model(texts: DataFrame) -> tuple[np.ndarray, frozenset[int]]:
    """Bit map of the probable pairs, and the characters that stand in them.

    Code points are at most 1.1 million, so their marginal counts may be broadcast; the histogram by
    which the threshold is found has one row per tenth of a bit; the bit map arrives as at most
    2**(MODEL_BITS - 6) words, the characters as at most 1.1 million code points.
    """
    alive: frozenset[int] = frozenset()
    pairs = cut_lineage(pair_counts(texts))
    total = F.sum("n")
    n_all = pairs.agg(total).first()[0] or 0
    words = np.zeros(1 << (MODEL_BITS - 6), dtype=np.uint64)
    if n_all:
        left = pairs.groupBy("x").agg(total.alias("nx"))
        right = pairs.groupBy("y").agg(total.alias("ny"))
        share = (F.col("n") / n_all) * F.log2(F.col("n") * float(n_all) / (F.col("nx") * F.col("ny")))
        scored = pairs.join(F.broadcast(left), "x").join(F.broadcast(right), "y").withColumn(
            "grade", F.when(share > 0, F.floor(F.log2(share) * 10)).otherwise(-1000)
        )
        mass, limit = 0, -1000
        for grade, n in sorted((r["grade"], r["n"]) for r in scored.groupBy("grade").agg(total.alias("n")).collect()):
            if mass + n > PAIR_MASS * n_all:
                break
            mass, limit = mass + n, grade + 1
        b = F.shiftrightunsigned((F.col("x") * 0x9E3779B1).bitwiseXOR(F.col("y") * 0x85EBCA6B), 7).bitwiseAND((1 << MODEL_BITS) - 1)
        probable = scored.where(F.col("grade") >= limit)
        sides = probable.select(F.explode(F.array("x", "y")).alias("c")).distinct()
        alive = frozenset(r["c"] for r in sides.collect())
        bits = probable.select(b.alias("b"))
        rows = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")
        )
        for w, v in rows.collect():
            words[w] = np.uint64(v & 0xFFFFFFFFFFFFFFFF)
    return words, alive


def _stretches(alive: frozenset[int]) -> re.Pattern:
    """Stretches of two and more characters each of which stands in some probable pair."""
    signs = {97: "A-Za-z", 48: "0-9", 46: "\\x01-\\x1f!-/:-@\\[-`{-\\x7f"}
    return re.compile("[" + "".join(signs[c] if c in signs else re.escape(chr(c)) for c in sorted(alive) if c < NUL) + "]{2,}") if alive else re.compile(r"(?!)")


#: A character of several bytes.
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _wide(text: str) -> int:
    """Characters outside ASCII."""
    return len(text) - len(text.encode("ascii", "ignore"))


class Judge:
    """Reads texts by the pair model."""

    #: Pairs, and runs with their inverse mappings, remembered at most.
    SEEN, TRIED = 1 << 18, 1 << 14

    def __init__(self, words: np.ndarray, alive: frozenset[int] | None = None):
        self.words = words
        self.stretches = None if alive is None else _stretches(alive)
        self.seen: dict[tuple[str, str], int] = {}
        self.tried: dict[tuple[str, bool], tuple[str, float] | None] = {}

    def probable(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For each adjacent pair: whether it counts (one side outside ASCII), and whether it is probable."""
        codes = _fold(_codes(text))
        x, y = codes[:-1], codes[1:]
        b = bucket(x, y)
        hit = (self.words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)
        return (x >= 128) | (y >= 128), hit.astype(bool)

    def share(self, text: str, least: float = 0.0) -> tuple[float, int]:
        """Share of probable pairs among those that count, and their number; (0, 0) as soon as the share can't reach ``least``."""
        n = good = 0
        bad = (1 - least) * (len(text) - 1) + 1e-9 if least else len(text)
        seen = self.seen
        for pair in zip(text, text[1:]):
            v = seen.get(pair)
            if v is None:
                v = self._look(*pair)
            if v:
                n += 1
                if v == 2:
                    good += 1
                elif n - good > bad:
                    return 0.0, 0
        return (good / n if n else 0.0), n

    def _look(self, x: str, y: str) -> int:
        """0 for a pair that doesn't count, 1 for an improbable and 2 for a probable one."""
        v = 0
        if x >= "\x80" or y >= "\x80":
            at = bucket(_folded(x), _folded(y))
            v = 1 + (int(self.words[at >> 6]) >> (at & 63) & 1)
        if len(self.seen) >= self.SEEN:
            self.seen.clear()
        self.seen[x, y] = v
        return v

    def segments(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring runs of improbable pairs, as character ranges."""
        counts, hit = self.probable(text)
        gain = np.where(counts & ~hit, 1.0, np.where(counts, -0.8, -0.4))
        out, start, total, best, end = [], None, 0.0, 0.0, 0
        for i, g in enumerate(gain.tolist()):
            if start is None:
                if g > 0:
                    start, total, best, end = i, g, g, i
                continue
            total += g
            if total > best:
                best, end = total, i
            if total <= 0 or total < best - 3:
                if best >= LEAST_SCORE:
                    out.append((start, end + 2))
                start = None
        if start is not None and best >= LEAST_SCORE:
            out.append((start, end + 2))
        return out

    @staticmethod
    def _widen(text: str, a: int, b: int) -> tuple[int, int]:
        while a > 0 and text[a - 1] >= "\x80":
            a -= 1
        while b < len(text) and text[b] >= "\x80":
            b += 1
        return a, b

    @staticmethod
    def _lone(text: str, a: int, b: int) -> bool:
        """Whether what may be one letter misread by cp1251 is none of a text in Cyrillic letters."""
        raw, bad = to_bytes(text[a:b], "cp1251")
        seen = raw.decode("utf-8", "replace")
        if bad or not seen.isprintable() or seen.isspace() or "\ufffd" in seen or (a and text[a - 1] in OPEN_QUOTES):
            return False
        others = CYRILLIC.search(BYTES_1251.sub("", text))
        return not others or (seen.isalpha() and text[b - 1] != "\xa0" and "a" <= text[a - 1 : a].lower() <= "z")

    def _misread_1251(self, text: str) -> Iterator[tuple[int, int]]:
        """Ranges of letters misread by cp1251: several in a row, or single ones that stand in other script."""
        spans: list[list[int]] = []
        for m in BYTES_1251.finditer(text):
            if spans and spans[-1][1] == m.start():
                spans[-1][1] = m.end()
            else:
                spans.append([*m.span()])
        return ((a, b) for a, b in spans if b - a > 2 or self._lone(text, a, b))

    def inverse(self, run: str, lone: bool = True, ways: frozenset[tuple[str, str]] | None = None) -> tuple[str, float] | None:
        """Best inverse mapping of a run: the text restored (with replacement characters where bytes are
        lost) and its share of probable pairs; None if none reads markedly better.  ``lone``: one letter
        misread by cp1251 is evidence enough; ``ways``: what ways() gave for a run that begins with this one."""
        if (run, lone) not in self.tried:
            if len(self.tried) >= self.TRIED:
                self.tried.clear()
            self.tried[run, lone] = self._inverse(run, lone, ways)
        return self.tried[run, lone]

    def _good(self, text: str, need: int) -> bool:
        """Whether a text has at least ``need`` probable pairs.

        Only characters that stand in some probable pair can make one, and text decoded at random holds
        few of them side by side.
        """
        if self.stretches is not None and sum(map(len, found := self.stretches.findall(text))) - len(found) < need:
            return False
        seen = self.seen
        for pair in zip(text, text[1:]):
            v = seen.get(pair)
            if v is None:
                v = self._look(*pair)
            if v == 2:
                need -= 1
                if not need:
                    return True
        return False

    def ways(self, run: str, shortest: int) -> frozenset[tuple[str, str]]:
        """Pairs of charsets by which any part of ``run`` that begins where it begins and has at least
        ``shortest`` characters may read better.

        What the bytes of such a part decode to is the beginning of what those of the whole run do, so a
        pair of charsets that gives the whole run fewer probable pairs than a mapping needs is out for all
        its parts, and they needn't be decoded one by one.
        """
        out = []
        wide, head = _wide(run), run[:shortest]
        for wrong in WRONG:
            if wrong in SINGLE:
                if SHOWN[wrong].issuperset(head):
                    out += [(wrong, right) for right in RIGHT]
                continue
            first, bad = to_bytes(head, wrong)
            if bad * 5 > wide:
                continue
            raw = first + to_bytes(run[shortest:], wrong)[0]
            more = len(run) - shortest
            for right in RIGHT:
                if wrong == right or right in SINGLE or FAMILY.get(wrong, 1) == FAMILY.get(right, 2) or (right == "utf-8" and not UTF8.search(raw)):
                    continue
                begun = first.decode(right, "replace")
                if lost := begun.count("\ufffd"):
                    # too much is lost at the beginning, even if all that follows is gained
                    gained = _wide(begun) - lost
                    if lost - 1 > gained + more + 1 if right == "utf-8" else (lost - 1) * 8 > gained + 2 * more + 1:
                        continue
                if self._good(raw.decode(right, "replace").replace("\ufffd", " "), 2 if right == "utf-8" else 3):
                    out.append((wrong, right))
        return frozenset(out)

    def _inverse(self, run: str, lone: bool, ways: frozenset[tuple[str, str]] | None) -> tuple[str, float] | None:
        now, _ = self.share(run)
        wide = _wide(run)
        found = None
        least = max(0.6, now + 0.2)  # what a mapping must reach that isn't sure by its form
        single = [wrong for wrong in SINGLE if SHOWN[wrong].issuperset(run)]
        long_latin = LONG_LATIN.search(run) is not None
        for wrong in WRONG:
            narrow = wrong in SINGLE
            if narrow and wrong not in single:
                continue
            if not narrow and (least > 1 or (ways is not None and not any(way[0] == wrong for way in ways))):
                continue  # nothing reads better than the run itself
            raw, bad = to_bytes(run, wrong)
            if bad * 5 > wide or (bad and narrow):
                continue
            utf8 = None if narrow else UTF8.search(raw)
            for right in RIGHT:
                if wrong == right or FAMILY.get(wrong, 1) == FAMILY.get(right, 2) or (right in SINGLE and (not narrow or wide < 6)):
                    continue
                if ways is not None and (wrong, right) not in ways:
                    continue
                if right == "utf-8" and not narrow and not utf8:
                    continue  # no character would come of it
                text = raw.decode(right, "replace")
                if right != "utf-8" and len(text) < 3:
                    continue
                lost = text.count("\ufffd")
                if lost * 2 > len(text):
                    continue
                gained = _wide(text) - lost
                if gained < 1 or lost > gained or (right != "utf-8" and (lost * 8 > gained or gained < 3)):
                    continue
                strict = right == "utf-8" and not lost and not bad
                if not narrow and right != "utf-8" and 2 * len(set(text) & set(run)) > len(set(text)):
                    continue  # charsets that agree on these characters tell nothing
                sure = strict and narrow and (gained > 1 or (wrong in COMMON and (lone or wrong != "cp1251")))  # random bytes are hardly ever UTF-8, but two-byte characters may be
                # nor does any language put so many accented letters in a row
                dense = narrow and not lost and right not in SINGLE and long_latin
                if not (sure or dense) and least > 1:
                    continue
                share, n = self.share(text.replace("\ufffd", " ") if lost else text, 0.0 if sure else max(0.5, now - 0.2) if dense else least)
                sure = sure or (dense and share >= max(0.5, now - 0.2))
                if sure or (share >= 0.6 and share > now + 0.2 and n >= (2 if gained > 2 and right == "utf-8" else 4)):
                    rank = share + 0.3 * strict - 0.2 * lost / (gained + lost) - 0.05 * bad
                    if (n or sure) and (found is None or rank > found[2]):
                        found = (text, share, rank)
        return found and found[:2]

    def within(self, run: str, lone: bool) -> tuple[int, int, str] | None:
        """First inverse mapping of a run or of its inner windows, as garbling may begin or end inside a stretch of good text."""
        n = len(run)
        if better := self.inverse(run, lone):
            return 0, n, better[0]
        for m in NARROW.finditer(run):
            a, b = m.span()
            if b - a < n:
                for i, k in ((a, b), (a, b - 1), (a + 1, b)) if b - a > 3 else ((a, b),):
                    if better := self.inverse(run[i:k], lone):
                        return i, k, better[0]
        counts, hit = self.probable(run)
        bad = np.flatnonzero(counts & ~hit)
        if not len(bad):
            return None
        first, last = int(bad[0]), int(bad[-1]) + 2  # the garbled part begins and ends near an improbable pair
        ends = sorted({last, min(last + 1, n), last - 1, last - 2}, key=lambda b: abs(b - last))
        for a in sorted({first, max(first - 1, 0), first + 1, min(first + 2, n)}, key=lambda a: abs(a - first)):
            some = [b for b in ends if (a or b < n) and b - a >= 3]
            if some and (ways := self.ways(run[a : max(some)], min(some) - a)):
                for b in some:
                    if better := self.inverse(run[a:b], lone, ways):
                        return a, b, better[0]
        return None

    def around(self, text: str, a: int, b: int, least: int, most: int) -> tuple[int, int, str] | None:
        """Best inverse mapping of a segment whose borders may be off by BORDER characters: (start, end, restored)."""
        best = None
        for i in range(max(least, a - BORDER), min(a + BORDER, b) + 1):
            low, high = max(i + 3, b - BORDER), min(most, b + BORDER)
            if high < low or not (ways := self.ways(text[i:high], low - i)):
                continue
            for k in range(low, high + 1):
                if better := self.inverse(text[i:k], False, ways):
                    rank = ("\ufffd" not in better[0], better[1] + 0.02 * (k - i))
                    if best is None or rank > best[0]:
                        best = rank, i, k, better[0]
        return best and best[1:]

    def repair(self, text: str) -> tuple[bool, str]:
        """(garbled, best restored text)."""
        lost = bool(LOST.search(QUOTED.sub(" ", text)))
        garbled, out = lost, text
        earlier = {text}
        while True:  # text can be wrongly decoded more than once
            cores = self.segments(out) if not out.isascii() else []
            spans = [m.span() for pattern in (BYTES_1252, BYTES_437, BYTES_LATIN) for m in pattern.finditer(out)]
            spans += (misread := list(self._misread_1251(out)))
            if not cores and not spans and WIDE_SIGNS.search(out):
                spans = [m.span() for m in WIDE_SIGNS.finditer(out)]
            runs = _merged(out, [self._widen(out, *span) for span in cores + spans])
            changed = False
            for a, b in reversed(runs):
                quoted = a > 0 and b < len(out) and QUOTED.fullmatch(out[a - 1 : b + 1])
                if quoted and b - a < 8:
                    continue
                lone = any(a <= c < b for c, _ in misread)
                if found := self.within(out[a:b], lone):
                    i, k, better = found
                    out, garbled, changed = out[: a + i] + better + out[a + k :], True, True
                else:
                    # a rare pair elsewhere in the run may have hidden the borders of the garbled part
                    for i, k in reversed([c for c in cores if a <= c[0] and c[1] <= b]):
                        if best := self.around(out, i, min(k, b), a, b):
                            i, k, better = best
                            out, b, garbled, changed = out[:i] + better + out[k:], i, True, True
            if not changed or out in earlier or len(out) > len(text):
                break
            earlier.add(out)
        return garbled, out


def _merged(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or nearly touching runs as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 2:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _repair_kernel(words):
    def make():
        judge = Judge(*words.value)

        def kernel(run_id, text):
            garbled, restored = judge.repair(text)
            if garbled:
                yield run_id, text, restored, "�" not in restored and not LOST.search(restored)

        return kernel

    return make


def repaired_runs(runs: DataFrame) -> DataFrame:
    """``run_id, text, restored, complete`` of garbled runs; ``complete`` tells whether nothing was lost."""
    words = runs.sparkSession.sparkContext.broadcast(pair_model(runs))  # 2**MODEL_BITS bits
    suspects = runs.where("text is not null").where(~F.col("text").rlike(r"^[\x00-\x7f]*$")).select("run_id", "text").dropDuplicates(["run_id"])
    return map_rows(suspects, _repair_kernel(words), "run_id long, text string, restored string, complete boolean")
