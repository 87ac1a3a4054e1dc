"""Problem 10: content repeated inside one document.

A letter or digit is repeated if it lies in a phrase that stood earlier in the same text: five words, or
ten characters in unspaced text, or ten characters within one unbroken run that holds them twice.  Longer
phrases, sentences and paragraphs are unions of these.  Case, punctuation and spacing are taken out
first, and a run of digits is one sign, so they make no difference.

To find the documents with much repetition, cheap rules come first, each an upper bound of the share; a
document whose bound is too small is out.  How many phrases of a text stood before is counted by sorting
bare hashes, which is much cheaper than finding out which signs they cover; so many phrases can't cover more
than their number times the longest of them.  A phrase can also only be repeated if its parts are.  Each
task measures cost and selectivity of every rule on its first documents (SAMPLE of them): the rule with the
most rejections per cost comes first, and the others are measured again on what it leaves.  What no rule
rejects gets the exact measure.  The order changes the cost, never the result.

Null and empty texts and texts without letters or digits have share 0.  Repeated rows of a doc_id are
measured row by row; texts are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package, spread

WORDS, CHARS = 5, 10
MUCH = 0.4
SAMPLE = 256
#: Characters of text measured at a time.
BATCH_CHARS = 1 << 21

SPACED, UNSPACED, DIGIT = 1, 2, 3
#: Blocks of scripts written without spaces between words.
UNSPACED_BLOCKS = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029),
    (0x3040, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and folded code of every code point."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    fold = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalnum():
            if c.isdecimal():
                kind[cp] = DIGIT
                fold[cp] = 48
            else:
                kind[cp] = SPACED
                low = c.lower()
                if len(low) == 1:
                    fold[cp] = ord(low)
    for lo, hi in UNSPACED_BLOCKS:
        part = kind[lo : hi + 1]
        part[part == SPACED] = UNSPACED
    return kind, fold


class Stream:
    """Letters and digits of a batch of texts, one after another.

    ``sign`` the folded signs (a run of digits is one), ``weight`` how many letters or digits each stands
    for, ``doc`` its text, ``run`` its unbroken run of spaced script or digits (-1 in unspaced script).
    """

    def __init__(self, texts: list[str]):
        kinds, folds = _tables()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths + 1)[: len(codes)]
        kind = kinds[codes]
        start = np.ones(len(codes), dtype=bool)  # a run of spaced script begins
        start[1:] = (kind[1:] == 0) | (kind[:-1] == 0) | (kind[1:] == UNSPACED) | (kind[:-1] == UNSPACED) | (doc[1:] != doc[:-1])
        run = np.cumsum(start)
        keep = kind > 0
        digit = kind == DIGIT
        inner = np.zeros(len(codes), dtype=bool)
        inner[1:] = digit[1:] & digit[:-1] & (doc[1:] == doc[:-1])
        first = keep & ~inner
        at = np.cumsum(first) - 1
        self.weight = np.bincount(at[keep], minlength=int(first.sum())) if keep.any() else np.zeros(0, dtype=np.int64)
        self.sign = folds[codes[first]].astype(np.uint64)
        self.doc = doc[first]
        self.kind = kind[first]
        self.run = np.where(self.kind == UNSPACED, -1, run[first])
        self.n_docs = len(texts)
        self.known: dict[tuple[int, int], list[Phrases]] = {}
        self.total = np.bincount(self.doc, weights=self.weight, minlength=self.n_docs)


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """True for every key that stands earlier in the array."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    ranked = keys[order]
    again[order[1:]] = ranked[1:] == ranked[:-1]
    return again


def _cover(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Places within windows of ``n`` that begin at the hits."""
    edge = np.bincount(hits, minlength=size + 1) - np.bincount(hits + n, minlength=size + 1)[: size + 1]
    return np.cumsum(edge)[:size] > 0


def _grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each place on."""
    size = len(values) - n + 1
    h = np.zeros(max(size, 0), dtype=np.uint64)
    for j in range(n if size > 0 else 0):
        h = (h ^ values[j : j + size]) * B1
        h ^= h >> np.uint64(29)
    return h


class Phrases(NamedTuple):
    """Phrases of one kind: the unit at which each begins, its document and its hash.

    A phrase has ``span`` units.  ``part`` gives the sign at which each unit begins and ``lengths`` the signs
    of each unit, None where a unit is one sign.
    """

    starts: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    span: int
    part: np.ndarray
    lengths: np.ndarray | None


def phrases(s: Stream, words: int, chars: int) -> list[Phrases]:
    """All phrases of ``words`` words or ``chars`` characters, by kind; a stream keeps those it was asked for."""
    if (words, chars) not in s.known:
        s.known[words, chars] = list(_phrases(s, words, chars))
    return s.known[words, chars]


def _phrases(s: Stream, words: int, chars: int) -> Iterator[Phrases]:
    size = len(s.sign)
    if not size:
        return
    # unspaced text, and signs of other scripts that stand among it
    loose = s.run < 0
    part = np.flatnonzero(loose | _beside(s, loose))
    if len(part) >= chars:
        h = _grams(s.sign[part], chars)
        last = len(part) - chars + 1
        starts = np.flatnonzero((s.doc[part[:last]] == s.doc[part[chars - 1 :]]) & (part[chars - 1 :] - part[:last] == chars - 1))
        doc = s.doc[part[starts]]
        yield Phrases(starts, doc, (h[starts] ^ (doc.astype(np.uint64) * B2)) * B1, chars, part, None)
    # within one long unbroken run
    change = np.ones(size, dtype=bool)
    change[1:] = s.run[1:] != s.run[:-1]
    heads = np.flatnonzero(change)
    lengths = np.diff(np.append(heads, size))
    runs = s.run >= 0
    part = np.flatnonzero(np.repeat(lengths > chars, lengths) & runs)
    if len(part) > chars:
        h = _grams(s.sign[part], chars)
        last = len(part) - chars + 1
        starts = np.flatnonzero(s.run[part[:last]] == s.run[part[chars - 1 :]])
        key = (h[starts] ^ (s.run[part[starts]].astype(np.uint64) * B2)) * B1
        yield Phrases(starts, s.doc[part[starts]], key, chars, part, None)
    # words
    spaced = runs[heads]
    w_head, w_len, w_no = heads[spaced], lengths[spaced], np.flatnonzero(spaced)
    if len(w_head) >= words:
        place = np.arange(size) - np.repeat(heads, lengths)
        mixed = (s.sign + np.uint64(1)) * (B2 * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        mixed ^= mixed >> np.uint64(31)
        h = _grams(np.add.reduceat(mixed * B1, heads)[spaced], words)
        last = len(w_head) - words + 1
        starts = np.flatnonzero((s.doc[w_head[:last]] == s.doc[w_head[words - 1 :]]) & (w_no[words - 1 :] - w_no[:last] == words - 1))
        doc = s.doc[w_head[starts]]
        yield Phrases(starts, doc, (h[starts] ^ (doc.astype(np.uint64) * B2)) * B1, words, w_head, w_len)


def repeated(s: Stream, words: int, chars: int, among: np.ndarray | None = None) -> np.ndarray:
    """Which signs lie in a repeated phrase of ``words`` words or ``chars`` characters, in the texts ``among``."""
    size = len(s.sign)
    out = np.zeros(size, dtype=bool)
    for p in phrases(s, words, chars):
        asked = slice(None) if among is None else among[p.doc]
        hit = p.starts[asked][_seen_before(p.key[asked])]
        if p.lengths is not None:
            covered = _cover(hit, p.span, len(p.part))
            out[np.repeat(p.part[covered], p.lengths[covered]) + _within(p.lengths[covered])] = True
        else:
            out |= _cover(p.part[hit], p.span, size)
    return out


def _within(lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _beside(s: Stream, loose: np.ndarray) -> np.ndarray:
    """Runs of spaced script that stand next to unspaced text in the same document."""
    size = len(s.sign)
    change = np.ones(size, dtype=bool)
    change[1:] = (s.run[1:] != s.run[:-1]) | (s.doc[1:] != s.doc[:-1])
    heads = np.flatnonzero(change)
    lengths = np.diff(np.append(heads, size))
    tails = heads + lengths - 1
    before = np.zeros(len(heads), dtype=bool)
    after = np.zeros(len(heads), dtype=bool)
    before[1:] = loose[heads[1:] - 1] & (s.doc[heads[1:] - 1] == s.doc[heads[1:]])
    after[:-1] = loose[tails[:-1] + 1] & (s.doc[tails[:-1] + 1] == s.doc[tails[:-1]])
    return np.repeat(before | after, lengths) & ~loose


def shares(s: Stream, among: np.ndarray | None = None, words: int = WORDS, chars: int = CHARS) -> np.ndarray:
    """Share of repeated letters and digits of each text; 0 for texts that are not ``among`` those asked for."""
    hit = repeated(s, words, chars, among)
    got = np.bincount(s.doc[hit], weights=s.weight[hit], minlength=s.n_docs)
    return got / np.maximum(s.total, 1)


def _length_bound(s: Stream, among: np.ndarray) -> np.ndarray:
    """Texts shorter than two of the shortest phrases repeat nothing."""
    signs = np.bincount(s.doc, minlength=s.n_docs)
    heads = np.ones(len(s.run), dtype=bool)
    heads[1:] = s.run[1:] != s.run[:-1]
    pieces = np.bincount(s.doc[heads | (s.run < 0)], minlength=s.n_docs)
    return np.where((signs <= CHARS) & (pieces <= WORDS), 0.0, 1.0)


#: Bits of a hash that stay when the number of its document stands before them.
HASH_BITS = 40


def _count_bound(s: Stream, among: np.ndarray) -> np.ndarray:
    """As many phrases as stood before cover no more than so many times the heaviest phrase of a text.

    Hashes that agree by chance can only raise the bound.
    """
    most = np.zeros(s.n_docs)
    heaviest = np.zeros(s.n_docs)
    np.maximum.at(heaviest, s.doc[s.weight > 1], s.weight[s.weight > 1])
    heaviest = np.maximum(heaviest, 1)
    for p in phrases(s, WORDS, CHARS):
        asked = among[p.doc]
        keys = (p.doc[asked].astype(np.uint64) << np.uint64(HASH_BITS)) | (p.key[asked] >> np.uint64(64 - HASH_BITS))
        keys.sort()
        doc = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64)
        if not len(doc):
            continue
        n = np.bincount(doc, minlength=s.n_docs)
        unit = heaviest
        if p.lengths is not None:
            longest = np.zeros(s.n_docs)
            some = n[s.doc[p.part]] > 0
            np.maximum.at(longest, s.doc[p.part[some]], p.lengths[some])
            unit = heaviest * longest
        most += n * p.span * unit
    return np.minimum(most / np.maximum(s.total, 1), 1)


#: Rules by name: an upper bound of the share each.
BOUNDS = {
    "length": _length_bound,
    "number of repeated phrases": _count_bound,
    "parts of 3 words or 6 characters": lambda s, among: shares(s, among, 3, 6),
    "parts of 4 words or 8 characters": lambda s, among: shares(s, among, 4, 8),
}


def _fresh(s: Stream, order: list[str]) -> Stream:
    """The stream as the rules of ``order`` leave it: phrases that one of them made are there, no others."""
    out = copy(s)
    out.known = {} if "number of repeated phrases" not in order else {(WORDS, CHARS): phrases(s, WORDS, CHARS)}
    return out


def measured_order(s: Stream, least: float) -> list[str]:
    """Rules in order of rejections per second on a sample, each measured on what those before it leave.

    The order ends where no rule rejects faster than the exact measure decides.
    """
    left, order, rules = s.total > 0, [], dict(BOUNDS)
    while rules and left.any():
        worth, kept = {}, {}
        for name, bound in rules.items():
            fresh = _fresh(s, order)
            began = time.perf_counter()
            kept[name] = left & (bound(fresh, left) >= least)
            worth[name] = int(left.sum() - kept[name].sum()) / (time.perf_counter() - began + 1e-6)
        fresh = _fresh(s, order)
        began = time.perf_counter()
        shares(fresh, left)
        exact = int(left.sum()) / (time.perf_counter() - began + 1e-6)
        best = max(worth, key=worth.get)
        if worth[best] <= exact:
            break
        order.append(best)
        left = kept[best]
        del rules[best]
    return order


def much_repeated(s: Stream, order: list[str], least: float) -> np.ndarray:
    """Which texts have a share of at least ``least``, by the rules in the given order and the exact measure."""
    left = s.total > 0
    for name in order:
        if not left.any():
            return left
        left &= BOUNDS[name](s, left) >= least
    return left & (shares(s, left) >= least) if left.any() else left


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield keys[at : i + 1], [t or "" for t in texts[at : i + 1]]
            at, size = i + 1, 0


def repeated_shares(documents: DataFrame) -> DataFrame:
    """``doc_id, repeated_share`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _batches(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": keys, "repeated_share": np.round(shares(Stream(texts)), 6)})

    ship_package(documents.sparkSession)
    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, repeated_share double")


def repetitive(documents: DataFrame, least: float = MUCH) -> DataFrame:
    """``doc_id`` of documents of which at least ``least`` is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None
        for batch in batches:
            for keys, texts in _batches(batch):
                if order is None:
                    order = measured_order(Stream(texts[:SAMPLE]), least)
                hit = much_repeated(Stream(texts), order, least)
                found = [k for k, h in zip(keys, hit.tolist()) if h]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(found, type=pa.int64())})

    ship_package(documents.sparkSession)
    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long").distinct()
