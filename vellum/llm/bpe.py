"""Problem 8: encoding of all texts with a byte-level BPE tokenizer.

A text is cut into pieces by the tokenizer's pattern; equal pieces of a batch are encoded once.  Pieces
of a batch are encoded together: over the byte positions of each stands a segment tree whose inner nodes
hold the least (rank, position) of the pairs below, so that the root is the leftmost pair of minimum
rank.  A merge joins two live neighbours and updates the at most three leaves it touches, each by walking
to the root.  All trees of a batch do their next merge at the same time, as array operations.

Null and empty texts give the empty list; any Unicode text is encoded, lone surrogates as replacement
characters; texts are encoded whole, special tokens in a text are ordinary text.  Repeated rows are
encoded like others; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ship_package, spread

#: Where the vocabulary files lie; ``spark.vellum.tokenizers`` or the environment may name another folder.
TOKENIZERS = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NONE = np.int64(1) << 60
#: Pieces a worker remembers from batch to batch, and the longest of them in bytes.
CACHE, CACHE_BYTES = 400_000, 96


def tokenizer_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.vellum.tokenizers", None) or TOKENIZERS


class Bpe:
    """Ranks of a byte-level BPE vocabulary and the encoder over them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        by_id = {i: t for t, i in ranks.items()}
        self.size = max(by_id) + 1
        # every pair of tokens whose joint bytes are a token, as an open-addressed table
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a * self.size + b)
                    merged.append(rank)
        self._build(np.array(pairs, dtype=np.int64), np.array(merged, dtype=np.int64))
        self.cache: dict[str, list[int]] = {}

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(len(keys) * 3).bit_length())
        self.bits, mask = bits, (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int64)
        at, left, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            slots = (at[left] + self.probes - 1) & mask
            free = self.keys[slots] == -1
            first = np.unique(slots[free], return_index=True)[1]
            put = left[free][first]
            where = slots[free][first]
            self.keys[where], self.values[where] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge."""
        keys = a * self.size + b
        mask = (1 << self.bits) - 1
        slot = self._hash(keys)
        out = np.full(len(keys), NONE, dtype=np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            got = self.keys[slot[left]]
            hit = got == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (got != -1)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & mask
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int] | None] = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, (1 << 21) // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for i, ids in zip(part.tolist(), self._encode_width([pieces[i] for i in part.tolist()], width)):
                    out[i] = ids
        return out

    def _encode_width(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.byte_ids[flat]
        spots = np.arange(width, dtype=np.int64)
        nxt = np.broadcast_to(spots + 1, (n, width)).copy()
        prv = np.broadcast_to(spots - 1, (n, width)).copy()
        alive = spots[None, :] < sizes[:, None]
        # leaves width .. 2*width-1 hold rank * width + position of the pair that begins there
        tree = np.full((n, 2 * width), NONE * 2, dtype=np.int64)
        rows, cols = np.nonzero(spots[None, :-1] < sizes[:, None] - 1)
        r = self.rank(ids[rows, cols], ids[rows, cols + 1])
        ok = r < NONE
        tree[rows[ok], width + cols[ok]] = r[ok] * width + cols[ok]
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            right = nxt[live, at]
            after = nxt[live, right]
            before = prv[live, at]
            ids[live, at] = rank
            alive[live, right] = False
            nxt[live, at] = after
            inner = after < sizes[live]
            prv[live[inner], after[inner]] = at[inner]
            # the pair that began at the right half is gone, those at and before the joint are new
            at_leaf = np.full(len(live), NONE * 2, dtype=np.int64)
            if inner.any():
                fresh = self.rank(rank[inner], ids[live[inner], after[inner]])
                at_leaf[inner] = np.where(fresh < NONE, fresh * width + at[inner], NONE * 2)
            self._update(tree, live, right, np.full(len(live), NONE * 2, dtype=np.int64), width)
            self._update(tree, live, at, at_leaf, width)
            has = before >= 0
            if has.any():
                rows_b, spot_b = live[has], before[has]
                fresh = self.rank(ids[rows_b, spot_b], rank[has])
                self._update(tree, rows_b, spot_b, np.where(fresh < NONE, fresh * width + spot_b, NONE * 2), width)
            live = live[tree[live, 1] < NONE]
        counts = alive.sum(axis=1)
        kept = ids[alive].tolist()
        ends = np.cumsum(counts).tolist()
        return [kept[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, spots: np.ndarray, values: np.ndarray, width: int) -> None:
        """Point updates: set leaves and restore the minima on their way to the root."""
        flat, stride = tree.reshape(-1), tree.shape[1]
        base = rows * stride
        node = spots + width
        flat[base + node] = values
        while width > 1:
            values = np.minimum(values, flat[base + (node ^ 1)])
            node >>= 1
            flat[base + node] = values
            width >>= 1

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        split = [PIECES.findall(t) if t else [] for t in texts]
        cache = self.cache
        new = list({p for pieces in split for p in pieces if p not in cache})
        fresh = dict(zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new]))) if new else {}
        out = []
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                ids += cache[p] if p in cache else fresh[p]
            out.append(ids)
        if len(cache) < CACHE:
            cache.update((p, x) for p, x in fresh.items() if len(p) <= CACHE_BYTES)
        return out


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The encoder of a vocabulary file, kept for the life of the worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


#: Rows encoded at a time.
ROWS = 5000


def with_ids(df: DataFrame, key: str, key_type: str, name: str = "byte_bpe_50k", count_only: bool = False) -> DataFrame:
    """``key`` with ``ids`` (or ``n_tokens``) of the column ``text``."""
    path = os.path.join(tokenizer_dir(df.sparkSession), f"{name}.tiktoken")
    schema = _parse_datatype_string(f"{key} {key_type}, " + ("n_tokens long" if count_only else "ids array<int>"))
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                values = pa.array([len(x) for x in ids] if count_only else ids, type=target[1].type)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(target[0].type), values], schema=target)

    ship_package(df.sparkSession)
    return spread(df.select(key, "text")).mapInArrow(run, schema)


def document_ids(documents: DataFrame) -> DataFrame:
    """``doc_id, ids`` by byte_bpe_50k."""
    return with_ids(documents, "doc_id", "long")
