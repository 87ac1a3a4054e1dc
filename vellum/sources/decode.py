"""Text of stored files in whatever charset they were written."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package, spread

META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", re.I)
HEADER_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", re.I)


def _known(name: str | None) -> str | None:
    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


def decode_file(data: bytes | None, with_utf16: bool = True) -> str | None:
    """Text of a file: byte-order mark, strict UTF-8, else GBK with replacement characters for what can't be read."""
    if data is None:
        return None
    if data.startswith(codecs.BOM_UTF8):
        return data[3:].decode("utf-8", "replace")
    if with_utf16 and data.startswith(codecs.BOM_UTF16_LE):
        return data[2:].decode("utf-16-le", "replace")
    if with_utf16 and data.startswith(codecs.BOM_UTF16_BE):
        return data[2:].decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


def decode_page(data: bytes | None, content_type: str | None = None) -> str | None:
    """Text of a page: charset of the header, of a meta element in the first 2048 bytes, UTF-8, GB18030,
    lossy UTF-8."""
    if data is None:
        return None
    header = HEADER_CHARSET.search(content_type or "")
    meta = META_CHARSET.search(data[:2048])
    for name in (header and header[1], meta and meta[1].decode("ascii", "ignore"), "utf-8", "gb18030"):
        known = _known(name)
        if known:
            try:
                return data.decode(known)
            except UnicodeDecodeError:
                continue
    return data.decode("utf-8", "replace")


def file_texts(files: DataFrame) -> DataFrame:
    """``doc_id, text`` of text files; null content gives null text, NUL characters are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_file(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t and t.replace("\0", "") for t in texts], type=pa.string())], ["doc_id", "text"]
            )

    ship_package(files.sparkSession)
    return spread(files.select("doc_id", "content")).mapInArrow(run, "doc_id long, text string")
