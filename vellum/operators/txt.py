"""Plain text to blocks: one block per non-empty line, chapter titles as headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_control, utf16_length

#: Titles of chapters, and of a printed table of contents.
CHAPTER = (
    r"(?i)^(?:第\s*[0-9一二三四五六七八九十百千万零]+\s*[章回卷节篇部集话]|chapter\s+\d+|[序前]言|引子|尾声|后记|番外\S*)"
)
CONTENTS = (
    r"(?i)^(?:全书)?(?:完整)?(?:导读)?(?:本文)?(?:文章)?(?:章节)?(?:目录|contents|table of contents|navigation|导航)(?:[（(].*[）)])?[:：]?\s*$"
)
LONGEST_TITLE = 40


def blocks(texts: DataFrame) -> DataFrame:
    """``doc_id, block_index, kind, level, text`` of ``doc_id, text``.

    A narrow transformation: lines are cut, trimmed and numbered inside one array, then exploded.  Null,
    empty and blank texts give no blocks.
    """
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n+")
    kept = F.filter(F.transform(lines, trim_control), lambda x: x != "")
    each = texts.select("doc_id", F.posexplode(kept).alias("block_index", "text"))
    heading = (utf16_length(F.col("text")) <= LONGEST_TITLE) & (F.col("text").rlike(CHAPTER) | F.col("text").rlike(CONTENTS))
    return each.select(
        "doc_id", "block_index", F.when(heading, "heading").otherwise("paragraph").alias("kind"),
        F.when(heading, 1).alias("level"), "text",
    )


def outline(text_blocks: DataFrame) -> DataFrame:
    """``doc_id, title, level, block_index`` of the headings."""
    return text_blocks.where("kind = 'heading'").select("doc_id", F.col("text").alias("title"), "level", "block_index")
