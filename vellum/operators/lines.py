"""Lines of positioned glyphs, and paragraphs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim_unicode, utf16_length

Y_TOLERANCE = 2.0
#: Forms of a page number.
PAGE_NUMBER = r"(?i)^\s*(?:[-–—]?\s*\d{1,4}\s*[-–—]?|第\s*\d{1,4}\s*页|page\s+\d{1,4}(?:\s+of\s+\d{1,4})?|\d{1,4}\s*/\s*\d{1,4})\s*$"


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """``doc_id, page, line_no, y, text`` of ``doc_id, page, y, x, w, h, ch``, top to bottom.

    Glyphs within two points of height stand in one line; a gap wider than a glyph is high is a blank.
    """
    down = W.partitionBy("doc_id", "page").orderBy("y", "x")
    jump = F.coalesce((F.col("y") - F.lag("y").over(down) > Y_TOLERANCE).cast("int"), F.lit(0))
    lined = glyphs.withColumn("jump", jump).withColumn("line_no", F.sum("jump").over(down))
    along = W.partitionBy("doc_id", "page", "line_no").orderBy("x")
    gap = F.col("x") - (F.lag("x").over(along) + F.lag("w").over(along))
    spaced = lined.withColumn("s", F.concat(F.when(gap > F.col("h"), F.lit(" ")).otherwise(F.lit("")), "ch"))
    parts = F.sort_array(F.collect_list(F.struct("x", "s")))
    return spaced.groupBy("doc_id", "page", "line_no").agg(F.min("y").alias("y"), F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"))


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def without_running_heads(lines: DataFrame, height: float) -> DataFrame:
    """Lines without page numbers and running heads: first or last lines of a page in its outer tenths,
    and short first lines that stand on the page before as well."""
    page = W.partitionBy("doc_id", "page")
    first = F.col("line_no") == F.min("line_no").over(page)
    last = F.col("line_no") == F.max("line_no").over(page)
    heads = lines.withColumn("is_first", first).withColumn("is_last", last)
    tops = heads.where("is_first").select("doc_id", (F.col("page") + 1).alias("page"), F.col("text").alias("before"))
    placed = heads.join(tops, ["doc_id", "page"], "left")
    same = F.col("is_first") & (F.col("text") == F.col("before")) & (utf16_length(F.col("text")) <= 24)
    band = (F.col("is_first") & (F.col("y") < 0.1 * height)) | (F.col("is_last") & (F.col("y") > 0.9 * height))
    gone = (band | same | ((F.col("is_first") | F.col("is_last")) & is_page_number(F.col("text")))).alias("gone")
    return placed.withColumn("gone", F.coalesce(gone, F.lit(False))).where("not gone").select("doc_id", "page", "line_no", "y", "text")


def paragraphs(lines: DataFrame) -> DataFrame:
    """``doc_id, page, par_no, text``: lines joined without blanks, blank lines between paragraphs."""
    w = W.partitionBy("doc_id", "page").orderBy("line_no")
    blank = trim_unicode(F.col("text")) == ""
    grouped = lines.withColumn("blank", blank).withColumn("par", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    parts = F.sort_array(F.collect_list(F.struct("line_no", trim_unicode(F.col("text")).alias("t"))))
    joined = grouped.groupBy("doc_id", "page", "par").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))
    number = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("par")) - 1
    return joined.select("doc_id", "page", number.alias("par_no"), "text")


def page_outline(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outline of pages as outline of blocks: each entry points at the first block of its page."""
    first = blocks.groupBy("doc_id", "page").agg(F.min("block_index").alias("block_index"))
    return outline.select("doc_id", "page", "toc_ord", "title", "level").join(first, ["doc_id", "page"]).select("doc_id", "toc_ord", "title", "level", "block_index")
