"""Tables as rows of cells: shape, widths, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import em_width, trim_unicode, utf16_length

DELIMITER_ROW = r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$"


def pipe_cells(row: Column) -> Column:
    """Cells of a pipe row; an escaped pipe is text."""
    bare = F.regexp_replace(trim_unicode(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: trim_unicode(F.replace(c, F.lit("\\|"), F.lit("|"))))


def fitted(cells: Column, width: Column) -> Column:
    """Cells cut or padded with empty ones to ``width``."""
    n = F.size(cells)
    missing = F.greatest(width - n, F.lit(0))
    return F.concat(F.slice(cells, F.lit(1), F.least(n, width)), F.array_repeat(F.lit(""), missing.cast("int")))


def column_count(rows: Column) -> Column:
    """Number of cells in the longest row."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def cells(tables: DataFrame) -> DataFrame:
    """``table_id, row_no, col_no, header, text`` of ``table_id, headers, rows``: one row per cell."""
    flat = tables.select("table_id", "headers", F.posexplode("rows").alias("row_no", "cs"))
    each = flat.select("table_id", "row_no", "headers", F.posexplode("cs").alias("col_no", "text"))
    return each.select("table_id", "row_no", "col_no", F.try_element_at("headers", F.col("col_no") + 1).alias("header"), "text")


def shows_as_cards(headers: Column, rows: Column) -> Column:
    """Three columns or more, or two of which a cell is longer than sixteen units."""
    columns = F.greatest(F.size(headers), column_count(rows))
    long = F.exists(rows, lambda r: F.exists(r, lambda c: utf16_length(c) > 16))
    return (columns >= 3) | ((columns == 2) & long)


def cards(tables: DataFrame) -> DataFrame:
    """``table_id, row_no, line_no, role, text``: each row as a title and one line per filled cell."""
    every = cells(tables)
    title = F.when(trim_unicode(F.col("text")) != "", F.col("text")).otherwise(F.format_string("第 %d 项", F.col("row_no") + 1))
    text = F.when(F.col("col_no") == 0, title).otherwise(
        F.when(F.coalesce(F.col("header"), F.lit("")) != "", F.concat(F.lit("【"), "header", F.lit("】 "), "text")).otherwise(F.col("text"))
    )
    role = F.when(F.col("col_no") == 0, "title").otherwise("field")
    shown = (F.col("col_no") == 0) | (trim_unicode(F.coalesce("text", F.lit(""))) != "")
    return every.where(shown).select("table_id", "row_no", F.col("col_no").alias("line_no"), role.alias("role"), text.alias("text"))


FONT_BY_COLUMNS = ((2, 0.90), (3, 0.85), (4, 0.78))
LEAST_FONT = 0.72


def font_factor(columns: Column) -> Column:
    """Font of a grid table relative to the text, smaller with more columns."""
    rule = F.when(columns <= FONT_BY_COLUMNS[0][0], FONT_BY_COLUMNS[0][1])
    for n, factor in FONT_BY_COLUMNS[1:]:
        rule = rule.when(columns <= n, factor)
    return rule.otherwise(LEAST_FONT)


def column_widths(tables: DataFrame, inner: float, font: float = 12.0, padding: float = 0.0) -> DataFrame:
    """``table_id, col_no, natural, width``: widths of a grid table's columns.

    Columns whose natural width is at most 0.95 of the even share keep it; the rest of the line is dealt
    out among the others in proportion to the natural width to the power 0.72.
    """
    heads = tables.select("table_id", F.posexplode("headers").alias("col_no", "text"))
    every = heads.unionByName(cells(tables).select("table_id", "col_no", "text"))
    natural = every.groupBy("table_id", "col_no").agg(F.max(em_width(F.coalesce("text", F.lit("")))).alias("em"))
    w = W.partitionBy("table_id")
    n = F.count(F.lit(1)).over(w)
    sized = natural.select("table_id", "col_no", (F.col("em") * font * font_factor(n) + padding).alias("natural"), (F.lit(inner) / n).alias("even"))
    locked = F.col("natural") <= 0.95 * F.col("even")
    kept = F.sum(F.when(locked, F.col("natural")).otherwise(0.0)).over(w)
    weight = F.when(locked, 0.0).otherwise(F.pow(F.greatest("natural", F.lit(1.0)), F.lit(0.72)))
    share = F.sum(weight).over(w)
    raw = F.when(locked, F.col("natural")).otherwise((F.lit(inner) - kept) * weight / share)
    whole = sized.select("table_id", "col_no", "natural", raw.alias("raw"))
    return whole.select("table_id", "col_no", "natural", (F.col("raw") * inner / F.sum("raw").over(w)).alias("width"))
