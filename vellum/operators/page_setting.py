"""Setting of lines on pages: character spacing, shifts, vertical distribution, code grids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import grid_columns, utf16_length

MOST_STRETCH, MOST_COMPRESS, WIDEST_GAP, LEAST_GAP = 0.16, 0.15, 2.2, 0.5


def effective_width(width: Column, measure: Column, hang: Column) -> Column:
    """Width of a line, without what hangs over where it is too wide."""
    return F.when((width > measure) & (hang > 0), F.greatest(width - hang, F.lit(0.0))).otherwise(width)


def char_spacing(text: Column, width: Column, measure: Column, hang: Column, size: Column, ends: Column) -> Column:
    """Spacing that justifies a line: stretched where little is missing and the line does not end a block;
    compressed where it is too wide, unless only a hanging mark is."""
    gaps = utf16_length(text) - 1
    missing = measure - effective_width(width, measure, hang)
    stretch = ~ends & (missing > LEAST_GAP) & (missing <= size * WIDEST_GAP)
    return (
        F.when(gaps <= 0, 0.0)
        .when((missing < -0.01) & (hang > 0) & (missing >= -size), 0.0)
        .when(missing < -0.01, F.greatest(missing / gaps, -size * MOST_COMPRESS))
        .when(stretch, F.least(missing / gaps, size * MOST_STRETCH))
        .otherwise(0.0)
    )


def shift(alignment: str, measure: Column, drawn: Column) -> Column:
    """How far a line moves right: nothing, half or all of the room it leaves."""
    room = F.greatest(measure - drawn, F.lit(0.0))
    return {"RIGHT": room, "CENTER": room / 2}.get(alignment, F.lit(0.0))


def justified(lines: DataFrame, measure: float, alignment: str = "JUSTIFY") -> DataFrame:
    """``lines`` with ``spacing`` and ``shift``; the last line of a block keeps its spacing.

    The only neighbour a line looks at is the end of its block, one window over the document.
    """
    w = W.partitionBy("doc_id", "block_index").orderBy("page_index", "elem_ord")
    last = F.lead("elem_ord").over(w).isNull()
    m = F.lit(measure)
    placed = lines.withColumn("ends", last).withColumn(
        "spacing", char_spacing(F.col("text"), F.col("width"), m, F.col("hang"), F.col("font_size"), F.col("ends"))
    )
    drawn = effective_width(F.col("width"), m, F.col("hang")) + F.col("spacing") * (utf16_length(F.col("text")) - 1)
    return placed.withColumn("shift", shift(alignment, m, drawn))


def aligned_vertically(lines: DataFrame, height: float, alignment: str = "JUSTIFY", line_height: float = 1.5) -> DataFrame:
    """``lines`` with ``new_y``: pages centred, or their free room dealt out between the lines of text."""
    page = W.partitionBy("doc_id", "page_index")
    order = page.orderBy("elem_ord").rowsBetween(W.unboundedPreceding, 0)
    is_text = F.col("text") != ""
    top, bottom = F.min("y").over(page), F.max(F.col("y") + F.col("font_size") * line_height).over(page)
    free = F.lit(height) - top - (bottom - top)
    number = F.sum(is_text.cast("int")).over(order) - 1
    gaps = F.sum(is_text.cast("int")).over(page) - 1
    if alignment == "CENTER":
        new = F.when(free > LEAST_GAP, F.col("y") + free / 2).otherwise(F.col("y"))
    elif alignment == "JUSTIFY":
        new = F.when((free > LEAST_GAP) & (gaps > 0) & is_text, F.col("y") + free / gaps * number).otherwise(F.col("y"))
    else:
        new = F.col("y")
    return lines.withColumn("new_y", new)


def code_grid(blocks: DataFrame, inner: float, font: float = 12.0) -> DataFrame:
    """``doc_id, block_index, columns, target, size`` of code blocks: widest line, wrapping width, font size."""
    widest = F.array_max(F.transform(F.split("text", "\n"), grid_columns))
    code = blocks.where("kind = 'code' and text is not null").select("doc_id", "block_index", widest.alias("columns"))
    target = F.lit(min(max(int(inner / (0.78 * font * 0.5)), 36), 52))
    size = F.greatest(F.lit(6.5), F.least(F.lit(0.8 * font), F.lit(inner) / ((F.least("columns", target) + 1) / 2)))
    return code.select("doc_id", "block_index", "columns", target.alias("target"), size.alias("size"))


#: Signs that fonts often lack, and the signs to use instead, in order of preference.
FALLBACKS = {
    "►": "→>", "▶": "→>", "◄": "←<", "◀": "←<", "▲": "↑^", "△": "↑^", "▼": "↓v", "▽": "↓v", "◦": "·•-", "○": "·o",
    "▪": "•·*", "▫": "·-", "■": "•#", "✓": "√v", "✔": "√v", "✗": "×x", "✘": "×x", "─": "—-", "━": "—-", "│": "|",
    "┃": "|", "┌": "+", "┐": "+", "└": "+", "┘": "+", "├": "+", "┤": "+", "┬": "+", "┴": "+", "┼": "+",
    "╭": "┌+", "╮": "┐+", "╰": "└+", "╯": "┘+", "☐": "□o-", "☑": "■vx", "±": "+", "×": "*", "÷": "/", "≠": "=",
    "≤": "<", "≥": ">", "≈": "~", "≡": "=", "∞": "o", "√": "v", "∛": "v", "∜": "v", "∫": "S", "∬": "S",
    "∭": "S", "∮": "S", "∑": "ΣS", "∏": "ΠP", "∂": "d", "∇": "V", "∈": "e", "∉": "e", "⊂": "<", "⊆": "<",
    "∩": "n", "∪": "u", "∀": "A", "∃": "E", "⇒": ">", "⇐": "<", "⇔": "=", "↦": ">", "⁰": "0", "¹": "1",
    "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁺": "+", "⁻": "-",
    "ⁿ": "n", "ⁱ": "i", "₀": "0", "₁": "1", "₂": "2", "₃": "3", "₄": "4", "₅": "5", "₆": "6", "₇": "7",
    "₈": "8", "₉": "9", "₊": "+", "₋": "-", "ₐ": "a", "ₑ": "e", "ᵢ": "i", "ₙ": "n", "ₘ": "m", "ᵣ": "r",
    "ₛ": "s", "ₜ": "t", "ᵤ": "u", "ᵥ": "v", "ₓ": "x", "ℝ": "R", "ℕ": "N", "ℤ": "Z", "ℚ": "Q", "ℂ": "C",
}


def with_fallbacks(text: Column, lacking: Iterable[str] = FALLBACKS) -> Column:
    """Text with each sign that a font lacks replaced by the first of its substitutes that the font has.

    ``lacking``: what the font lacks, by default all signs that fonts often lack.  A sign none of whose
    substitutes the font has is kept.
    """
    missing = frozenset(lacking)
    found = {c: next((f for f in FALLBACKS[c] if f not in missing), c) for c in FALLBACKS if c in missing}
    return F.translate(text, "".join(found), "".join(found.values())) if found else text
