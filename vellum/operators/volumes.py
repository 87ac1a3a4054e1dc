"""Books in volumes: how many, where to cut, and what each volume holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_length

COUNTED_KINDS = ("paragraph", "heading", "quote", "list_item")


def document_sizes(blocks: DataFrame) -> DataFrame:
    """``doc_id, n_blocks, n_chars, est_pages, auto_volumes`` per document.

    Characters of paragraphs, headings, quotes and list items count; a page holds 250 of them, or four
    blocks.  One pass with partial aggregation.
    """
    chars = F.when(F.col("kind").isin(*COUNTED_KINDS), F.coalesce(utf16_length(F.col("text")), F.lit(0))).otherwise(0)
    sizes = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(chars.cast("long")).alias("n_chars"))
    pages = F.greatest(F.floor(F.col("n_chars") / 250), F.floor(F.col("n_blocks") / 4)).cast("long")
    return sizes.withColumn("est_pages", pages).withColumn("auto_volumes", auto_volumes(F.col("n_blocks"), F.col("est_pages")))


def auto_volumes(n_blocks: Column, pages: Column) -> Column:
    """Number of volumes by estimated pages; short documents stay whole."""
    return (
        F.when(n_blocks < 300, 1).when(pages <= 600, 1).when(pages <= 1100, 2).when(pages <= 1700, 3)
        .when(pages <= 2400, 4).when(pages <= 3200, 5)
        .otherwise(F.least(F.greatest(F.floor(pages / 500), F.lit(2)), F.lit(10))).cast("int")
    )


def label(index: Column, total: Column) -> Column:
    """Name of a volume: halves and thirds have names, more are numbered."""
    return (
        F.when((total == 2) & (index == 0), "上册").when(total == 2, "下册")
        .when((total == 3) & (index == 0), "上册").when((total == 3) & (index == 1), "中册").when(total == 3, "下册")
        .otherwise(F.concat(F.lit("第"), (index + 1).cast("string"), F.lit("卷")))
    )


def cut_points(blocks: DataFrame, toc: DataFrame, volumes: int) -> DataFrame:
    """``doc_id, n_blocks, cuts``: block positions at which volumes begin and end.

    Cuts go to the outline entry nearest to each even division, later than the last cut; to headings
    where the outline has too few entries; to the even division itself where there are too few headings.
    Positions are ranks of blocks, so gaps in block_index do no harm.  Each cut depends on the last one,
    which a fold over the divisions expresses without leaving the JVM.
    """
    ranked = _ranked(blocks)
    heads = ranked.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_blocks"),
        F.sort_array(F.collect_set(F.when((F.col("kind") == "heading") & (F.col("pos") > 0), F.col("pos")))).alias("headings"),
    )
    entries = (
        toc.where("block_index is not null").select("doc_id", "block_index")
        .join(ranked.select("doc_id", "block_index", "pos"), ["doc_id", "block_index"])
        .where("pos > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("entries"))
    )
    empty = F.array().cast("array<int>")
    docs = heads.join(entries, "doc_id", "left").withColumn("entries", F.coalesce("entries", empty))
    n = F.lit(volumes)
    points = F.when(F.size("entries") >= n, F.col("entries")).when(F.size("headings") >= n, F.col("headings")).otherwise(empty)

    def step(acc: Column, v: Column) -> Column:
        ideal = F.floor(v * (F.col("n_blocks").cast("float") / F.lit(float(volumes)).cast("float"))).cast("int")
        last = F.element_at(acc, -1)
        later = F.filter(F.col("points"), lambda p: p > last)
        near = F.array_min(F.transform(later, lambda p: F.struct(F.abs(p - ideal).alias("d"), p.alias("p"))))["p"]
        between = F.least(F.greatest(F.floor((last + ideal) / 2).cast("int"), last + 1), F.col("n_blocks") - 1)
        even = F.floor(F.col("n_blocks") / volumes).cast("int") * v
        cut = F.when(F.size("points") == 0, even).otherwise(F.coalesce(near, F.greatest(between, last)))
        return F.concat(acc, F.array(cut.cast("int")))

    cuts = F.aggregate(F.sequence(F.lit(1), F.lit(max(volumes - 1, 1))), F.array(F.lit(0)), step) if volumes > 1 else F.array(F.lit(0))
    whole = F.array(F.lit(0), F.col("n_blocks"))
    with_points = docs.withColumn("points", points)
    return with_points.select(
        "doc_id", "n_blocks",
        F.when(F.col("n_blocks") < n, whole).otherwise(F.concat(cuts, F.array(F.col("n_blocks")))).alias("cuts"),
    )


def _ranked(blocks: DataFrame) -> DataFrame:
    """Blocks with ``pos``, their rank within the document."""
    order = F.sort_array(F.collect_list(F.struct("block_index", "kind")))
    return blocks.groupBy("doc_id").agg(order.alias("xs")).select("doc_id", F.posexplode("xs").alias("pos", "x")).select(
        "doc_id", "pos", "x.block_index", "x.kind"
    )


def volumes(blocks: DataFrame, toc: DataFrame, count: int) -> DataFrame:
    """``doc_id, vol_index, total, label, start_pos, end_pos`` of the non-empty volumes."""
    cuts = cut_points(blocks, toc, count)
    pairs = F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = F.size("cuts") - 1
    each = cuts.select("doc_id", total.alias("total"), F.posexplode(pairs).alias("vol_index", "r")).where("r.a < r.b")
    name = F.when(F.col("total") == 1, "全一卷").otherwise(label(F.col("vol_index"), F.col("total")))
    return each.select("doc_id", "vol_index", "total", name.alias("label"), F.col("r.a").alias("start_pos"), F.col("r.b").alias("end_pos"))


def volume_outline(blocks: DataFrame, toc: DataFrame, count: int) -> DataFrame:
    """Outline entries of each volume, counted from the volume's first block.

    A range join on the document: both sides are partitioned by doc_id, the range is a residual filter.
    """
    placed = toc.where("block_index is not null").join(_ranked(blocks).select("doc_id", "block_index", "pos"), ["doc_id", "block_index"])
    vols = volumes(blocks, toc, count)
    return placed.join(vols, "doc_id").where("pos >= start_pos and pos < end_pos").select(
        "doc_id", "vol_index", "toc_ord", "title", "level", (F.col("pos") - F.col("start_pos")).alias("block_index")
    )
