"""Outlines: anchors, bookmarks, printed tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim_unicode, utf16_length
from .txt import CONTENTS

#: Titles of chapters and parts.
CHAPTER_TITLE = (
    r"(?i)^(?:第\s*[0-9一二三四五六七八九十百千万零]+\s*[章回卷节篇部集话]|chapter\s+\d+|[序前]言|引子|尾声|后记|番外\S*|"
    r"part\s+\d+|volume\s+\d+|book\s+\d+|section\s+\d+).*"
)
SEARCHED_BLOCKS = 50


def parents(toc: DataFrame) -> DataFrame:
    """``doc_id, toc_ord, title, level, parent_ord``: the parent is the nearest earlier entry of a lower level.

    The outline of a document is folded over a stack that holds an entry for each open level, whatever the
    levels are; entries of equal level replace each other.  An entry without a level has no parent and is none.
    """
    entry = F.struct("toc_ord", "title", "level")
    docs = toc.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("xs"))
    pair = "array<struct<level:int,ord:int>>"

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc["open"], lambda o: o["level"] < x["level"])
        parent = F.try_element_at(F.transform(above, lambda o: o["ord"]), F.lit(-1))
        grown = F.concat(above, F.array(F.struct(x["level"].cast("int").alias("level"), x["toc_ord"].cast("int").alias("ord"))))
        known = x["level"].isNotNull()
        return F.struct(F.when(known, grown).otherwise(acc["open"]).alias("open"), F.array_append(acc["parents"], F.when(known, parent)).alias("parents"))

    start = F.struct(F.array().cast(pair).alias("open"), F.array().cast("array<int>").alias("parents"))
    each = docs.select("doc_id", F.arrays_zip("xs", F.aggregate("xs", start, step)["parents"].alias("parent")).alias("zs"))
    return each.select("doc_id", F.explode("zs").alias("z")).select("doc_id", "z.xs.toc_ord", "z.xs.title", "z.xs.level", F.col("z.parent").alias("parent_ord"))


def located(toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outline entries with the block they point at; entries that point nowhere get the first heading of
    their title, if there is one."""
    heads = blocks.where("kind = 'heading'").groupBy("doc_id", F.col("text").alias("title")).agg(F.min("block_index").alias("by_title"))
    direct = blocks.select("doc_id", "block_index").withColumn("hit", F.lit(True)).dropDuplicates(["doc_id", "block_index"])
    return (
        toc.join(direct, ["doc_id", "block_index"], "left").join(heads, ["doc_id", "title"], "left")
        .select("doc_id", "toc_ord", "title", "level",
                F.when(F.col("hit"), F.col("block_index")).otherwise(F.col("by_title")).alias("block_index"))
    )


def first_pages(placed: DataFrame) -> DataFrame:
    """First page on which each block stands."""
    return placed.groupBy("doc_id", "block_index").agg(F.min("page_index").alias("page_index"))


def bookmarks(toc: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, toc_ord, title, level, page_index``: outline entries with the pages they open.

    An entry stands on the page of its block.  One without a block is looked for by the first twelve letters
    and digits of its title, on the pages from the furthest one found so far on, then on those before; one
    that is nowhere found is left out, as are repeated titles of one level.  What an entry looks for depends
    on those before it, so the entries of a document are folded, over the pages on which each title stands.
    """
    letters = r"[^\p{L}\p{N}]"
    places = first_pages(lines)
    wanted = toc.join(places, ["doc_id", "block_index"], "left").select("doc_id", "toc_ord", "title", "level", "page_index")
    wanted = wanted.withColumn("sought", F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), letters, ""), 1, 12))
    open_ones = wanted.where("page_index is null and sought <> ''").select("doc_id", "toc_ord", "sought")
    shown = lines.select("doc_id", "page_index", F.regexp_replace("text", letters, "").alias("t")).where("t <> ''")
    hits = (
        open_ones.join(shown, "doc_id").where(F.contains("t", F.col("sought"))).groupBy("doc_id", "toc_ord")
        .agg(F.sort_array(F.collect_set("page_index")).alias("on"))
    )
    entry = F.struct("toc_ord", "title", "level", "page_index", "on")
    docs = wanted.join(hits, ["doc_id", "toc_ord"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        named = F.concat_ws(":", x["level"].cast("string"), F.trim(F.coalesce(x["title"], F.lit(""))))
        ahead = F.array_min(F.filter(x["on"], lambda p: p >= acc["last"]))
        page = F.when(F.array_contains(acc["seen"], named), F.lit(None)).otherwise(F.coalesce(x["page_index"], ahead, F.array_min(x["on"])))
        found = page.isNotNull()
        return F.struct(
            F.when(found, F.greatest(acc["last"], page)).otherwise(acc["last"]).alias("last"),
            F.when(found, F.array_append(acc["seen"], named)).otherwise(acc["seen"]).alias("seen"),
            F.array_append(acc["pages"], page).alias("pages"),
        )

    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("pages"))
    each = docs.select("doc_id", F.arrays_zip("xs", F.aggregate("xs", start, step)["pages"].alias("page")).alias("zs"))
    rows = each.select("doc_id", F.explode("zs").alias("z")).where("z.page is not null")
    return rows.select("doc_id", "z.xs.toc_ord", "z.xs.title", "z.xs.level", F.col("z.page").alias("page_index"))


def contents_span(blocks: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of a printed table of contents at the front of a document.

    It begins at a heading or short paragraph that names it, among the first fifty blocks.  It ends at the
    first block that starts the text itself: a heading followed by a paragraph of eight characters or
    more, if the heading is of the contents' level or higher, has a title the contents listed, or looks
    like a chapter; a paragraph of sixty characters without leaders; a page break before a heading.  Page
    breaks and rules after it belong to it.  Titles seen so far make the rule sequential, so blocks are
    gathered per document and folded inside the JVM.
    """
    text = F.coalesce(trim_unicode(F.col("text")), F.lit(""))
    rows = blocks.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("block_index", "kind", F.coalesce("level", F.lit(1)).alias("level"), text.alias("t")))).alias("xs")
    )

    def names(t: Column) -> Column:
        return t.rlike(CONTENTS)

    opens = F.transform(
        "xs",
        lambda x, i: F.when(
            (i < SEARCHED_BLOCKS) & names(x["t"]) & ((x["kind"] == "heading") | ((x["kind"] == "paragraph") & (utf16_length(x["t"]) <= 20))), i
        ),
    )
    with_start = rows.withColumn("start_pos", F.array_min(F.filter(opens, lambda i: i.isNotNull()))).where("start_pos is not null")
    with_start = with_start.withColumn("base", F.when(F.col("xs")[F.col("start_pos")]["kind"] == "heading", F.col("xs")[F.col("start_pos")]["level"]).otherwise(1))

    def fold(acc: Column, i: Column) -> Column:
        x, nxt = F.col("xs")[i], F.try_element_at(F.col("xs"), i + 2)
        title = x["t"]
        prose = (nxt["kind"] == "paragraph") & (utf16_length(nxt["t"]) >= 8)
        is_head = (x["kind"] == "heading") & ~names(title)
        ends = (
            F.when(is_head & prose & ((x["level"] <= F.col("base")) | F.array_contains(acc["seen"], title) | title.rlike(CHAPTER_TITLE)), i)
            .when((x["kind"] == "paragraph") & (utf16_length(title) >= 60) & ~F.contains(title, F.lit("...")) & ~F.contains(title, F.lit("……")), i)
            .when((x["kind"] == "page_break") & (nxt["kind"] == "heading") & ~names(nxt["t"]), i + 1)
        )
        listed = is_head | (x["kind"].isin("list_item", "paragraph") & (title != ""))
        seen = F.when(listed, F.array_append(acc["seen"], title)).otherwise(acc["seen"])
        return F.struct(F.coalesce(acc["end"], ends).alias("end"), F.when(acc["end"].isNull(), seen).otherwise(acc["seen"]).alias("seen"))

    start = F.struct(F.lit(None).cast("int").alias("end"), F.array().cast("array<string>").alias("seen"))
    places = F.when(F.col("start_pos") + 1 <= F.size("xs") - 1, F.sequence(F.col("start_pos") + 1, F.size("xs") - 1)).otherwise(F.array().cast("array<int>"))
    found = with_start.withColumn("end0", F.aggregate(places, start, fold)["end"]).where("end0 is not null")
    tail = F.transform("xs", lambda x, i: F.when((i >= F.col("end0")) & ~x["kind"].isin("page_break", "hr"), i))
    end = F.coalesce(F.array_min(F.filter(tail, lambda i: i.isNotNull())), F.size("xs"))
    return found.select("doc_id", "start_pos", end.alias("end_pos"))


def without_contents(blocks: DataFrame) -> DataFrame:
    """Blocks outside the printed table of contents, numbered anew."""
    w = W.partitionBy("doc_id").orderBy("block_index")
    placed = blocks.withColumn("pos", F.row_number().over(w) - 1).join(contents_span(blocks), "doc_id", "left")
    inside = (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))
    kept = placed.where(~F.coalesce(inside, F.lit(False)))
    gone = F.when(F.col("pos") >= F.col("end_pos"), F.col("end_pos") - F.col("start_pos")).otherwise(0)
    return kept.select("doc_id", (F.col("pos") - gone).alias("block_index"), "kind", "level", "text")
