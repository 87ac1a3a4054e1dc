"""Problem 1: lines that one site repeats on page after page.

Every line of a page is a symbol, every page a string of symbols, and the strings of a site together
are the text whose suffix array tells the repeated blocks.  The array is not built in one place: ranks
of suffixes are refined by prefix doubling, so that after round k suffixes share a rank exactly if
their first 2^k lines agree, and an interval of the array with a common prefix of that length is a
group of equal ranks.  The number of pages in an interval can only fall as the prefix grows; suffixes
in intervals that span too few pages are dropped after every round, which loses no block.

Null, empty and blank contents have no lines; a null or hostless url belongs to no site and takes no
part.  Repeated rows and several clips of one page count as one page.  Lines of any length are taken
whole.  Empty tables give empty results; columns other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import map_rows
from .web import key, lines_of, same_text, site_and_page

MIN_PAGES = 4
MIN_SHARE = 0.1

LINES = "article_id long, line_no int, pos int, site_key long, page_key long, line_key long"


def _line_kernel():
    def kernel(article_id, url, content):
        site, page = site_and_page(url)
        if site is None:
            return
        site_key, page_key = key(site), key(page)
        yield article_id, None, -1, site_key, page_key, None
        for pos, line in enumerate(lines_of(content)):
            yield article_id, line.no, pos, site_key, page_key, key(site, same_text(line.text))

    return kernel


def symbols(articles: DataFrame) -> DataFrame:
    """One row per line with visible text (its place, site, page and symbol: equal texts, equal symbols), and
    one with ``pos`` -1 per article, so that pages without lines are counted.  Pages are parsed once: the
    rows, keys and numbers only, are written and read by every later step."""
    return cut_lineage(map_rows(articles.select("article_id", "url", "content_html"), _line_kernel, LINES))


def site_pages(at: DataFrame) -> DataFrame:
    """``site_key, n_pages``: number of different pages of each site, over all rows of symbols()."""
    return at.where("pos = -1").select("site_key", "page_key").distinct().groupBy("site_key").agg(F.count(F.lit(1)).alias("n_pages"))


def _site_kernel():
    def kernel(url):
        site, _ = site_and_page(url)
        if site is not None:
            yield key(site), site

    return kernel


def wide_ranks(
    ranked: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """Intervals (``site_key``, ``rank``) that span enough pages of their site, with that number of pages.

    Pages are made distinct before they are counted, so each step combines on the map side and a rank
    that stands on every page of a huge site is still spread over all tasks.
    """
    spans = ranked.select("site_key", "rank", "page_key").distinct().groupBy("site_key", "rank")
    counts = spans.agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return (
        counts.join(pages, "site_key")
        .where(F.col("pages") >= min_share * F.col("n_pages"))
        .select("site_key", "rank", "pages")
    )


def block_rounds(at: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> list[DataFrame]:
    """Suffix ranks by round, each ``article_id, line_no, pos, site_key, page_key, rank, pages``: the starts of
    blocks of 1, 2, 4 ... lines that span enough pages.

    ``at`` comes from symbols().  The rounds end when no block of that length is repeated widely enough,
    whatever its length.
    """
    pages = cut_lineage(site_pages(at))
    columns = ["article_id", "line_no", "pos", "site_key", "page_key", "rank"]
    lines = at.where("pos >= 0").withColumnRenamed("line_key", "rank")
    ranks = cut_lineage(lines.select(*columns).join(wide_ranks(lines, pages, min_pages, min_share), ["site_key", "rank"]))
    out, length = [], 1
    while not ranks.isEmpty():
        out.append(ranks)
        follow = W.partitionBy("article_id").orderBy("pos").rangeBetween(length, length)
        pairs = (
            ranks.withColumn("next", F.first("rank").over(follow))
            .where(F.col("next").isNotNull())
            .select("article_id", "line_no", "pos", "site_key", "page_key", F.xxhash64("rank", "next").alias("rank"))
        )
        ranks = cut_lineage(pairs.join(wide_ranks(pairs, pages, min_pages, min_share), ["site_key", "rank"]))
        length *= 2
    return out


def repeated_blocks(articles: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``article_id, pos, line_no, length, pages``: where blocks of 1, 2, 4 ... lines begin that span enough pages."""
    rounds = block_rounds(symbols(articles), min_pages, min_share)
    columns = ["article_id", "pos", "line_no", "length", "pages"]
    parts = [ranks.withColumn("length", F.lit(1 << k)).select(*columns) for k, ranks in enumerate(rounds)]
    none = articles.select("article_id", *(F.lit(0).alias(c) for c in columns[1:])).limit(0)
    return reduce(DataFrame.unionByName, parts) if parts else none


def maximal_blocks(at: DataFrame, rounds: list[DataFrame], min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``site_key, article_id, pos, length, pages``: the longest widely repeated block that begins at each place
    and isn't the rest of one that begins a line earlier.

    The length is found by binary lifting: a block of 2^k lines is extended by 2^j lines, for j from k - 1
    down, wherever the interval of the longer prefix is still wide.
    """
    pages = cut_lineage(site_pages(at))
    best = None
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k].select("article_id", "pos", "site_key", "page_key", "rank", "pages")
        fresh = here.withColumn("length", F.lit(1 << k))
        if best is not None:
            part = here.select("article_id", F.col("pos").alias("at"), F.col("rank").alias("more"))
            longer = (
                best.withColumn("at", F.col("pos") + F.col("length")).join(part, ["article_id", "at"])
                .select("article_id", "pos", "site_key", "page_key", F.xxhash64("rank", "more").alias("rank"), (F.col("length") + (1 << k)).alias("length"))
            )
            wide = wide_ranks(longer, pages, min_pages, min_share)
            grown = longer.join(wide, ["site_key", "rank"])
            columns = ["article_id", "pos", "site_key", "page_key", "rank", "pages", "length"]
            every = grown.select(*columns).unionByName(best.select(*columns)).unionByName(fresh.select(*columns))
            last = W.partitionBy("article_id", "pos").orderBy(F.desc("length"))
            best = cut_lineage(every.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n"))
        else:
            best = fresh
    if best is None:
        return at.select("site_key", "article_id", "pos", F.lit(1).alias("length"), F.lit(0).cast("long").alias("pages")).limit(0)
    before = W.partitionBy("article_id").orderBy("pos").rangeBetween(-1, -1)
    end = F.first(F.col("pos") + F.col("length")).over(before)
    return (
        best.withColumn("end", end).where(F.col("end").isNull() | (F.col("end") < F.col("pos") + F.col("length")))
        .select("site_key", "article_id", "pos", "length", "pages")
    )


def found_lines(articles: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``article_id, line_no`` of every line inside a widely repeated block, of one line or several.

    Along an article each block reaches as many lines on as it is long; a line is inside a block if one that
    begins at it or before it reaches beyond it.
    """
    starts = repeated_blocks(articles, min_pages, min_share)
    so_far = W.partitionBy("article_id").orderBy("pos").rangeBetween(W.unboundedPreceding, 0)
    reach = F.max(F.col("pos") + F.col("length")).over(so_far)
    return starts.withColumn("reach", reach).where("length = 1 and reach > pos").select("article_id", "line_no")


def block_report(articles: DataFrame) -> DataFrame:
    """Maximal repeated blocks per site and length: how many places they have and the widest one's pages."""
    at = symbols(articles)
    blocks = maximal_blocks(at, block_rounds(at))
    names = map_rows(articles.select("url"), _site_kernel, "site_key long, site string").distinct()
    return (
        blocks.groupBy("site_key", "length").agg(F.count(F.lit(1)).alias("n_places"), F.max("pages").alias("max_pages"))
        .join(names, "site_key").select("site", F.col("length").alias("block_lines"), "n_places", "max_pages")
    )


def without_lines(articles: DataFrame, lines: DataFrame) -> DataFrame:
    """``article_id, content_html`` without the given ``line_no``; every article keeps its row, null stays null."""
    gone = lines.groupBy("article_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(
        F.filter(F.split("content_html", "\n"), lambda _, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False))), "\n"
    )
    return articles.join(gone, "article_id", "left").select("article_id", kept.alias("content_html"))
