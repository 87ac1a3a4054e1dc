"""Relational views of clipped pages: titles, images, truncation, overlays, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import decode_entities, trim_unicode, utf16_length
from ..session import cut_lineage

#: Attributes in which pages keep the address of an image that is loaded late, in order of trust.
LAZY = ("data-actualsrc", "data-original", "data-src", "data-origin-src", "data-lazy-src", "data-echo", "data-url", "data-original-src", "src")
#: The same where a page's own source is restored.
RESTORED = (*LAZY[:-1], "data-ks-lazyload")
#: Prompts that show that a page is folded.
FOLD_MARKERS = ("展开全文", "显示全部", "查看更多", "加载全文", "继续阅读", "打开App阅读", "打开APP阅读", "App内查看", "APP内查看", "打开百度APP", "下载APP", "下载客户端阅读")
#: Parts of class and id names of overlays.
OVERLAY_KEYWORDS = (
    "open-app", "openapp", "open_app", "app-open", "appjump", "app-jump", "read-more", "readmore", "read_more", "unfold",
    "expand-full", "expand_more", "mask", "modal", "dialog", "popup", "pop-up", "overlay", "download-bar", "download-tip",
    "app-guide", "app-guide-mask", "open-in-app", "launch-app", "pullup", "pull-up", "float-btn", "float-button", "login-tip", "login-guide",
)
FOLDED_LENGTH = 300


def visible_text(html: Column) -> Column:
    """Text of a page: tags out, references decoded, white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"[\t-\r\u001c-\u001f\p{Z}]+", " "))


def possibly_truncated(articles: DataFrame) -> DataFrame:
    """``article_id, n_chars, truncated``: little text, and a prompt to unfold the rest."""
    text = visible_text(F.coalesce("content_html", F.lit("")))
    marked = F.exists(F.array(*[F.lit(m) for m in FOLD_MARKERS]), lambda m: F.contains(F.col("t"), m))
    return articles.select("article_id", text.alias("t")).select(
        "article_id", utf16_length(F.col("t")).alias("n_chars"), ((utf16_length(F.col("t")) < FOLDED_LENGTH) & marked).alias("truncated")
    )


def titles(articles: DataFrame) -> DataFrame:
    """``article_id, title``: the title, else the first top heading, else the domain; null without any."""
    h1 = visible_text(F.regexp_extract("content_html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    own = F.nullif(trim_unicode(F.col("title")), F.lit(""))
    return articles.select("article_id", F.coalesce(own, F.nullif(h1, F.lit("")), urls.domain(F.col("url"))).alias("title"))


def usable_image(raw: Column, page: Column) -> Column:
    """An image address as it stands in an attribute, made absolute; null where it can't be used."""
    url = F.replace(F.trim(raw), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(page, r"^(https?:)//", 1)
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(page, r"^(https?://[^/?#]+/(?:[^?#]*/)?)", 1)
    known = F.coalesce(page, F.lit("")).rlike(r"^https?://[^/?#]+")
    whole = (
        F.when(F.startswith(url, F.lit("//")), F.concat(F.when(known, scheme).otherwise(F.lit("https:")), url))
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | ~known | (url == ""), url)
        .when(F.startswith(url, F.lit("/")), F.concat(origin, url))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), url))
    )
    barred = url.rlike(r"(?i)^data:image/svg") | (url == "about:blank")
    return F.when(~barred & whole.rlike(r"(?i)^(https?://|data:image/)"), whole)


def image_urls(articles: DataFrame) -> DataFrame:
    """``article_id, img_ord, url``: addresses of the images of each page, distinct, in order of appearance.

    An image has the first usable address of its attributes: resolved against the page, of the web or
    inline, no drawing and no blank page.  Images without one, and null pages, give no row.
    """
    tags = F.regexp_extract_all("content_html", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))

    def address(tag: Column) -> Column:
        return F.coalesce(*[usable_image(F.regexp_extract(tag, rf"(?i)\s{a}\s*=\s*[\"']([^\"']+)[\"']", 1), F.col("url")) for a in LAZY])

    good = F.filter(F.transform(tags, address), lambda u: u.isNotNull())
    return articles.select("article_id", F.posexplode(F.array_distinct(good)).alias("img_ord", "url"))


def image_files(images: DataFrame) -> DataFrame:
    """``url, file``: one sequential name per distinct address, in order of first use.

    Numbers run over the whole book, so they need a total order; it is taken over the distinct addresses
    only, by range-partitioned sort and a running count per partition rather than one unpartitioned window.
    The sorted addresses are written with the numbers of their partitions, so that both uses see the same.
    """
    first = images.groupBy("url").agg(F.min(F.struct("article_id", "img_ord")).alias("at"))
    spread = cut_lineage(first.repartitionByRange("at").sortWithinPartitions("at").withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("offset"))  # one row per partition
    number = F.row_number().over(W.partitionBy("part").orderBy("at")) + F.coalesce("offset", F.lit(0))
    return spread.join(F.broadcast(offsets), "part").select("url", F.format_string("img_%03d", number).alias("file"))


def overlay_elements(articles: DataFrame) -> DataFrame:
    """``article_id, n_overlays``: elements whose class or id names an overlay."""
    tags = F.regexp_extract_all("content_html", F.lit(r"(?i)<[a-z][^>]*\s(?:class|id)\s*=\s*[\"'][^\"']*[\"'][^>]*>"), F.lit(0))

    def named(tag: Column) -> Column:
        both = F.lower(F.concat_ws(" ", F.regexp_extract(tag, r"(?i)\sclass\s*=\s*[\"']([^\"']*)", 1), F.regexp_extract(tag, r"(?i)\sid\s*=\s*[\"']([^\"']*)", 1)))
        return F.exists(F.array(*[F.lit(k) for k in OVERLAY_KEYWORDS]), lambda k: F.contains(both, k))

    return articles.select("article_id", F.coalesce(F.size(F.filter(tags, named)), F.lit(0)).alias("n_overlays"))


def page_tables(articles: DataFrame) -> DataFrame:
    """``table_id, article_id, headers, rows`` of the tables with header cells, cells as text."""
    found = F.regexp_extract_all("content_html", F.lit(r"(?is)<table[^>]*>(?:(?!<table).)*?</table>"), F.lit(0))
    each = articles.select("article_id", F.posexplode(found).alias("n", "html"))
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def texts(row: Column) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), visible_text)

    headed = each.withColumn("trs", rows).where(F.exists("trs", lambda r: r.rlike(r"(?i)<th[ >]")))
    return headed.select(
        F.concat_ws("-", "article_id", "n").alias("table_id"), "article_id",
        texts(F.col("trs")[0]).alias("headers"), F.transform(F.slice("trs", F.lit(2), F.size("trs")), texts).alias("rows"),
    )


def block_offsets(articles: DataFrame, blocks: DataFrame) -> DataFrame:
    """``article_id, first_block``: where each article's blocks begin in its batch, a page break between articles."""
    counts = blocks.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    day = F.to_date("clipped_at")
    sized = articles.select("article_id", "ord", day.alias("day")).join(counts, "article_id", "left")
    w = W.partitionBy("day").orderBy("ord", "article_id").rowsBetween(W.unboundedPreceding, -1)
    return sized.select("article_id", "day", F.coalesce(F.sum(F.coalesce("n", F.lit(0)) + 1).over(w), F.lit(0)).alias("first_block"))
