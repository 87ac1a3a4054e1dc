"""Whole pipelines: from stored files, pages and formulas to blocks, lines, pages and books."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import archives, articles, layout, markdown, splitting, typeset, xhtml
from ..kernels.arrow import per_row
from ..kernels.latex import formula_runs
from ..operators import html_blocks, txt
from ..schemas import BLOCKS
from ..sources import decode, formats

FLAT = ["doc_id", "block_index", "kind", "level", "ordered", "order_index", "language", "text"]


def article_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of clipped pages by a walk over their elements."""
    return per_row(pages.select("article_id", "title", "content_html"), articles.article_blocks, BLOCKS)


def extracted(pages: DataFrame) -> DataFrame:
    """``article_id, title, n_blocks, n_chars, truncated, error``: main content of whole pages."""

    def kernel(article_id, html):
        title, blocks, truncated, error = articles.main_content(html or "")
        yield {"article_id": article_id, "title": title, "n_blocks": len(blocks), "n_chars": sum(len(b["text"] or "") for b in blocks),
               "truncated": truncated, "error": error}

    return per_row(
        pages.select("article_id", "content_html"), kernel, "article_id long, title string, n_blocks int, n_chars long, truncated boolean, error string"
    )


def markdown_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of Markdown texts."""

    def kernel(doc_id, text):
        for b in markdown.parse(text):
            yield {"doc_id": doc_id, **b}

    return per_row(texts.select("doc_id", "text"), kernel, BLOCKS)


def markdown_outline(texts: DataFrame) -> DataFrame:
    """Outline of Markdown texts, without what a printed table of contents lists."""

    def kernel(doc_id, text):
        for e in markdown.outline(markdown.parse(text)):
            yield {"doc_id": doc_id, **e}

    return per_row(texts.select("doc_id", "text"), kernel, "doc_id long, toc_ord int, title string, level int, block_index int")


def formula_texts(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_index, text``: formulas as text."""

    def kernel(doc_id, block_index, latex):
        yield {"doc_id": doc_id, "block_index": block_index, "text": "".join(r["text"] for r in formula_runs(latex))}

    return per_row(
        blocks.where("latex is not null").select("doc_id", "block_index", "latex"), kernel, "doc_id long, block_index int, text string"
    )


def page_texts(files: DataFrame) -> DataFrame:
    """``doc_id, n_chars, crc`` of files decoded as fetched pages; null content gives null."""

    def kernel(doc_id, content):
        text = decode.decode_page(content)
        yield {"doc_id": doc_id, "n_chars": None if text is None else len(text), "crc": None if text is None else zlib.crc32(text.encode("utf-8", "replace"))}

    return per_row(files.select("doc_id", "content"), kernel, "doc_id long, n_chars long, crc long")


def file_documents(files: DataFrame) -> DataFrame:
    """Blocks of stored files of every format; a file that can't be read is a paragraph that says so."""
    routed = formats.routed(files, "content")
    known = {"epub": archives.parse_epub, "docx": archives.parse_docx, "mobi": archives.parse_mobi}

    def kernel(doc_id, form, content):
        if form == "markdown":
            blocks = markdown.parse(decode.decode_file(content, False))
        else:
            blocks = known[form](content or b"")["blocks"]
        for b in blocks:
            yield {"doc_id": doc_id, **b}

    packed = routed.where(F.col("format").isin("markdown", *known)).select("doc_id", "format", "content")
    plain = decode.file_texts(routed.where("format = 'txt'"))
    pages = decode.file_texts(routed.where("format = 'html'")).withColumnRenamed("text", "html")
    columns = ["doc_id", "block_index", "kind", "level", "text"]
    return (
        per_row(packed, kernel, BLOCKS).select(*columns)
        .unionByName(txt.blocks(plain).select(*columns))
        .unionByName(html_blocks.blocks(pages, "doc_id", "html").select(*columns))
    )


LINES = "doc_id long, page_index int, elem_ord int, block_index int, y double, font_size double, width double, hang double, text string"


def pages(blocks: DataFrame, params: layout.Params = layout.Params()) -> DataFrame:
    """Lines on pages of every document.

    Filling pages depends on all that came before, so a document is laid out in one piece; documents are
    gathered by one shuffle and only their own blocks meet in a task.
    """

    def kernel(doc_id, rows):
        for r in layout.paginate(sorted(rows, key=lambda b: b["block_index"]), params):
            yield {"doc_id": doc_id, **r}

    fields = F.struct("block_index", "kind", "level", "ordered", "order_index", "text")
    return per_row(_by_document(blocks, fields), kernel, LINES)


def _by_document(blocks: DataFrame, fields: Column) -> DataFrame:
    """``doc_id, rows``: the blocks of each document together.

    The one shuffle has the session's number of partitions whatever its size: laying out costs time, not
    bytes, so parts that are small must not be put together.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list(fields).alias("rows"))


ELEMENTS = (
    "doc_id long, page_index int, elem_ord int, block_index int, kind string, x double, y double, width double, height double, font_size double, hang double, text string, "
    "segments array<struct<text:string,x:double,font_size:double,bold:boolean,italic:boolean,strikethrough:boolean>>"
)


def typeset_pages(blocks: DataFrame, sheet: typeset.Sheet = typeset.Sheet()) -> DataFrame:
    """Placed elements on pages: styled text, tables, images and rules.

    ``blocks`` has the columns of a block, of which runs, headers, rows and image may be missing; the image
    sizes ``width_px`` and ``height_px`` are used where they are there.  As in pages(), a document is laid out
    in one piece.
    """
    wanted = ("block_index", "kind", "level", "ordered", "order_index", "text", "runs", "headers", "rows", "image", "width_px", "height_px")

    def kernel(doc_id, rows):
        for r in typeset.typeset(sorted(rows, key=lambda b: b["block_index"]), sheet):
            yield {"doc_id": doc_id, **r}

    fields = F.struct(*[c for c in wanted if c in blocks.columns])
    return per_row(_by_document(blocks, fields), kernel, ELEMENTS)


def with_runs(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """Blocks with the array of their runs; a run that stands twice counts once."""
    style = F.struct("run_index", "run_id", "text", "bold", "italic", "font_size", "color", "strikethrough")
    each = runs.where("text is not null and text <> ''").dropDuplicates(["run_id"]).groupBy("doc_id", "block_index").agg(F.sort_array(F.collect_list(style)).alias("runs"))
    return blocks.drop("runs").join(each, ["doc_id", "block_index"], "left")


def book_bodies(pages_: DataFrame, images: bool = True) -> DataFrame:
    """``article_id, body, images``: pages as safe XHTML, with the addresses of their images."""

    def kernel(article_id, url, content):
        body, found = xhtml.safe_body(content, url, images)
        yield {"article_id": article_id, "body": body, "images": found}

    return per_row(pages_.select("article_id", "url", "content_html"), kernel, "article_id long, body string, images array<string>")


def epub_packages(pages_: DataFrame, images: DataFrame | None = None, indent: bool = True) -> DataFrame:
    """``article_id, epub, crc``: every article as a book of one chapter.

    ``images`` (``url, content``) are the images at hand: those an article shows become files of its book,
    named in order of appearance; addresses of others stay.  Without it books hold no images.  Images meet
    their articles by address, so one that many articles show is sent once to each of them.
    """
    names = ("article_id", "title", "body", "images", "files")
    books = book_bodies(pages_, images is not None).join(pages_.select("article_id", "title"), "article_id")
    if images is None:
        books = books.withColumn("files", F.lit(None).cast("array<struct<url:string,content:binary>>"))
    else:
        known = images.where("content is not null").dropDuplicates(["url"]).select("url", "content")
        used = books.select("article_id", F.explode("images").alias("url")).join(known, "url")
        books = books.join(used.groupBy("article_id").agg(F.collect_list(F.struct("url", "content")).alias("files")), "article_id", "left")

    def kernel(article_id, title, body, shown, files):
        content = {f["url"]: f["content"] for f in files or []}
        local, data = {}, {}
        for url in shown or []:
            if url in content:
                local[url] = f"img_{len(local) + 1:03d}.{archives.image_suffix(content[url])}"
                data[local[url]] = bytes(content[url])
        book = archives.build_epub(title or "", [(title or "", xhtml.with_local_images(body, local))], images=data, indent=indent)
        yield {"article_id": article_id, "epub": book, "crc": zlib.crc32(book)}

    return per_row(books.select(*names), kernel, "article_id long, epub binary, crc long")


def file_parts(files: DataFrame, count: int) -> DataFrame:
    """``doc_id, part, size, crc``: files in parts cut at line ends."""

    def kernel(doc_id, content):
        for i, data in enumerate(splitting.parts(content, count)):
            yield {"doc_id": doc_id, "part": i, "size": len(data), "crc": zlib.crc32(data)}

    return per_row(files.select("doc_id", "content"), kernel, "doc_id long, part int, size int, crc long")
