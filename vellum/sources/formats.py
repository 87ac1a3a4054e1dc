"""Formats and charsets of stored files, told from names and first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Format by file extension.
BY_EXTENSION = {
    "txt": "txt", "md": "markdown", "markdown": "markdown", "mdown": "markdown", "html": "html", "htm": "html", "docx": "docx",
    "epub": "epub", "mobi": "mobi", "azw": "mobi", "azw3": "mobi", "prc": "mobi", "pdf": "pdf",
}


def extension(name: Column) -> Column:
    """Lower-case extension after the last dot, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), F.lit(""))


def _int(content: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned number at a byte offset."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring(content, start, F.lit(size))), 16, 10).cast("long")


def sniffed(content: Column) -> Column:
    """Format by first bytes, in the order PDF, MOBI, ZIP (DOCX or EPUB), text."""
    size = F.octet_length(content)
    head = F.hex(F.substring(content, 1, 4096))
    record = _int(content, 78, 4)
    mobi = (size >= 78) & (
        (F.substring(head, 121, 8) == "424F4F4B")
        | (F.substring(head, 129, 8) == "4D4F4249")
        | (
            (_int(content, 76, 2) > 0)
            & (size >= 78 + _int(content, 76, 2) * 8)
            & (record >= 78)
            & (record < size - 20)
            & (F.hex(F.substring(content, (record + 17).cast("int"), F.lit(4))) == "4D4F4249")
        )
    )
    archive = head.rlike("^504B0[357]0[468]")
    docx = F.contains(head, F.lit("[Content_Types].xml".encode().hex().upper())) | F.contains(
        head, F.lit("word/document.xml".encode().hex().upper())
    )
    return (
        F.when(F.startswith(head, F.lit("255044462D")), "pdf")
        .when(F.coalesce(mobi, F.lit(False)), "mobi")
        .when(archive & docx, "docx")
        .when(archive, "epub")
        .otherwise("txt")
    )


def routed(files: DataFrame, *columns: str) -> DataFrame:
    """``doc_id, ext, format`` and ``columns``: by extension, by first bytes where that is unknown; null content is text."""
    ext = extension(F.col("file_name"))
    known = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    by_name = F.try_element_at(known, ext)
    form = F.coalesce(by_name, sniffed(F.coalesce("content", F.lit(b""))))
    return files.select("doc_id", ext.alias("ext"), form.alias("format"), *columns)


def charset(content: Column, with_utf16: bool = True) -> Column:
    """Name of the charset a text file is read by: byte-order mark, strict UTF-8, else GBK."""
    mark = F.hex(F.substring(content, 1, 3))
    rule = F.when(F.startswith(mark, F.lit("EFBBBF")), "utf-8-bom")
    if with_utf16:
        rule = rule.when(F.startswith(mark, F.lit("FFFE")), "utf-16le").when(F.startswith(mark, F.lit("FEFF")), "utf-16be")
    return rule.when(F.is_valid_utf8(content), "utf-8").otherwise("gbk")


def image_format_or_suffix(content: Column, path: Column) -> Column:
    """Image format by first bytes, else by the suffix of the path, else png."""
    head = F.hex(F.substring(content, 1, 12))
    size = F.octet_length(content)
    ext = F.lower(F.regexp_extract(F.substring_index(path, "?", 1), r"\.([^.]*)$", 1))
    known = F.when(ext == "jpeg", "jpg").when(ext.isin("jpg", "png", "gif", "webp", "bmp"), ext)
    return F.coalesce(
        F.when((size >= 3) & F.startswith(head, F.lit("FFD8")), "jpg")
        .when((size >= 8) & F.startswith(head, F.lit("89504E47")), "png")
        .when((size >= 6) & F.startswith(head, F.lit("474946")), "gif")
        .when((size >= 12) & F.startswith(head, F.lit("5249")) & (F.substring(head, 17, 6) == "574542") & (F.substring(head, 23, 2) == "50"), "webp"),
        known, F.lit("png"),
    )


def image_suffix(content: Column) -> Column:
    """Suffix under which an image is stored: by first bytes, jpg where they tell nothing."""
    head = F.hex(F.substring(content, 1, 12))
    size = F.octet_length(content)
    rule = (
        F.when((size > 3) & F.startswith(head, F.lit("FFD8")), "jpg").when((size > 8) & F.startswith(head, F.lit("8950")), "png")
        .when((size > 6) & F.startswith(head, F.lit("4749")), "gif").when((size > 12) & (F.substring(head, 17, 4) == "5745"), "webp")
        .when((size > 2) & F.startswith(head, F.lit("424D")), "bmp")
    )
    return F.coalesce(rule, F.lit("jpg"))


def is_image(content: Column) -> Column:
    """Whether a record of an archive is an image."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(
        F.startswith(head, F.lit("FFD8FF")) | F.startswith(head, F.lit("89504E47")) | F.startswith(head, F.lit("47494638")) | F.startswith(head, F.lit("424D"))
        | (F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")),
        F.lit(False),
    )


def image_size(content: Column) -> Column:
    """Struct ``width, height`` in pixels by the header of a PNG, GIF, BMP or JPEG; null where it can't be read."""
    head = F.hex(F.substring(content, 1, 32))

    def number(text: Column, at: int, size: int, little: bool) -> Column:
        digits = [F.substring(text, at + 1 + 2 * i, 2) for i in range(size)]
        return F.conv(F.concat(*(reversed(digits) if little else digits)), 16, 10).cast("int")

    def pair(width: Column, height: Column) -> Column:
        return F.struct(width.alias("width"), height.alias("height"))

    # the frame header of a JPEG follows its other segments, each of which tells its length
    frame = F.regexp_extract(F.hex(content), r"^FFD8(?:[0-9A-F]{2})*?FF(?:C[0-35-79A-BD-F])[0-9A-F]{4}08([0-9A-F]{8})", 1)
    found = (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.length(head) >= 48), pair(number(head, 32, 4, False), number(head, 40, 4, False)))
        .when(F.startswith(head, F.lit("47494638")) & (F.length(head) >= 20), pair(number(head, 12, 2, True), number(head, 16, 2, True)))
        .when(F.startswith(head, F.lit("424D")) & (F.length(head) >= 52), pair(number(head, 36, 4, True), number(head, 44, 4, True)))
        .when(F.startswith(head, F.lit("FFD8")) & (frame != ""), pair(number(frame, 4, 2, False), number(frame, 0, 2, False)))
    )
    return F.when((found["width"] > 0) & (found["height"] > 0), found)


def shown_images(images: DataFrame, least: int = 4) -> DataFrame:
    """Images with ``width, height``, without those that can't be read and without tracking pixels of at most
    ``least`` pixels both ways."""
    sized = images.withColumn("px", image_size(F.col("content")))
    seen = sized.where("px is not null").where((F.col("px.width") > least) | (F.col("px.height") > least))
    return seen.withColumn("width", F.col("px.width")).withColumn("height", F.col("px.height")).drop("px")


def inline_image(url: Column) -> Column:
    """Bytes of an inline image address, null where it is none or can't be read."""
    data = F.regexp_replace(F.regexp_extract(F.trim(url), r"(?is)^data:image/[^,]*,(.+)$", 1), r"\s", "")
    return F.when(data != "", F.try_to_binary(data, F.lit("base64")))


def image_format(content: Column) -> Column:
    """Image format by first bytes, null where they tell none."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E47")), "png")
        .when(F.startswith(head, F.lit("FFD8")), "jpg")
        .when(F.startswith(head, F.lit("47494638")), "gif")
        .when(F.startswith(head, F.lit("424D")), "bmp")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp")
    )
