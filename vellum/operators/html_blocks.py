"""HTML to blocks by a scan over tags: text between block boundaries, headings by their end tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, trim_unicode
from ..session import spread

SKIPPED = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>"
TOKEN = r"(<[^>]*>?|[^<]+)"
BOUNDARY = r"(?i)^(<img|</h\d|<h\d|</(p|div|li|blockquote|section|article|ul|ol)\s*>$|<br(>|/| )|<hr(>|/| ))"
#: Text and the boundary that closes it, once all other tags are gone.
SEGMENT = r"[^<]*<[^>]*>?|[^<]+"


def _parts(segment: Column) -> Column:
    """Block of a segment's text, and mark of the boundary that closes it."""
    closing = F.regexp_extract(segment, r"<[^>]*>?$", 0)
    text = trim_unicode(decode_entities(F.substring_index(segment, "<", 1)))
    level = F.regexp_extract(closing, r"(?i)^</h(\d)", 1)
    return F.struct(text.alias("text"), F.when(level != "", level.cast("int")).otherwise(0).alias("level"), closing.alias("closing"))


def _block(kind: Column, level: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"))


def _blocks_of(part: Column) -> Column:
    """The blocks that a part gives, with nulls for those it doesn't."""
    none = F.lit(None).cast("int")
    head = part["level"] > 0
    mark = F.when(part["closing"].rlike(r"(?i)^<hr(>|/| )"), "hr").when(part["closing"].rlike(r"(?i)^<img"), "image")
    source = F.regexp_extract(part["closing"], r"(?i)src\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.array(
        F.when(part["text"] != "", _block(F.when(head, "heading").otherwise("paragraph"), F.when(head, part["level"]), part["text"])),
        F.when((mark == "hr") | ((mark == "image") & (F.trim(source) != "")), _block(mark, none, source)),
    )


def blocks(pages: DataFrame, key: str = "article_id", html: str = "content_html") -> DataFrame:
    """``key, block_index, kind, level, text``: headings, paragraphs, rules and images of each page.

    A page is one row from beginning to end, so nothing is shuffled: its tokens are an array, tags that
    bound no block are dropped from it, and what is left is cut behind every boundary.  Null and empty
    pages give no blocks; a repeated row gives its blocks again.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(html, SKIPPED, ""), F.lit(TOKEN), F.lit(1))
    kept = F.filter(tokens, lambda t: ~F.startswith(t, F.lit("<")) | t.rlike(BOUNDARY))
    segments = F.regexp_extract_all(F.array_join(kept, ""), F.lit(SEGMENT), F.lit(0))
    parts = F.transform(segments, _parts)
    found = F.filter(F.flatten(F.transform(parts, _blocks_of)), lambda b: b.isNotNull())
    return spread(pages.select(key, html)).select(key, F.posexplode(found).alias("block_index", "b")).select(key, "block_index", "b.kind", "b.level", "b.text")
