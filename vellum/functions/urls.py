"""URL functions as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_sharing", "chksm", "exportkey",
    "pass_ticket", "sc_sid", "source_type", "scene", "share_source", "sub_source", "mid", "sn",
)
FOUND = r"https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'*+,;=%]+"
#: Marks trimmed from the end of a URL found in running text.
TRAILING = ".,;:)]}>，。；）」】、？！”’"


def host(url: Column) -> Column:
    """Host of a URL in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain(url: Column) -> Column:
    """Host as written, the whole URL where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), url)


def page_key(url: Column) -> Column:
    """Host and path, without scheme, query and fragment."""
    return F.concat(host(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))


def found_urls(text: Column) -> Column:
    """Distinct URLs of a text in order of appearance, without trailing punctuation."""
    urls = F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))
    return F.array_distinct(F.transform(urls, lambda u: F.rtrim(u, F.lit(TRAILING))))


def sanitized(url: Column, tracking: tuple[str, ...] = TRACKING, article_host: str = "zhihu.com") -> Column:
    """URL without tracking keys; article pages of ``article_host`` lose query and fragment altogether.

    URLs without a query, and those that can't be read, stay as they are.
    """
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    kept = F.filter(
        F.split(query, "&"), lambda p: ~F.trim(F.lower(F.substring_index(p, "=", 1))).isin(*tracking)
    )
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    article = F.contains(F.coalesce(host(url), F.lit("")), F.lit(article_host)) & (
        F.contains(path, F.lit("/answer/")) | F.startswith(path, F.lit("/p/"))
    )
    unreadable = url.rlike(r"[\s\"<>\\^`{|}]") | (F.trim(query) == "")
    return F.when(unreadable, url).when(article, head).otherwise(F.concat(head, rest, fragment))


def routed(url: Column, domains: Column) -> Column:
    """Whether a URL belongs to one of the listed domains: same host, subdomain, or named anywhere in it."""
    wanted = F.filter(F.transform(F.split(domains, r"[,;\n ]"), lambda d: F.lower(F.trim(d))), lambda d: d != "")
    h = F.coalesce(host(url), F.lower(url))
    return F.exists(wanted, lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)) | F.contains(F.lower(url), d))


def glob_regex(glob: Column) -> Column:
    """Anchored regular expression of a match pattern in which ``*`` stands for anything."""
    quoted = F.regexp_replace(glob, r"([.\\+?^$()\[\]{}|/])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def referer(url: Column, hint: Column | None = None) -> Column:
    """Referer with which an image is asked for: the site of its image host, else ``hint``, else its own host."""
    h = F.coalesce(host(url), F.lit(""))

    def has(*names: str) -> Column:
        return reduce(Column.__or__, [F.contains(h, F.lit(n)) for n in names])

    own = F.concat(F.lit("https://"), h, F.lit("/"))
    return (
        F.when(has("zhimg.com"), F.lit("https://www.zhihu.com/"))
        .when(has("qpic.cn", "weixin.qq.com"), F.lit("https://mp.weixin.qq.com/"))
        .when(has("csdnimg.cn", "csdn.net"), F.lit("https://blog.csdn.net/"))
        .when(has("sinaimg.cn", "weibo.com"), F.lit("https://weibo.com/"))
        .otherwise(own if hint is None else F.coalesce(F.nullif(F.trim(hint), F.lit("")), own))
    )


#: Parts of addresses of pages that are no articles, and schemes that are no pages.
NOT_CLIPPED = ("login", "signin", "passport", "account", "unhuman", "captcha", "verify", "security", "search?", "/search")
NO_PAGES = ("about:", "chrome://", "javascript:")
#: Least characters of a page that is clipped by itself; most bytes of a page that is fetched.
CLIP_LENGTH, MOST_BYTES = 80, 8 * 1024 * 1024


def clip_candidate(url: Column) -> Column:
    """Whether an address may be that of an article."""
    low = F.lower(url)
    barred = [F.startswith(low, F.lit(s)) for s in NO_PAGES] + [F.contains(low, F.lit(k)) for k in NOT_CLIPPED]
    return F.coalesce(~reduce(Column.__or__, barred), F.lit(False))


def clipped_by_itself(url: Column, text: Column) -> Column:
    """Whether a page is clipped without being asked for: an article by its address, with text enough."""
    long = F.octet_length(F.encode(F.trim(F.coalesce(text, F.lit(""))), "UTF-16BE")) / 2 >= CLIP_LENGTH
    return clip_candidate(url) & long


def fetch_error(status: Column, content_type: Column, size: Column) -> Column:
    """Why a response is no page: its status, its type or its size; null for a page."""
    kind = F.coalesce(content_type, F.lit(""))
    page = F.contains(F.lower(kind), F.lit("html")) | F.contains(F.lower(kind), F.lit("xml")) | (F.trim(kind) == "")
    return (
        F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(~page, F.concat(F.lit("非网页内容（"), kind, F.lit("）")))
        .when(size > MOST_BYTES, F.lit("页面过大（超过 8MB）"))
    )
