"""All queries of the core by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import plans
from .functions import text as T
from .functions import urls as U
from .operators import articles, lines, links, outline, page_setting, runs, tables, txt, volumes
from .operators import html_blocks as html
from .session import table
from .sources import decode, formats, presets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Shared SQL: Unicode trim, UTF-16 length, decoding of character references.
TRIM = r"regexp_replace({x}, '^[\t-\r\x{{1c}}-\x{{1f}}\p{{Z}}]+|[\t-\r\x{{1c}}-\x{{1f}}\p{{Z}}]+$', '', 'g')"
UTF16 = r"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')))"


def _named(x: str) -> str:
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " ")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _decoded(x: str) -> str:
    """SQL of decode_entities."""
    x = _named(x)
    for pattern, lead, code in (("&#x([0-9a-fA-F]+);", "&#x", "('0x' || r)::INT"), ("&#([0-9]+);", "&#", "r::INT")):
        x = (
            f"(SELECT list_reduce(list_prepend(v, list_distinct(regexp_extract_all(v, '{pattern}', 1))), "
            f"lambda acc, r: replace(acc, '{lead}' || r || ';', chr({code}))) FROM (SELECT {x} AS v))"
        )
    return x


def _visible(x: str) -> str:
    """SQL of visible_text."""
    inner = _decoded(f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')")
    return rf"trim(regexp_replace({inner}, '[\t-\r\x{{1c}}-\x{{1f}}\p{{Z}}]+', ' ', 'g'))"


CHAPTER = txt.CHAPTER.replace("'", "''")
CONTENTS = txt.CONTENTS.replace("'", "''")
TXT_SQL = rf"""
WITH t AS (
  SELECT doc_id, list_filter(list_transform(
    regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n+'),
    lambda x: regexp_replace(x, '^[\x00-\x20\x{{3000}}]+|[\x00-\x20\x{{3000}}]+$', '', 'g')), lambda x: x <> '') AS ls
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS block_index, unnest(ls) AS text FROM t),
k AS (SELECT *, {UTF16.format(x="text")} <= {txt.LONGEST_TITLE}
  AND (regexp_matches(text, '{CHAPTER}') OR regexp_matches(text, '{CONTENTS}')) AS h FROM b)
SELECT doc_id, block_index::INT AS block_index, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN h THEN 1 END AS level, text FROM k"""


@query(TXT_SQL)
def txt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Plain text to blocks."""
    return txt.blocks(table(spark, d, "documents"))


@query(f"SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_headings, min(text) FILTER (kind = 'heading') AS least_title FROM ({TXT_SQL}) GROUP BY doc_id")
def txt_outline_stats(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and headings per text."""
    heading = F.col("kind") == "heading"
    return txt.blocks(table(spark, d, "documents")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(heading).alias("n_headings"), F.min(F.when(heading, F.col("text"))).alias("least_title")
    )


HTML_SQL = rf"""
WITH c AS (SELECT article_id, regexp_extract_all(
    regexp_replace(content_html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>', '', 'g'),
    '(<[^>]*>?|[^<]+)') AS toks FROM web_articles WHERE content_html IS NOT NULL),
t AS (SELECT article_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM c),
s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(tok, '(?i)^(<img|</h\d|<h\d|</(p|div|li|blockquote|section|article|ul|ol)\s*>$|<br(>|/| )|<hr(>|/| ))')
    THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM t),
g AS (SELECT article_id, seg, coalesce(string_agg(tok, '' ORDER BY pos) FILTER (NOT starts_with(tok, '<')), '') AS raw, arg_max(tok, pos) AS closing FROM s GROUP BY ALL),
x AS (SELECT article_id, seg, closing, {TRIM.format(x=_decoded("raw"))} AS text,
    CASE WHEN regexp_matches(closing, '(?i)^</h\d') THEN substr(closing, 4, 1)::INT ELSE 0 END AS level FROM g),
u AS (
  SELECT article_id, seg, 0 AS k, CASE WHEN level > 0 THEN 'heading' ELSE 'paragraph' END AS kind, nullif(level, 0) AS level, text FROM x WHERE text <> ''
  UNION ALL SELECT article_id, seg, 1, 'hr', NULL, regexp_extract(closing, '(?i)src\s*=\s*["'']([^"'']+)["'']', 1) FROM x WHERE regexp_matches(closing, '(?i)^<hr(>|/| )')
  UNION ALL SELECT article_id, seg, 1, 'image', NULL, regexp_extract(closing, '(?i)src\s*=\s*["'']([^"'']+)["'']', 1) FROM x
    WHERE regexp_matches(closing, '(?i)^<img') AND trim(regexp_extract(closing, '(?i)src\s*=\s*["'']([^"'']+)["'']', 1)) <> '')
SELECT article_id, (row_number() OVER (PARTITION BY article_id ORDER BY seg, k) - 1)::INT AS block_index, kind, level, text FROM u"""


@query(HTML_SQL)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: all blocks of every clipped page, in order."""
    return html.blocks(table(spark, d, "web_articles"))


@query(f"SELECT kind, coalesce(level, 0) AS level, count(*) AS n_blocks, count(DISTINCT article_id) AS n_articles, sum(length(text)) AS n_chars FROM ({HTML_SQL}) GROUP BY ALL")
def html_block_stats(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of pages by kind and level."""
    return html_blocks(spark, d).groupBy("kind", F.coalesce("level", F.lit(0)).alias("level")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("article_id").alias("n_articles"), F.sum(F.length("text")).alias("n_chars")
    )


@query(f"""WITH b AS ({HTML_SQL}), c AS (SELECT article_id, count(*) AS n FROM b GROUP BY 1)
SELECT a.article_id, a.clipped_at::DATE AS day, coalesce(sum(coalesce(n, 0) + 1) OVER (PARTITION BY a.clipped_at::DATE ORDER BY ord, a.article_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_block FROM web_articles a LEFT JOIN c USING (article_id)""")
def article_block_offsets(spark: SparkSession, d: str) -> DataFrame:
    """First block of each article in its day's book."""
    a = table(spark, d, "web_articles")
    return articles.block_offsets(a, html_blocks(spark, d))


@query(rf"""SELECT article_id, {UTF16.format(x="t")}::INT AS n_chars, ({UTF16.format(x="t")} < {articles.FOLDED_LENGTH} AND
  ({" OR ".join(f"contains(t, '{m}')" for m in articles.FOLD_MARKERS)})) AS truncated
FROM (SELECT article_id, {_visible("coalesce(content_html, '')")} AS t FROM web_articles)""")
def truncation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Little text and a prompt to unfold."""
    return articles.possibly_truncated(table(spark, d, "web_articles"))


HOST = r"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


@query(rf"""SELECT article_id, coalesce(nullif({TRIM.format(x="title")}, ''),
  nullif({_visible("regexp_extract(coalesce(content_html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), nullif({HOST.format(x="url")}, ''), url) AS title FROM web_articles""")
def resolved_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title, else first heading, else domain."""
    return articles.titles(table(spark, d, "web_articles"))


def _image_sql(attribute: str) -> str:
    """SQL of one attribute's usable address in tag ``g`` of the page at ``o`` (origin) and ``f`` (folder)."""
    raw = rf"replace(trim(regexp_extract(g, '(?i)[\t\n\f\r ]{attribute}\s*=\s*[\"'']([^\"'']+)[\"'']', 1)), '&amp;', '&')"
    whole = f"""CASE WHEN starts_with({raw}, '//') THEN CASE WHEN o <> '' THEN string_split(o, '//')[1] ELSE 'https:' END || {raw}
      WHEN regexp_matches({raw}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') OR o = '' OR {raw} = '' THEN {raw}
      WHEN starts_with({raw}, '/') THEN o || {raw} WHEN f <> '' THEN f || {raw} ELSE o || '/' || {raw} END"""
    return f"""CASE WHEN NOT regexp_matches({raw}, '(?i)^data:image/svg') AND {raw} <> 'about:blank' AND regexp_matches({whole}, '(?i)^(https?://|data:image/)') THEN {whole} END"""


IMG_SQL = rf"""
WITH a AS (SELECT article_id, coalesce(regexp_extract(url, '^(https?://[^/?#]+)', 1), '') AS o, coalesce(regexp_extract(url, '^(https?://[^/?#]+/(?:[^?#]*/)?)', 1), '') AS f,
  regexp_extract_all(content_html, '(?i)<img\b[^>]*>') AS gs FROM web_articles),
t AS (SELECT article_id, o, f, generate_subscripts(gs, 1) AS k, unnest(gs) AS g FROM a),
e AS (SELECT article_id, k, coalesce({_image_sql("data-actualsrc")}, {_image_sql("data-original")}, {_image_sql("data-src")}, {_image_sql("data-origin-src")},
  {_image_sql("data-lazy-src")}, {_image_sql("data-echo")}, {_image_sql("data-url")}, {_image_sql("data-original-src")}, {_image_sql("src")}) AS url FROM t),
m AS (SELECT article_id, url, min(k) AS k FROM e WHERE url IS NOT NULL GROUP BY ALL)
SELECT article_id, (row_number() OVER (PARTITION BY article_id ORDER BY k) - 1)::INT AS img_ord, url FROM m"""


@query(IMG_SQL)
def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Image addresses of pages, lazy ones included."""
    return articles.image_urls(table(spark, d, "web_articles"))


@query(f"SELECT url, printf('img_%03d', row_number() OVER (ORDER BY a)) AS file FROM (SELECT url, min({{'x': article_id, 'y': img_ord}}) AS a FROM ({IMG_SQL}) GROUP BY url)")
def image_file_names(spark: SparkSession, d: str) -> DataFrame:
    """One file name per distinct image."""
    return articles.image_files(page_images(spark, d))


@query(rf"""SELECT article_id, coalesce(len(list_filter(regexp_extract_all(content_html, '(?i)<[a-z][^>]*\s(?:class|id)\s*=\s*["''][^"'']*["''][^>]*>'), lambda t:
  len(list_filter({list(articles.OVERLAY_KEYWORDS)!r}, lambda k: contains(lower(regexp_extract(t, '(?i)\sclass\s*=\s*["'']([^"'']*)', 1) || ' ' ||
  regexp_extract(t, '(?i)\sid\s*=\s*["'']([^"'']*)', 1)), k))) > 0)), 0)::INT AS n_overlays FROM web_articles""")
def overlay_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements named like overlays."""
    return articles.overlay_elements(table(spark, d, "web_articles"))


TABLE_CELLS = rf"""
WITH f AS (SELECT article_id, list_transform(regexp_extract_all(content_html, '(?is)<table[^>]*>.*?</table>'), lambda x: regexp_replace(x, '(?is)^.*(<table)', '\1')) AS ts FROM web_articles WHERE content_html IS NOT NULL),
t AS (SELECT article_id, generate_subscripts(ts, 1) - 1 AS n, unnest(ts) AS html FROM f),
r AS (SELECT article_id || '-' || n AS table_id, regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rs FROM t),
u AS (SELECT table_id, generate_subscripts(rs, 1) - 2 AS row_no, unnest(rs) AS tr FROM r WHERE len(list_filter(rs, lambda x: regexp_matches(x, '(?i)<th[ >]'))) > 0),
d AS (SELECT table_id, row_no, regexp_extract_all(tr, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1) AS cs FROM u),
e AS (SELECT table_id, row_no, generate_subscripts(cs, 1) - 1 AS col_no, unnest(cs) AS cell FROM d),
c AS (SELECT table_id, row_no, col_no, {_visible("cell")} AS text FROM e),
n AS (SELECT table_id, max(row_no) + 1 AS n_rows FROM u GROUP BY 1),
w AS (SELECT table_id, max(col_no) + 1 AS n_columns, coalesce(bool_or(row_no >= 0 AND {UTF16.format(x="text")} > 16), false) AS long FROM c GROUP BY 1),
k AS (SELECT table_id, n_rows::INT AS n_rows, coalesce(n_columns, 0)::INT AS n_columns, n_columns >= 3 OR (n_columns = 2 AND long) AS as_cards FROM n LEFT JOIN w USING (table_id))"""


@query(f"""{TABLE_CELLS}, h AS (SELECT table_id, col_no, text AS header FROM c WHERE row_no = -1)
SELECT c.table_id, c.row_no::INT AS row_no, c.col_no::INT AS line_no, CASE WHEN c.col_no = 0 THEN 'title' ELSE 'field' END AS role,
  CASE WHEN c.col_no = 0 THEN CASE WHEN trim(text) <> '' THEN text ELSE '第 ' || (row_no + 1) || ' 项' END
    WHEN coalesce(header, '') <> '' THEN '【' || header || '】 ' || text ELSE text END AS text
FROM c JOIN k USING (table_id) LEFT JOIN h ON h.table_id = c.table_id AND h.col_no = c.col_no WHERE k.as_cards AND row_no >= 0 AND (c.col_no = 0 OR trim(text) <> '')""")
def table_cards(spark: SparkSession, d: str) -> DataFrame:
    """Tables of pages as cards: a title and one line per filled cell."""
    t = articles.page_tables(table(spark, d, "web_articles"))
    return tables.cards(t.where(tables.shows_as_cards(F.col("headers"), F.col("rows"))))


@query(f"{TABLE_CELLS} SELECT table_id, n_rows, n_columns, as_cards FROM k")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and layout of the tables of pages."""
    t = articles.page_tables(table(spark, d, "web_articles"))
    return t.select("table_id", F.size("rows").alias("n_rows"), F.greatest(F.size("headers"), tables.column_count(F.col("rows"))).alias("n_columns"),
                    tables.shows_as_cards(F.col("headers"), F.col("rows")).alias("as_cards"))


@query(f"""{TABLE_CELLS}, x AS (SELECT table_id, col_no, max((length(text) + length(text) - length(regexp_replace(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}“”‘’—…·～–―′″‰℃℉\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}\\x{{3040}}-\\x{{30ff}}]', '', 'g'))) / 2) AS em FROM c GROUP BY ALL),
y AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS n FROM x),
z AS (SELECT table_id, col_no, em * 12 * CASE WHEN n <= 2 THEN 0.90 WHEN n = 3 THEN 0.85 WHEN n = 4 THEN 0.78 ELSE 0.72 END AS nat, 340.0 / n AS even FROM y),
l AS (SELECT *, nat <= 0.95 * even AS locked FROM z),
q AS (SELECT table_id, col_no, nat, CASE WHEN locked THEN nat ELSE (340.0 - coalesce(sum(nat) FILTER (locked) OVER (PARTITION BY table_id), 0))
  * pow(greatest(nat, 1), 0.72) / sum(pow(greatest(nat, 1), 0.72)) FILTER (NOT locked) OVER (PARTITION BY table_id) END AS raw FROM l)
SELECT table_id, col_no::INT AS col_no, round(nat::DOUBLE, 3) AS "natural", round((raw * 340.0 / sum(raw) OVER (PARTITION BY table_id))::DOUBLE, 3) AS width FROM q""")
def table_column_widths(spark: SparkSession, d: str) -> DataFrame:
    """Widths of grid columns."""
    w = tables.column_widths(articles.page_tables(table(spark, d, "web_articles")).select("table_id", "headers", "rows"), inner=340.0)
    return w.select("table_id", "col_no", F.round("natural", 3).alias("natural"), F.round("width", 3).alias("width"))


@query(rf"SELECT link_id, url, coalesce(nullif({HOST.format(x='url')}, ''), url) AS domain FROM links")
def link_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domain of each link's url."""
    return table(spark, d, "links").select("link_id", "url", U.domain(F.col("url")).alias("domain"))


CLEAN = rf"""(CASE WHEN regexp_matches(u, '[\s"<>\\^`{{|}}]') OR trim(regexp_extract(u, '^[^?#]*\?([^#]*)', 1)) = '' THEN u
  WHEN contains(lower({HOST.format(x="u")}), 'zhihu.com') AND (contains(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/answer/')
    OR starts_with(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/p/')) THEN regexp_extract(u, '^([^?#]*)', 1)
  ELSE regexp_extract(u, '^([^?#]*)', 1) || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'),
    lambda p: NOT list_contains({list(U.TRACKING)!r}, trim(lower(string_split(p, '=')[1])))), '&'), ''), '') || regexp_extract(u, '(#.*)$', 1) END)"""


@query(f"SELECT article_id, {CLEAN} AS url FROM (SELECT article_id, url AS u FROM web_articles)")
def sanitized_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs without tracking keys."""
    return table(spark, d, "web_articles").select("article_id", U.sanitized(F.col("url")).alias("url"))


FOUND_SQL = rf"SELECT DISTINCT article_id, rtrim(unnest(regexp_extract_all(content_html, '{U.FOUND.replace(chr(39), chr(39) * 2)}')), '{U.TRAILING}') AS u FROM web_articles"


@query(f"SELECT article_id, u AS url FROM ({FOUND_SQL})")
def urls_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """URLs found in running text."""
    return table(spark, d, "web_articles").select("article_id", F.explode(U.found_urls(F.col("content_html"))).alias("url"))


@query(f"SELECT url FROM (SELECT DISTINCT {CLEAN} AS url FROM ({FOUND_SQL})) WHERE trim(url) <> '' AND url NOT IN (SELECT url FROM links WHERE url IS NOT NULL)")
def new_links(spark: SparkSession, d: str) -> DataFrame:
    """Sanitised URLs of pages that are not in the list of links."""
    return links.ingest(table(spark, d, "web_articles"), table(spark, d, "links"), "content_html")


@query("""SELECT link_id, s.url, s.domain, s.status, s.error, s.article_id, epoch_us(s.updated_at) AS updated_us FROM (SELECT link_id,
  arg_max({'url': url, 'domain': domain, 'status': status, 'error': error, 'article_id': article_id, 'updated_at': updated_at},
    {'a': updated_at, 'b': status, 'c': coalesce(error, ''), 'd': coalesce(article_id, -1)}) AS s FROM links GROUP BY link_id)""")
def links_latest(spark: SparkSession, d: str) -> DataFrame:
    """Last state of each link."""
    return links.latest(table(spark, d, "links")).withColumn("updated_us", F.unix_micros("updated_at")).drop("updated_at")


@query(rf"SELECT coalesce(domain, nullif({HOST.format(x='url')}, ''), url) AS domain, status, count(*) AS n_links, count(error) AS n_with_error FROM links GROUP BY ALL")
def link_status(spark: SparkSession, d: str) -> DataFrame:
    """Links by domain and status."""
    return links.status_summary(table(spark, d, "links"))


@query("""WITH c AS (SELECT DISTINCT url FROM web_articles WHERE url IS NOT NULL)
SELECT url, 0 AS batch, count(*) AS n FROM links WHERE url NOT IN (SELECT url FROM c) GROUP BY url UNION ALL SELECT url, 1, 1 FROM c""")
def links_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Links after clipped pages took the place of equal urls."""
    clipped = table(spark, d, "web_articles").where("url is not null").select("url").distinct()
    return links.upsert(table(spark, d, "links").select("url"), clipped).groupBy("url", "batch").agg(F.count(F.lit(1)).alias("n"))


DOMAINS = "banshan.example, beihu.example;paperlamp"


@query(rf"""SELECT article_id, len(list_filter(list_filter(list_transform(regexp_split_to_array('{DOMAINS}', '[,;\n ]'), lambda x: lower(trim(x))), lambda x: x <> ''),
  lambda x: h = x OR ends_with(h, '.' || x) OR contains(lower(url), x))) > 0 AS direct
FROM (SELECT article_id, url, coalesce(nullif(lower({HOST.format(x="url")}), ''), lower(url)) AS h FROM web_articles)""")
def routed_domains(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose domain is on a list."""
    return table(spark, d, "web_articles").select("article_id", U.routed(F.col("url"), F.lit(DOMAINS)).alias("direct"))


@query("SELECT DISTINCT url, regexp_full_match(url, 'https?://.*\\.example/p/.*') AS hit FROM links")
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    """URLs by match pattern."""
    globs = spark.createDataFrame([("http://*.example/p/*",), ("https://*.example/p/*",)], "glob string").select(U.glob_regex(F.col("glob")).alias("r"))
    seen = table(spark, d, "links").select("url").distinct()
    return seen.crossJoin(F.broadcast(globs)).groupBy("url").agg(F.max(F.expr("url rlike r")).alias("hit"))  # two patterns


FORMATS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in formats.BY_EXTENSION.items())


@query(rf"""SELECT doc_id, ext, coalesce(CASE ext {FORMATS} END, CASE
  WHEN starts_with(h, '255044462D') THEN 'pdf'
  WHEN n >= 78 AND (substr(h, 121, 8) = '424F4F4B' OR substr(h, 129, 8) = '4D4F4249') THEN 'mobi'
  WHEN regexp_matches(h, '^504B0[357]0[468]') AND (contains(h, '5B436F6E74656E745F54797065735D2E786D6C') OR contains(h, '776F72642F646F63756D656E742E786D6C')) THEN 'docx'
  WHEN regexp_matches(h, '^504B0[357]0[468]') THEN 'epub' ELSE 'txt' END) AS format
FROM (SELECT doc_id, coalesce(lower(regexp_extract(file_name, '\.([^.]*)$', 1)), '') AS ext, hex(coalesce(content, ''::BLOB)) AS h, octet_length(coalesce(content, ''::BLOB)) AS n FROM text_sources)""")
def file_formats(spark: SparkSession, d: str) -> DataFrame:
    """Format of each stored file."""
    return formats.routed(table(spark, d, "text_sources"))


@query("""SELECT doc_id, CASE WHEN starts_with(hex(content), 'EFBBBF') THEN 'utf-8-bom' WHEN starts_with(hex(content), 'FFFE') THEN 'utf-16le'
  WHEN starts_with(hex(content), 'FEFF') THEN 'utf-16be' WHEN content IS NULL THEN 'gbk' WHEN TRY(decode(content)) IS NOT NULL THEN 'utf-8' ELSE 'gbk' END AS charset FROM text_sources""")
def file_charsets(spark: SparkSession, d: str) -> DataFrame:
    """Charset of each stored file."""
    return table(spark, d, "text_sources").select("doc_id", formats.charset(F.col("content")).alias("charset"))


@query("""SELECT doc_id, CASE WHEN starts_with(hex(content), 'EFBBBF') THEN 'utf-8-bom' WHEN content IS NULL THEN 'gbk' WHEN TRY(decode(content)) IS NOT NULL THEN 'utf-8' ELSE 'gbk' END AS charset FROM text_sources""")
def markup_charsets(spark: SparkSession, d: str) -> DataFrame:
    """Charset of each stored file where no UTF-16 is expected."""
    return table(spark, d, "text_sources").select("doc_id", formats.charset(F.col("content"), with_utf16=False).alias("charset"))


@query()
def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Stored files decoded and cut into blocks."""
    return txt.blocks(decode.file_texts(table(spark, d, "text_sources")))


def _count(char_class: str) -> str:
    import re

    c = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", char_class)
    return f"(length(text) - length(regexp_replace(text, '[{c}]', '', 'g')))"


@query(f"""SELECT doc_id, {_count(T.HAN)} AS n_han, {_count(T.CJK)} AS n_cjk, {_count(T.LATIN)} AS n_latin, {_count(T.BOX_DRAWING)} AS n_box,
  (length(text) + {_count(T.CJK)}) / 2 AS em, length(text) + {_count(T.TWO_COLUMNS)} AS columns FROM documents WHERE text IS NOT NULL""")
def character_classes(spark: SparkSession, d: str) -> DataFrame:
    """Characters by class, width in em and in grid columns."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", T.count_of(t, T.HAN).cast("long").alias("n_han"), T.count_of(t, T.CJK).cast("long").alias("n_cjk"), T.count_of(t, T.LATIN).cast("long").alias("n_latin"),
        T.count_of(t, T.BOX_DRAWING).cast("long").alias("n_box"), T.em_width(t).alias("em"), T.grid_columns(t).cast("long").alias("columns"),
    )


@query(f"SELECT run_id, any_value({_decoded('text')}) AS text FROM text_runs WHERE text IS NOT NULL GROUP BY run_id")
def decoded_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with character references decoded."""
    return table(spark, d, "text_runs").where("text is not null").dropDuplicates(["run_id"]).select("run_id", T.decode_entities(F.col("text")).alias("text"))


@query("""SELECT article_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS title
  FROM web_articles WHERE title IS NOT NULL""")
def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles for XML."""
    return table(spark, d, "web_articles").where("title is not null").select("article_id", T.xml_escape(F.col("title")).alias("title"))


def _shifted(forms: tuple[str, str], mark: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(t, '[{forms[0].replace('-', chr(92) + '-')} ]*') THEN translate(t, '{forms[0]}', '{forms[1]}') "
        f"WHEN length(t) = 1 THEN '{mark}' || t ELSE '{mark}(' || t || ')' END"
    )


@query(f"""SELECT doc_id, toc_ord, {_shifted(T.RAISED, '^')} AS raised, {_shifted(T.LOWERED, '_')} AS lowered
  FROM (SELECT doc_id, toc_ord, regexp_extract(lower(title), '[0-9a-z+=()-]+') AS t FROM toc WHERE title IS NOT NULL)""")
def raised_and_lowered(spark: SparkSession, d: str) -> DataFrame:
    """Raised and lowered forms of the first number or word of each title."""
    t = F.regexp_extract(F.lower("title"), "[0-9a-z+=()-]+", 0)
    return table(spark, d, "toc").where("title is not null").select("doc_id", "toc_ord", T.superscript(t).alias("raised"), T.subscript(t).alias("lowered"))


@query(f"""SELECT doc_id, block_index, CASE WHEN contains('{T.RIGHT_BLANK}', c) THEN 0.75 WHEN contains('{T.LINE_START_FORBIDDEN.replace("'", "''")}', c) THEN 0.5 ELSE 0.0 END::DOUBLE AS hang
  FROM (SELECT doc_id, block_index, right(text, 1) AS c FROM blocks WHERE text IS NOT NULL AND text <> '')""")
def optical_hangs(spark: SparkSession, d: str) -> DataFrame:
    """How far the last mark of a block may hang over."""
    return table(spark, d, "blocks").where("text is not null and text <> ''").select("doc_id", "block_index", T.optical_hang(F.col("text")).alias("hang"))


SIZES_SQL = rf"""SELECT *, CASE WHEN n_blocks < 300 OR est_pages <= 600 THEN 1 WHEN est_pages <= 1100 THEN 2 WHEN est_pages <= 1700 THEN 3 WHEN est_pages <= 2400 THEN 4
  WHEN est_pages <= 3200 THEN 5 ELSE least(greatest(est_pages // 500, 2), 10) END::INT AS auto_volumes FROM (
  SELECT *, greatest(n_chars // 250, n_blocks // 4)::BIGINT AS est_pages FROM (SELECT doc_id, count(*) AS n_blocks,
    sum(CASE WHEN kind IN {volumes.COUNTED_KINDS} THEN coalesce({UTF16.format(x="text")}, 0) ELSE 0 END)::BIGINT AS n_chars FROM blocks GROUP BY doc_id))"""


@query(SIZES_SQL)
def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Characters, pages and volumes of each document."""
    return volumes.document_sizes(table(spark, d, "blocks"))


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks),
h AS (SELECT doc_id, any_value(n) AS n, list(DISTINCT pos) FILTER (kind = 'heading' AND pos > 0) AS hs FROM r GROUP BY doc_id),
e AS (SELECT r.doc_id, list(r.pos) AS es FROM toc t JOIN r ON r.doc_id = t.doc_id AND r.block_index = t.block_index WHERE r.pos > 0 GROUP BY 1),
c AS (SELECT h.doc_id, n, CASE WHEN len(coalesce(es, [])) >= 2 THEN es WHEN len(coalesce(hs, [])) >= 2 THEN hs ELSE [] END AS ps FROM h LEFT JOIN e USING (doc_id)),
k AS (SELECT doc_id, n, CASE WHEN n < 2 THEN NULL WHEN len(ps) = 0 THEN n // 2 ELSE list_min(list_transform(ps, lambda p: {'d': abs(p - n // 2), 'p': p})).p END AS cut FROM c),
v AS (SELECT doc_id, 0 AS vol_index, CASE WHEN cut IS NULL THEN 1 ELSE 2 END AS total, CASE WHEN cut IS NULL THEN '全一卷' ELSE '上册' END AS label, 0 AS start_pos, coalesce(cut, n) AS end_pos FROM k
  UNION ALL SELECT doc_id, 1, 2, '下册', cut, n FROM k WHERE cut IS NOT NULL)
SELECT doc_id, vol_index, total, label, start_pos::INT AS start_pos, end_pos::INT AS end_pos FROM v WHERE start_pos < end_pos""")
def volumes_in_two(spark: SparkSession, d: str) -> DataFrame:
    """Documents in two volumes."""
    return volumes.volumes(table(spark, d, "blocks"), table(spark, d, "toc"), 2)


def _volumes_sql(n: int) -> str:
    """SQL of ``n`` volumes: cuts follow one another in a recursion."""
    return f"""
WITH RECURSIVE r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1)::INT AS pos, (count(*) OVER (PARTITION BY doc_id))::INT AS n FROM blocks),
h AS (SELECT doc_id, any_value(n) AS n, coalesce(list(DISTINCT pos) FILTER (kind = 'heading' AND pos > 0), []) AS hs FROM r GROUP BY doc_id),
e AS (SELECT r.doc_id, list(r.pos) AS es FROM toc t JOIN r ON r.doc_id = t.doc_id AND r.block_index = t.block_index WHERE r.pos > 0 GROUP BY 1),
c AS (SELECT h.doc_id, n, CASE WHEN len(coalesce(es, [])) >= {n} THEN es WHEN len(hs) >= {n} THEN hs ELSE [] END AS ps FROM h LEFT JOIN e USING (doc_id)),
cut AS (SELECT doc_id, n, ps, 0 AS v, 0 AS a FROM c WHERE n >= {n} UNION ALL
  SELECT doc_id, n, ps, v + 1, CASE WHEN len(ps) = 0 THEN n // {n} * (v + 1) ELSE coalesce(
    list_min(list_transform(list_filter(ps, lambda p: p > a), lambda p: {{'d': abs(p - floor((v + 1) * (n::FLOAT / {n}::FLOAT))::INT), 'p': p}})).p,
    greatest(least(greatest((a + floor((v + 1) * (n::FLOAT / {n}::FLOAT))::INT) // 2, a + 1), n - 1), a)) END FROM cut WHERE v < {n - 1}),
w AS (SELECT doc_id, v AS vol_index, a AS start_pos, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY v), n) AS end_pos, {n} AS total FROM cut
  UNION ALL SELECT doc_id, 0, 0, n, 1 FROM c WHERE n < {n}),
vols AS (SELECT doc_id, vol_index::INT AS vol_index, total, CASE WHEN total = 1 THEN '全一卷' WHEN total = 3 THEN ['上册', '中册', '下册'][vol_index + 1] ELSE '第' || (vol_index + 1) || '卷' END AS label,
  start_pos::INT AS start_pos, end_pos::INT AS end_pos FROM w WHERE start_pos < end_pos)"""


@query(_volumes_sql(3) + " SELECT * FROM vols")
def volumes_in_three(spark: SparkSession, d: str) -> DataFrame:
    """Documents in three volumes."""
    return volumes.volumes(table(spark, d, "blocks"), table(spark, d, "toc"), 3)


@query(_volumes_sql(5) + " SELECT * FROM vols")
def volumes_in_five(spark: SparkSession, d: str) -> DataFrame:
    """Documents in five volumes."""
    return volumes.volumes(table(spark, d, "blocks"), table(spark, d, "toc"), 5)


@query(_volumes_sql(4) + " SELECT * FROM vols")
def volumes_in_four(spark: SparkSession, d: str) -> DataFrame:
    """Documents in four volumes."""
    return volumes.volumes(table(spark, d, "blocks"), table(spark, d, "toc"), 4)


@query(_volumes_sql(3) + """ SELECT t.doc_id, vol_index, toc_ord, title, t.level, (r.pos - start_pos)::INT AS block_index FROM toc t
JOIN r ON r.doc_id = t.doc_id AND r.block_index = t.block_index JOIN vols v ON v.doc_id = t.doc_id AND r.pos >= v.start_pos AND r.pos < v.end_pos""")
def volume_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of three volumes, counted from each volume's start."""
    return volumes.volume_outline(table(spark, d, "blocks"), table(spark, d, "toc"), 3)


@query("""SELECT t.doc_id, t.toc_ord, t.title, t.level, (SELECT max(p.toc_ord) FROM toc p WHERE p.doc_id = t.doc_id AND p.toc_ord < t.toc_ord AND p.level < t.level) AS parent_ord FROM toc t""")
def outline_parents(spark: SparkSession, d: str) -> DataFrame:
    """Nesting of outline entries."""
    return outline.parents(table(spark, d, "toc"))


@query("""SELECT t.doc_id, toc_ord, t.title, t.level, CASE WHEN b.doc_id IS NOT NULL THEN t.block_index ELSE h.m END AS block_index FROM toc t
  LEFT JOIN (SELECT DISTINCT doc_id, block_index FROM blocks) b ON b.doc_id = t.doc_id AND b.block_index = t.block_index
  LEFT JOIN (SELECT doc_id, text, min(block_index) AS m FROM blocks WHERE kind = 'heading' GROUP BY ALL) h ON h.doc_id = t.doc_id AND h.text = t.title""")
def outline_located(spark: SparkSession, d: str) -> DataFrame:
    """Outline entries with their blocks."""
    return outline.located(table(spark, d, "toc"), table(spark, d, "blocks"))


@query("SELECT doc_id, level, title, min(toc_ord) AS toc_ord FROM toc GROUP BY ALL")
def outline_distinct(spark: SparkSession, d: str) -> DataFrame:
    """First of equal outline entries."""
    return table(spark, d, "toc").groupBy("doc_id", "level", "title").agg(F.min("toc_ord").alias("toc_ord"))


@query()
def without_printed_contents(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without the printed table of contents."""
    return outline.without_contents(table(spark, d, "blocks"))


@query("SELECT doc_id, kind, count(*) AS n_blocks, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, max(level) AS max_level FROM blocks GROUP BY ALL")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by document and kind."""
    return table(spark, d, "blocks").groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.max("level").alias("max_level")
    )


@query("""SELECT doc_id, block_index FROM (SELECT doc_id, block_index, kind, lead(kind) OVER w AS k, lead(text) OVER w AS t FROM blocks
  WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)) WHERE kind = 'heading' AND k = 'paragraph' AND length(t) >= 8""")
def headings_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Headings followed by a paragraph."""
    w = W.partitionBy("doc_id").orderBy("block_index")
    b = table(spark, d, "blocks").select("doc_id", "block_index", "kind", F.lead("kind").over(w).alias("k"), F.lead("text").over(w).alias("t"))
    return b.where("kind = 'heading' and k = 'paragraph' and length(t) >= 8").select("doc_id", "block_index")


STYLE_SQL = ", ".join(runs.STYLE)


@query(f"""WITH c AS (SELECT DISTINCT * FROM text_runs WHERE text IS NOT NULL AND text <> ''),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR ({" AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in runs.STYLE)}) THEN 0 ELSE 1 END AS b
  FROM c WINDOW w AS (PARTITION BY doc_id, block_index ORDER BY run_index, run_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, block_index ORDER BY run_index, run_id) AS seg FROM f)
SELECT doc_id, block_index, seg::BIGINT AS seg, string_agg(text, '' ORDER BY run_index, run_id) AS text, {STYLE_SQL} FROM s GROUP BY doc_id, block_index, seg, {STYLE_SQL}""")
def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring runs of equal style as one."""
    return runs.merged(table(spark, d, "text_runs"))


@query(r"""SELECT doc_id, regexp_replace(file_name, '\.[^.]*$', '') || '.pdf' AS whole, regexp_replace(file_name, '\.[^.]*$', '') || '_上册.pdf' AS first FROM text_sources WHERE file_name IS NOT NULL""")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of output files."""
    base = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return table(spark, d, "text_sources").where("file_name is not null").select("doc_id", F.concat(base, F.lit(".pdf")).alias("whole"), F.concat(base, F.lit("_上册.pdf")).alias("first"))


@query()
def article_tree_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of pages by a walk over their elements."""
    return plans.article_blocks(table(spark, d, "web_articles")).select(*plans.FLAT)


@query()
def extracted_articles(spark: SparkSession, d: str) -> DataFrame:
    """Main content of pages by the best-scoring element."""
    return plans.extracted(table(spark, d, "web_articles"))


@query()
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts read as Markdown."""
    return plans.markdown_blocks(table(spark, d, "documents")).select(*plans.FLAT)


@query()
def markdown_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of texts read as Markdown."""
    return plans.markdown_outline(table(spark, d, "documents"))


@query()
def formula_texts(spark: SparkSession, d: str) -> DataFrame:
    """Formulas as text."""
    return plans.formula_texts(table(spark, d, "blocks"))


@query()
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stored files of every format as blocks."""
    return plans.file_documents(table(spark, d, "text_sources"))


@query()
def laid_out_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines on pages."""
    return plans.pages(table(spark, d, "blocks"))


@query()
def page_extents(spark: SparkSession, d: str) -> DataFrame:
    """Lines per page, with the room they leave."""
    lines = plans.pages(table(spark, d, "blocks"))
    return lines.groupBy("doc_id", "page_index").agg(
        F.min("y").alias("top"), F.max(F.col("y") + F.col("font_size") * 1.5).alias("bottom"), F.count_if(F.col("text") != "").alias("n_lines")
    )


@query()
def block_pages(spark: SparkSession, d: str) -> DataFrame:
    """First page of each block."""
    return outline.first_pages(plans.pages(table(spark, d, "blocks")))


@query()
def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Outline entries with the pages they open."""
    blocks = table(spark, d, "blocks")
    return outline.bookmarks(table(spark, d, "toc"), blocks, plans.pages(blocks))


@query()
def epub_books(spark: SparkSession, d: str) -> DataFrame:
    """Articles as EPUB packages: size and checksum."""
    return plans.epub_packages(table(spark, d, "web_articles")).select("article_id", F.octet_length("epub").alias("size"), "crc")


@query()
def justified_lines(spark: SparkSession, d: str) -> DataFrame:
    """Character spacing of lines on pages."""
    lines = page_setting.justified(plans.pages(table(spark, d, "blocks")), measure=255.0)
    return lines.select("doc_id", "page_index", "elem_ord", F.round("spacing", 4).alias("spacing"), F.round("shift", 4).alias("shift"))


@query()
def vertically_aligned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines spread over the height of their page."""
    lines = page_setting.aligned_vertically(plans.pages(table(spark, d, "blocks")), height=340.0)
    return lines.select("doc_id", "page_index", "elem_ord", F.round("new_y", 4).alias("y"))


@query(f"""SELECT doc_id, block_index, columns, 52 AS target, round(greatest(6.5, least(9.6, 255.0 / ((least(columns, 52) + 1) / 2.0))), 4)::DOUBLE AS size FROM (
  SELECT doc_id, block_index, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x) + {_count(T.TWO_COLUMNS).replace("text", "x")})) AS columns
  FROM blocks WHERE kind = 'code' AND text IS NOT NULL)""")
def code_grids(spark: SparkSession, d: str) -> DataFrame:
    """Grid width and font size of code blocks."""
    g = page_setting.code_grid(table(spark, d, "blocks"), inner=255.0)
    return g.select("doc_id", "block_index", F.col("columns").cast("long").alias("columns"), F.col("target"), F.round("size", 4).alias("size"))


@query("""SELECT doc_id, translate(text, '►▶◄◀▲△▼▽◦○▪▫■✓✔✗✘─━│┃┌┐└┘├┤┬┴┼╭╮╰╯☐☑±×÷≠≤≥≈≡∞√∛∜∫∬∭∮∑∏∂∇∈∉⊂⊆∩∪∀∃⇒⇐⇔↦⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿⁱ₀₁₂₃₄₅₆₇₈₉₊₋ₐₑᵢₙₘᵣₛₜᵤᵥₓℝℕℤℚℂ',
  '→→←←↑↑↓↓··•·•vvxx——||+++++++++++++□v+*/=<>~=ovvvSSSSΣΠdVee<<nuAE><=>0123456789+-ni0123456789+-aeinmrstuvxRNZQC') AS text FROM documents WHERE text IS NOT NULL""")
def glyph_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with signs replaced that fonts often lack."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", page_setting.with_fallbacks(F.col("text")).alias("text"))


@query()
def file_parts(spark: SparkSession, d: str) -> DataFrame:
    """Stored files in four parts, cut at line ends."""
    return plans.file_parts(table(spark, d, "text_sources"), 4)


@query("SELECT doc_id, round((1 + 0.4 * (CASE least(greatest(level, 1), 6) WHEN 1 THEN 1 WHEN 2 THEN 0.72 WHEN 3 THEN 0.48 WHEN 4 THEN 0.28 WHEN 5 THEN 0.14 ELSE 0.06 END))::DOUBLE, 6) AS scale, count(*) AS n FROM blocks WHERE kind = 'heading' AND level IS NOT NULL GROUP BY ALL")
def heading_scales(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of headings relative to the text."""
    heads = table(spark, d, "blocks").where("kind = 'heading' and level is not null")
    return heads.groupBy("doc_id", F.round(T.heading_scale(F.col("level")), 6).alias("scale")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, min(block_index) AS first_block, max(block_index) AS last_block, count(*) AS n_blocks FROM blocks WHERE kind <> 'image' GROUP BY doc_id")
def without_images(spark: SparkSession, d: str) -> DataFrame:
    """Documents with images hidden."""
    return table(spark, d, "blocks").where("kind <> 'image'").groupBy("doc_id").agg(
        F.min("block_index").alias("first_block"), F.max("block_index").alias("last_block"), F.count(F.lit(1)).alias("n_blocks")
    )


@query()
def parameter_sets(spark: SparkSession, d: str) -> DataFrame:
    """Layout parameters of documents by language: JSON read with defaults and written again."""
    own = F.when(F.col("lang") == "zh", F.lit('{"textAlignment": "JUSTIFY", "fontSize": 13}')).otherwise(F.lit('{"textAlignment": "SIDEWAYS"}'))
    sets = table(spark, d, "documents").select("lang").distinct().select("lang", own.alias("json"))
    return sets.select("lang", presets.params_to_json(presets.params_from_json(F.col("json"))).alias("params"))


@query(r"""SELECT doc_id, coalesce(CASE WHEN n >= 3 AND starts_with(h, 'FFD8') THEN 'jpg' WHEN n >= 8 AND starts_with(h, '89504E47') THEN 'png' WHEN n >= 6 AND starts_with(h, '474946') THEN 'gif'
    WHEN n >= 12 AND starts_with(h, '5249') AND substr(h, 17, 8) = '57454250' THEN 'webp' END, CASE WHEN ext = 'jpeg' THEN 'jpg' WHEN ext IN ('jpg', 'png', 'gif', 'webp', 'bmp') THEN ext END, 'png') AS by_name,
  CASE WHEN n > 3 AND starts_with(h, 'FFD8') THEN 'jpg' WHEN n > 8 AND starts_with(h, '8950') THEN 'png' WHEN n > 6 AND starts_with(h, '4749') THEN 'gif' WHEN n > 12 AND substr(h, 17, 4) = '5745' THEN 'webp'
    WHEN n > 2 AND starts_with(h, '424D') THEN 'bmp' ELSE 'jpg' END AS stored_as,
  starts_with(h, 'FFD8FF') OR starts_with(h, '89504E47') OR starts_with(h, '47494638') OR starts_with(h, '424D') OR (starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250') AS image
FROM (SELECT doc_id, hex(coalesce(content, ''::BLOB)) AS h, octet_length(coalesce(content, ''::BLOB)) AS n, lower(regexp_extract(string_split(coalesce(file_name, ''), '?')[1], '\\.([^.]*)$', 1)) AS ext FROM text_sources)""".replace("\\\\", "\\"))
def image_formats(spark: SparkSession, d: str) -> DataFrame:
    """What stored files would be as images, by the three rules for downloads, packages and archives."""
    content, name = F.coalesce("content", F.lit(b"")), F.coalesce("file_name", F.lit(""))
    return table(spark, d, "text_sources").select(
        "doc_id", formats.image_format_or_suffix(content, name).alias("by_name"), formats.image_suffix(content).alias("stored_as"), formats.is_image(content).alias("image")
    )


@query("""SELECT link_id, url, coalesce(NOT (starts_with(lower(url), 'about:') OR starts_with(lower(url), 'chrome://') OR starts_with(lower(url), 'javascript:') OR
  regexp_matches(lower(url), 'login|signin|passport|account|unhuman|captcha|verify|security|search\\?|/search')), false) AS candidate FROM links""".replace("\\\\", "\\"))
def clip_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Links that may be articles."""
    return table(spark, d, "links").select("link_id", "url", U.clip_candidate(F.col("url")).alias("candidate"))


@query(rf"""SELECT article_id, coalesce(NOT (starts_with(lower(url), 'about:') OR starts_with(lower(url), 'chrome://') OR starts_with(lower(url), 'javascript:') OR
  regexp_matches(lower(url), 'login|signin|passport|account|unhuman|captcha|verify|security|search\?|/search')), false) AND {UTF16.format(x="t")} >= 80 AS clipped
FROM (SELECT article_id, url, trim({_visible("coalesce(content_html, '')")}) AS t FROM web_articles)""")
def pages_clipped_by_themselves(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are clipped without being asked for."""
    text = articles.visible_text(F.coalesce("content_html", F.lit("")))
    return table(spark, d, "web_articles").select("article_id", U.clipped_by_itself(F.col("url"), text).alias("clipped"))


@query(f"""SELECT url, CASE WHEN contains(h, 'zhimg.com') THEN 'https://www.zhihu.com/' WHEN contains(h, 'qpic.cn') OR contains(h, 'weixin.qq.com') THEN 'https://mp.weixin.qq.com/'
  WHEN contains(h, 'csdnimg.cn') OR contains(h, 'csdn.net') THEN 'https://blog.csdn.net/' WHEN contains(h, 'sinaimg.cn') OR contains(h, 'weibo.com') THEN 'https://weibo.com/'
  ELSE 'https://' || h || '/' END AS referer FROM (SELECT DISTINCT url, coalesce(lower({HOST.format(x="url")}), '') AS h FROM ({IMG_SQL}))""")
def image_referers(spark: SparkSession, d: str) -> DataFrame:
    """Referer for each image."""
    return page_images(spark, d).select("url").distinct().select("url", U.referer(F.col("url")).alias("referer"))


@query("""WITH f AS (SELECT doc_id, octet_length(content) AS size, CASE WHEN content IS NULL THEN 404 ELSE 200 END AS status,
  CASE lower(regexp_extract(file_name, '[.]([^.]*)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'TEXT/HTML; charset=gbk' WHEN 'txt' THEN 'text/plain' ELSE '' END AS kind FROM text_sources)
SELECT doc_id, CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status WHEN kind <> '' AND NOT contains(lower(kind), 'html') AND NOT contains(lower(kind), 'xml') THEN '非网页内容（' || kind || '）'
  WHEN size > 8388608 THEN '页面过大（超过 8MB）' END AS error FROM f""")
def fetch_errors(spark: SparkSession, d: str) -> DataFrame:
    """Why files, taken for responses, would be no pages."""
    ext = formats.extension(F.col("file_name"))
    kind = F.when(ext == "html", "text/html").when(ext == "htm", "TEXT/HTML; charset=gbk").when(ext == "txt", "text/plain").otherwise("")
    status = F.when(F.col("content").isNull(), 404).otherwise(200)
    return table(spark, d, "text_sources").select("doc_id", U.fetch_error(status, kind, F.octet_length("content")).alias("error"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
b AS (SELECT doc_id, line_no, regexp_replace(line, '^[\t-\r\x{1c}-\x{1f}\p{Z}]+|[\t-\r\x{1c}-\x{1f}\p{Z}]+$', '', 'g') AS line FROM l WHERE contains(line, '|')),
m AS (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(replace(line, '\|', chr(1)), '^[|]', ''), '[|]$', ''), '|') AS cs FROM b)
SELECT doc_id, line_no::INT AS line_no, len(cs)::INT AS n_cells, array_to_string(list_transform(cs, lambda c:
  regexp_replace(replace(c, chr(1), '|'), '^[\t-\r\x{1c}-\x{1f}\p{Z}]+|[\t-\r\x{1c}-\x{1f}\p{Z}]+$', '', 'g')), ' ¦ ') AS cells FROM m""")
def pipe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells of lines with pipes."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cells = tables.pipe_cells(F.col("line"))
    return lines.where(F.contains("line", F.lit("|"))).select("doc_id", "line_no", F.size(cells).alias("n_cells"), F.array_join(cells, " ¦ ").alias("cells"))


def _glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Outline titles as if printed: ten lines a page, a glyph per character, blanks as gaps."""
    toc = table(spark, d, "toc").where("title is not null")
    chars = F.filter(F.transform(F.split("title", ""), lambda c, i: F.struct(i.alias("i"), c.alias("ch"))), lambda g: (F.trim(g["ch"]) != "") & (g["ch"] != "\u3000"))
    each = toc.select("doc_id", "toc_ord", F.explode(chars).alias("g"))
    return each.select(
        "doc_id", (F.floor(F.col("toc_ord") / 10)).cast("int").alias("page"), ((F.col("toc_ord") % 10) * 80.0 + F.col("g.i") % 2).alias("y"),
        (F.col("g.i") * 10.0).alias("x"), F.lit(10.0).alias("w"), F.lit(9.0).alias("h"), F.col("g.ch").alias("ch"),
    )


GLYPH_LINES_SQL = """
g0 AS (SELECT doc_id, (toc_ord // 10)::INT AS page, toc_ord % 10 AS row_at, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS ch FROM (SELECT doc_id, toc_ord, string_split(title, '') AS cs FROM toc WHERE title IS NOT NULL)),
g1 AS (SELECT *, row_at * 80.0 + i % 2 AS y, lag(i) OVER (PARTITION BY doc_id, page, row_at ORDER BY i) AS before FROM g0 WHERE trim(ch) <> '' AND ch <> '\u3000'),
g2 AS (SELECT doc_id, page, row_at, min(y) AS y, string_agg(CASE WHEN (i - before - 1) * 10 > 9 THEN ' ' || ch ELSE ch END, '' ORDER BY i) AS text FROM g1 GROUP BY ALL),
g3 AS (SELECT doc_id, page, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY row_at) - 1)::BIGINT AS line_no, y::DOUBLE AS y, text FROM g2)"""


@query(f"WITH {GLYPH_LINES_SQL} SELECT * FROM g3")
def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of positioned glyphs."""
    return lines.glyph_lines(_glyphs(spark, d))


PRINTED_SQL = f"""WITH {GLYPH_LINES_SQL},
m AS (SELECT *, line_no = min(line_no) OVER p AS is_first, line_no = max(line_no) OVER p AS is_last FROM g3 WINDOW p AS (PARTITION BY doc_id, page)),
j AS (SELECT m.*, b.text AS before FROM m LEFT JOIN m b ON b.doc_id = m.doc_id AND b.page = m.page - 1 AND b.is_first),
kept AS (SELECT doc_id, page, line_no, y, text FROM j WHERE NOT coalesce((is_first AND y < 80) OR (is_last AND y > 720) OR (is_first AND text = before AND length(text) <= 24)
  OR ((is_first OR is_last) AND regexp_matches(text, '(?i)^\\s*(?:[-–—]?\\s*\\d{{1,4}}\\s*[-–—]?|第\\s*\\d{{1,4}}\\s*页|page\\s+\\d{{1,4}}(?:\\s+of\\s+\\d{{1,4}})?|\\d{{1,4}}\\s*/\\s*\\d{{1,4}})\\s*$')), false))"""


@query(PRINTED_SQL + " SELECT * FROM kept")
def lines_without_running_heads(spark: SparkSession, d: str) -> DataFrame:
    """Printed lines without page numbers and running heads."""
    return lines.without_running_heads(printed_lines(spark, d), 800.0)


@query(PRINTED_SQL + " SELECT doc_id, page, 0 AS par_no, string_agg(text, '' ORDER BY line_no) AS text FROM kept GROUP BY doc_id, page")
def printed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Printed lines as paragraphs; no line is blank here, so a page is one."""
    return lines.paragraphs(lines_without_running_heads(spark, d))


@query("""SELECT t.doc_id, t.toc_ord, t.title, t.level, f.b AS block_index FROM toc t JOIN (SELECT doc_id, block_index // 10 AS page, min(block_index) AS b FROM blocks GROUP BY ALL) f
  ON f.doc_id = t.doc_id AND f.page = t.toc_ord // 3""")
def outline_by_page(spark: SparkSession, d: str) -> DataFrame:
    """An outline of pages as an outline of blocks, with ten blocks and three entries to a page."""
    paged = table(spark, d, "blocks").withColumn("page", F.floor(F.col("block_index") / 10))
    return lines.page_outline(table(spark, d, "toc").withColumn("page", F.floor(F.col("toc_ord") / 3)), paged)


@query("""WITH l AS (SELECT DISTINCT link_id, coalesce(article_id, -1) % 7 AS batch FROM links), o AS (SELECT batch, link_id, (row_number() OVER (PARTITION BY batch ORDER BY link_id) - 1)::INT AS ord, (count(*) OVER (PARTITION BY batch))::INT AS n FROM
  (SELECT link_id, min(batch) AS batch FROM l GROUP BY 1)), m AS (SELECT batch, ord AS a, n FROM o WHERE link_id = 20)
SELECT o.batch, link_id, ord, CASE WHEN m.a IS NULL OR m.a + 3 >= m.n THEN ord WHEN ord = m.a THEN ord + 3 WHEN ord > m.a AND ord <= m.a + 3 THEN ord - 1 ELSE ord END::INT AS new_ord FROM o LEFT JOIN m USING (batch)""")
def moved_links(spark: SparkSession, d: str) -> DataFrame:
    """The order of links after one has moved down by three places."""
    batch = F.coalesce("article_id", F.lit(-1)) % 7
    each = table(spark, d, "links").groupBy("link_id").agg(F.min(batch).alias("batch"))
    placed = each.withColumn("ord", F.row_number().over(W.partitionBy("batch").orderBy("link_id")) - 1)
    return links.moved(placed, 20, 3).select("batch", "link_id", "ord", "new_ord")


@query("""SELECT 'set ' || coalesce(lang, 'none') AS name, '{"fontSize":' || (10 + length(coalesce(lang, ''))) || '.0}' AS params FROM (SELECT DISTINCT lang FROM documents)""")
def settings_restored(spark: SparkSession, d: str) -> DataFrame:
    """Presets after a backup was written and read again."""
    langs = table(spark, d, "documents").select("lang").distinct()
    size = (10 + F.length(F.coalesce("lang", F.lit("")))).cast("double")
    sets = langs.select(F.concat(F.lit("set "), F.coalesce("lang", F.lit("none"))).alias("name"), F.to_json(F.struct(size.alias("fontSize"))).alias("params"))
    settings = spark.createDataFrame([("concurrency", "3")], "key string, value string")
    return presets.restored(presets.backup(sets, settings))


SCRIPT = """// ==UserScript==
// @name         {name}
// @version      {version}
// @match        https://*.example/p/*
// @match        https://{name}.example/*
// ==/UserScript==
run();"""


@query("""SELECT doc_id, 'script ' || doc_id AS name, '1.' || (doc_id % 4) AS version, '' AS author, 'https://*.example/p/* https://script ' || doc_id || '.example/*' AS matches, 'document-idle' AS run_at
  FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE lang IS NULL""")
def script_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of userscripts, one made for each document with a language."""
    name, version = F.concat(F.lit("script "), "doc_id"), F.concat(F.lit("1."), F.col("doc_id") % 4)
    script = F.replace(F.replace(F.lit(SCRIPT), F.lit("{name}"), name), F.lit("{version}"), version)
    meta = presets.script_meta(F.when(F.col("lang").isNotNull(), script).otherwise(F.lit("run();")))
    m = table(spark, d, "documents").select("doc_id", meta.alias("m"))
    return m.select("doc_id", "m.name", "m.version", "m.author", F.when(F.col("m").isNotNull(), F.array_join("m.matches", " ")).alias("matches"), "m.run_at")


@query()
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Stored files decoded as pages: charset of a meta element, UTF-8, GB18030."""
    return plans.page_texts(table(spark, d, "text_sources"))


@query()
def typeset_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their styled runs as placed elements."""
    return plans.typeset_pages(plans.with_runs(table(spark, d, "blocks"), table(spark, d, "text_runs"))).drop("segments")


@query()
def typeset_articles(spark: SparkSession, d: str) -> DataFrame:
    """Clipped pages, tables and images included, as placed elements."""
    return plans.typeset_pages(plans.article_blocks(table(spark, d, "web_articles"))).drop("segments")


@query("SELECT doc_id, block_index, count(DISTINCT run_id) AS n_runs, count(DISTINCT run_id) FILTER (bold) AS n_bold FROM text_runs WHERE text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL GROUP BY ALL")
def runs_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs gathered by block."""
    keys = table(spark, d, "text_runs").select("doc_id", "block_index").distinct()
    joined = plans.with_runs(keys, table(spark, d, "text_runs")).where("runs is not null")
    return joined.select("doc_id", "block_index", F.size("runs").cast("long").alias("n_runs"), F.size(F.filter("runs", lambda r: r["bold"])).cast("long").alias("n_bold"))


@query()
def safe_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Clipped pages as XHTML for books."""
    return plans.book_bodies(table(spark, d, "web_articles"))


@query(f"""WITH {IMG_SQL.replace("WITH a AS", "a AS", 1).rstrip()[: IMG_SQL.replace("WITH a AS", "a AS", 1).rstrip().rindex("SELECT article_id, (row_number()")]}
SELECT article_id, count(*) AS n_images FROM m WHERE regexp_matches(url, '(?i)^https?://') AND NOT EXISTS (SELECT 1 FROM web_articles w WHERE w.article_id = m.article_id AND regexp_matches(content_html, '(?i)<(script|style|noscript|iframe)')) GROUP BY 1""")
def images_of_books(spark: SparkSession, d: str) -> DataFrame:
    """Images that the books of pages without scripts show."""
    pages = table(spark, d, "web_articles").where(~F.coalesce(F.col("content_html").rlike("(?i)<(script|style|noscript|iframe)"), F.lit(False)))
    bodies = plans.book_bodies(pages)
    return bodies.where(F.size("images") > 0).select("article_id", F.size("images").cast("long").alias("n_images"))
