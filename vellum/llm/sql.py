"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

#: Named character references that stand in the tables, with what they show.
NAMED = (("nbsp", "chr(160)"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("apos", "''''"), ("hellip", "'…'"), ("mdash", "'—'"), ("ndash", "'–'"))


def _unescaped(x: str) -> str:
    for name, char in NAMED:
        x = f"replace({x}, '&{name};', {char})"
    for pattern, lead, code in (("&#[xX]([0-9a-fA-F]+);", "&#x", "('0x' || r)::INT"), ("&#([0-9]+);", "&#", "r::INT")):
        x = (
            f"(SELECT list_reduce(list_prepend(v, list_distinct(regexp_extract_all(v, '{pattern}', 1))), "
            f"lambda acc, r: replace(acc, '{lead}' || r || ';', chr({code}))) FROM (SELECT {x} AS v))"
        )
    return f"replace({x}, '&amp;', '&')"


SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

P1_FOUND = rf"""
WITH a AS (SELECT article_id, content_html, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)', 1)) AS site,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)', 2) AS path FROM web_articles WHERE url IS NOT NULL),
h AS (SELECT * FROM a WHERE site <> ''),
n AS (SELECT site, count(DISTINCT path) AS n FROM h GROUP BY site),
s AS (SELECT article_id, site, path, string_split(content_html, chr(10)) AS ls FROM h WHERE content_html IS NOT NULL),
l AS (SELECT article_id, site, path, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS raw FROM s),
v AS (SELECT article_id, site, path, line_no, regexp_replace(trim(regexp_replace({_unescaped("regexp_replace(raw, '<[^>]*>', '', 'g')")}, '{SPACE}', ' ', 'g')), '[0-9]+', '0', 'g') AS t FROM l),
w AS (SELECT * FROM v WHERE t <> ''),
k AS (SELECT w.site, w.t FROM w JOIN n USING (site) GROUP BY w.site, w.t, n.n HAVING count(DISTINCT w.path) >= 4 AND count(DISTINCT w.path) >= 0.1 * n.n)
SELECT w.article_id, w.line_no::INT AS line_no FROM w JOIN k ON k.site = w.site AND k.t = w.t"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND}
