"""URL algebra over every page address and links made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from workload.corpus import pages, with_pages
from workload.registry import query

# Links made from every page: (case, SQL for the reference). Both engines know concat and page_id.
REFS = (
    ("query", "concat('?q=', page_id)"),
    ("up", "concat('../up/', page_id)"),
    ("dots", "concat('./a//b/', page_id, '/.')"),
    ("network", "concat('//Host', page_id, '.Example/x')"),
    ("scheme", "'http:rel'"),
    ("fragment", "'#frag'"),
    ("absolute", "concat('HTTPS://UP.example.com:80//A/./b/../c/?z=1&a=%zz&utm_source=x&k&FBclid9=1&n=', page_id, '#f')"),
    ("spaces", "concat('  /plain path/', page_id, ';p=1?q=a+b&c=%7E*&=x ')"),
    ("tracking", "concat('/t?utm_medium=', page_id, '&gclid=2')"),
    ("mail", "concat('mailto:u', page_id, '@example.com')"),
)


def _cases() -> str:
    return ", ".join(f"struct('{name}' AS name, {ref} AS ref)" for name, ref in REFS)


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("page_id", "url", f"inline(array({_cases()}))")


@query(
    "url_parts",
    with_pages("SELECT page_id, scheme, host AS authority, path, '' AS params, query, fragment, host FROM p"),
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.url_parts("url").alias("u"), U.url_host("url").alias("host")).select(
        "page_id", "u.*", "host"
    )


_BASE = r"""
b AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM n),
u AS (SELECT *, regexp_replace(dir, '[^/]+/$', '') AS up FROM b)
"""


@query(
    "url_resolve",
    with_pages(
        ","
        + _BASE
        + """
SELECT page_id, 'query' AS name, site || path || '?q=' || page_id AS resolved FROM u
UNION ALL SELECT page_id, 'up', site || up || 'up/' || page_id FROM u
UNION ALL SELECT page_id, 'dots', site || dir || 'a/b/' || page_id || '/' FROM u
UNION ALL SELECT page_id, 'network', scheme || '://Host' || page_id || '.Example/x' FROM u
UNION ALL SELECT page_id, 'scheme', CASE WHEN scheme = 'http' THEN site || dir || 'rel' ELSE 'http:rel' END FROM u
UNION ALL SELECT page_id, 'fragment', site || path || CASE WHEN query = '' THEN '' ELSE '?' || query END || '#frag' FROM u
UNION ALL SELECT page_id, 'absolute', CASE WHEN scheme = 'https' THEN 'https' ELSE 'HTTPS' END
  || '://UP.example.com:80//A/./b/../c/?z=1&a=%zz&utm_source=x&k&FBclid9=1&n=' || page_id || '#f' FROM u
UNION ALL SELECT page_id, 'spaces', site || '/plain path/' || page_id || ';p=1?q=a+b&c=%7E*&=x' FROM u
UNION ALL SELECT page_id, 'tracking', site || '/t?utm_medium=' || page_id || '&gclid=2' FROM u
UNION ALL SELECT page_id, 'mail', 'mailto:u' || page_id || '@example.com' FROM u
"""
    ).replace(")\n\n,", "),"),
)
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cases(spark, sf_dir).select("page_id", "name", U.url_resolve("url", F.trim("ref")).alias("resolved"))


@query(
    "normalize_link",
    with_pages(
        ","
        + _BASE
        + """
SELECT page_id, 'query' AS name, site || path || '?q=' || page_id AS normalized FROM u
UNION ALL SELECT page_id, 'up', site || up || 'up/' || page_id FROM u
UNION ALL SELECT page_id, 'dots', site || dir || 'a/b/' || page_id || '/' FROM u
UNION ALL SELECT page_id, 'network', scheme || '://host' || page_id || '.example/x' FROM u
UNION ALL SELECT page_id, 'scheme', CASE WHEN scheme = 'http' THEN site || dir || 'rel' END FROM u
UNION ALL SELECT page_id, 'fragment', NULL FROM u
UNION ALL SELECT page_id, 'absolute', 'https://up.example.com:80/A/./b/../c/?z=1&a=%25zz&k=&n=' || page_id FROM u
UNION ALL SELECT page_id, 'spaces', site || '/plain path/' || page_id || '?q=a+b&c=~%2A' FROM u
UNION ALL SELECT page_id, 'tracking', site || '/t' FROM u
UNION ALL SELECT page_id, 'mail', NULL FROM u
"""
    ).replace(")\n\n,", "),"),
)
def normalize_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cases(spark, sf_dir).select("page_id", "name", U.normalize_link("ref", "url").alias("normalized"))


@query(
    "normalize_url",
    with_pages(
        """SELECT page_id, normalized_url AS plain,
  scheme || '://' || host || '/x' || rtrim(path, '/') || '?a=%25zz&b=&b=1&c=a+b' AS messy FROM n"""
    ),
)
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.expr(
        r"concat(' ', regexp_replace(url, '^(https?)://([^/]+)([^?#]*).*$', 'HTTP_$1://$2//x$3//;p?c=a b&b=1&b&a=%zz#f'))"
    )
    messy = F.regexp_replace(messy, "HTTP_", "")
    return pages(spark, sf_dir).select(
        "page_id", U.normalize_url("url").alias("plain"), U.normalize_url(messy).alias("messy")
    )


@query(
    "url_to_rel_path",
    with_pages(
        """SELECT page_id,
  regexp_replace(trim(path, '/'), '\\.html$', '') || '.md' AS markdown_path,
  'v-1/a-b/' || page_id || '.html' AS dotted_path, 'index.md' AS root_path FROM p"""
    ),
)
def url_to_rel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = F.expr("concat('https://h.example/(v 1).html/a b/', page_id, '.2.php?x=1')")
    root = F.expr("concat('https://h', page_id, '.example/?q=1')")
    return pages(spark, sf_dir).select(
        "page_id",
        U.url_to_rel_path("url", ".md").alias("markdown_path"),
        U.url_to_rel_path(dotted, ".html").alias("dotted_path"),
        U.url_to_rel_path(root, ".md").alias("root_path"),
    )


@query(
    "query_encoding",
    with_pages(
        """SELECT page_id,
  CASE WHEN query = '' THEN '' ELSE query END AS plain,
  'c=&x=%25zz&t=~%2A&s=a+b+c&u=%C3%A9%E2%82%AC&n=' || page_id || '&e=%3D%26' AS messy FROM p"""
    ),
)
def query_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_extract("url", r"\?([^#]*)", 1)
    messy = F.expr("concat('c&x=%zz&t=%7E*&s=a+b%20c&&u=%c3%A9€&n=', page_id, '&e=%3d%26')")
    return pages(spark, sf_dir).select("page_id", U.requery(plain).alias("plain"), U.requery(messy).alias("messy"))


@query(
    "asset_rel_path",
    with_pages(
        """SELECT page_id, 'files-' || page_id || '/My-File-1.pdf' AS named, 'file.bin' AS root,
  regexp_replace(trim(path, '/'), '\\.HTML$', '.html') AS plain FROM p"""
    ),
)
def asset_rel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.expr("concat('https://h.example/files ', page_id, '/My File(1).PDF?x=1')")
    root = F.expr("concat('https://h', page_id, '.example')")
    return pages(spark, sf_dir).select(
        "page_id", U.asset_rel_path(named).alias("named"), U.asset_rel_path(root).alias("root"), U.asset_rel_path("url").alias("plain")
    )


@query(
    "dedup_key",
    with_pages(
        """SELECT page_id,
  site || CASE WHEN path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || query END AS key,
  site || '/' AS root_key, site || '/d?x=' || page_id AS query_key FROM n"""
    ),
)
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.regexp_extract("url", r"^https?://[^/?#]+", 0)
    return pages(spark, sf_dir).select(
        "page_id",
        U.dedup_key(F.regexp_replace("url", "#.*$", "")).alias("key"),
        U.dedup_key(F.concat(site, F.lit("/"))).alias("root_key"),
        U.dedup_key(F.concat(site, F.lit("/d/?x="), "page_id")).alias("query_key"),
    )


_DOMAINS = ("example.com", "www.example.org", "spam-farm.example.org", "Example.NET")


@query(
    "same_domain",
    with_pages(
        """SELECT page_id,
  host = 'example.com' OR host LIKE '%.example.com' OR host = 'www.example.org' OR host LIKE '%.www.example.org'
    OR host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' OR host LIKE '%.example.net' AS strict,
  host LIKE '%.example.com' OR host LIKE '%.example.org' OR host LIKE '%.example.net' OR host = 'example.org' AS folded FROM p"""
    ),
)
def same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = F.array(*[F.lit(d) for d in _DOMAINS])
    return pages(spark, sf_dir).select(
        "page_id", U.is_same_domain("url", domains).alias("strict"), U.is_internal("url", domains).alias("folded")
    )


@query(
    "internal_domain",
    with_pages(
        """SELECT page_id, host LIKE 'www.%' AS is_www, true AS own_host, true AS other_www,
  host LIKE 'www.%' AS strict_needs_www FROM p"""
    ),
)
def internal_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    www = F.array(F.concat(F.lit("www."), bare))
    return pages(spark, sf_dir).select(
        "page_id",
        host.startswith("www.").alias("is_www"),
        U.is_internal("url", F.array(bare)).alias("own_host"),
        U.is_internal("url", www).alias("other_www"),
        U.is_same_domain("url", www).alias("strict_needs_www"),
    )


@query(
    "pattern_filter",
    with_pages(
        r"""SELECT page_id,
  (regexp_full_match(url, 'https://.*/en/.*') OR regexp_full_match(url, 'http.*/[d-f]./[0-9][0-9]')) AS included,
  NOT (url LIKE '%utm_%' OR regexp_full_match(url, 'http://[^w].*')) AS not_excluded, true AS unanchored FROM p"""
    ),
)
def pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def globs(*items: str):
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    return pages(spark, sf_dir).select(
        "page_id",
        U.matches_patterns("url", globs("https://*/en/*", "http*/[d-f]?/[0-9][0-9]"), globs()).alias("included"),
        U.matches_patterns("url", globs(), globs("*utm_*", "http://[!w]*")).alias("not_excluded"),
        U.matches_patterns("url", globs(), globs("/en/")).alias("unanchored"),
    )


@query(
    "asset_urls",
    with_pages(
        """SELECT page_id, k % 3 = 0 AS asset_like, k % 4 = 1 AS static_asset, k % 5 = 2 AS attachment, k % 5 IN (2, 3) AS configured_attachment FROM p"""
    ),
)
def asset_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U12 to U15 on addresses made from every page."""
    site = "regexp_extract(url, '^https?://[^/?#]+', 0)"
    asset = F.expr(f"concat({site}, CASE WHEN page_id % 6 = 0 THEN '/a/My-LOGO-1?x=1' WHEN page_id % 3 = 0 THEN '/a.PNG?v=2' ELSE '/logo/a.pn?x=.png' END)")
    static = F.expr(f"concat({site}, CASE WHEN page_id % 4 = 1 THEN '/x.WOFF2' ELSE '/x.css?v=1' END)")
    attach = F.expr(f"concat({site}, CASE page_id % 5 WHEN 2 THEN '/doc.PDF' WHEN 3 THEN '/doc.pdf?x=1' ELSE '/pdf' END)")
    extensions = F.array(F.lit("Pdf"), F.lit(".docx"))
    return pages(spark, sf_dir).select(
        "page_id",
        U.looks_like_asset(asset).alias("asset_like"),
        U.is_static_asset(static).alias("static_asset"),
        U.is_attachment(attach, extensions).alias("attachment"),
        U.is_configured_attachment(attach, extensions).alias("configured_attachment"),
    )
