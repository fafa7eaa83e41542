"""Crawl inputs derived from the ``pages`` table.

The table has urls and html only. Status, headers, extra markup, job settings and
a previous run follow from ``page_id`` by fixed arithmetic, for every page, so
the checking SQL can state the expected result without parsing any html.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.jobs import JOB_SCHEMA, prepare_jobs
from pagemill.operators.pages import describe_pages
from pagemill.sources.html_tree import parse_pages
from pagemill.sources.responses import as_responses, spread

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"

# The same page parts for the checking SQL.
P = r"""
p AS (
  SELECT page_id, page_id AS k, url, html,
    regexp_extract(url, '^(https?)://', 1) AS scheme,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '\?([^#]*)', 1) AS query,
    regexp_extract(url, '#(.*)$', 1) AS fragment
  FROM pages
),
n AS (
  SELECT *, scheme || '://' || host AS site,
    scheme || '://' || host || rtrim(path, '/') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS normalized_url,
    CASE WHEN k % 17 = 0 THEN 404 WHEN k % 19 = 0 THEN 500 ELSE 200 END AS status_code,
    CASE WHEN k % 13 = 0 THEN 'application/pdf' WHEN k % 7 = 0 THEN '' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
    trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS raw_title,
    regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1), 'href="([^"]*)"', 1) AS hrefs
  FROM p
)
"""


def with_pages(body: str) -> str:
    return f"WITH {P}\n{body}"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


STATUS = "CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 500 ELSE 200 END"
HEADERS = """map_filter(map(
  'Content-Type', CASE WHEN page_id % 13 = 0 THEN 'application/pdf' WHEN page_id % 7 = 0 THEN NULL ELSE 'Text/HTML; charset=utf-8' END,
  'ETag', concat('"e', page_id, '"'),
  'Last-Modified', concat('Sun, ', 1 + page_id % 28, ' Feb 2026 11:45:00 GMT'),
  'Content-Length', concat(' ', length(html), ' '),
  'X-Robots-Tag', CASE WHEN page_id % 10 = 3 THEN 'NoIndex' END,
  'X-Empty', NULL), (k, v) -> true)"""

_LD = """concat('<script type="application/ld+json">{"@context":"https://schema.org","@graph":[',
  '{"@type":"', element_at(array('NewsArticle','FAQPage','WebPage','TechArticle'), cast(1 + page_id div 2 % 4 as int)),
  '","@id":"urn:p:', page_id, '","name":"LD ', page_id, '","author":[{"@type":"Person","name":"Writer ', page_id % 9,
  '"},"Guest",7],"about":{"name":"Topic ', page_id % 8, '"},"mentions":["M', page_id % 2, '"],"keywords":"ldk, k', page_id % 5,
  '","genre":"G', page_id % 2, '","dateModified":"2026-03-01 12:30:00","inLanguage":"xx","publisher":{"name":"Pub ', page_id % 3,
  '"}},[{"@type":["BreadcrumbList"],"itemListElement":[{"position":2,"name":"Crumb ', page_id % 10,
  '"},{"position":"1","item":{"name":"Home"}},{"position":3}]}]]}</script>')"""
HEAD = f"""concat(
  CASE WHEN page_id % 4 = 0 THEN concat('<meta property="og:title" content=" OG ', page_id, ' ">') ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN concat('<link rel="x Canonical" href=" /canon/', page_id, '?a=1 ">') ELSE '' END,
  '<meta name="Author" content=" Author ', page_id % 7, ' "><meta property="article:author" content="Author 1">',
  '<meta name="keywords" content="k', page_id % 5, '; shared,, k', page_id % 3, 'x"><meta property="article:tag" content="a,b">',
  CASE page_id % 5 WHEN 0 THEN '<meta name="robots" content="Index, follow">' WHEN 1 THEN '<meta name="googlebot" content="noindex">'
    WHEN 2 THEN '<meta name="robots" content="private">' ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN concat('<meta name="Page-ID" content="P', page_id, '">') ELSE '' END,
  '<meta property="article:published_time" content="2026-02-', lpad(1 + page_id % 28, 2, '0'), 'T10:00:00+01:00">',
  '<meta name="created_at" content="', CASE WHEN page_id % 3 = 1 THEN 'soon' ELSE '20260105' END, '"><meta name="date.created" content="2026-01-06">',
  '<meta property="article:section" content="Section ', page_id % 4, '"><meta name="category" content="Cat">',
  '<link rel="alternate" href="/alt/', page_id, '"><link rel="stylesheet" href="/s.css"><link rel="shortlink" href="', url, '">',
  CASE WHEN page_id % 6 = 0 THEN concat('<meta name="version" content="3.', page_id % 10, '">') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN concat('<meta property="og:site_name" content="Site ', page_id % 3, '">') ELSE '' END,
  CASE WHEN page_id % 11 = 0 THEN '<script type="application/ld+json">{{bad</script>' ELSE '' END,
  CASE WHEN page_id % 2 = 1 THEN {_LD} ELSE '' END)"""
# (raw link, normalised path or address, decision, reason); {k} is the page id, {s} the page's site.
BODY_LINKS = (
    ("/f/{k}.pdf", "{s}/f/{k}.pdf", "asset", "attachment"),
    ("/F/{k}.PDF?x=1", "{s}/F/{k}.PDF?x=1", "keep", "kept"),
    ("#top", None, "drop", "anchor-only"),
    ("MAILTO:a@b", None, "drop", "mailto/tel/javascript"),
    ("ftp://h/x", None, "drop", "non-http"),
    ("http://[bad", None, "drop", "invalid-url"),
    ("https://other.example.invalid/x", "https://other.example.invalid/x", "drop", "external-domain"),
    ("/dup?b=2&utm_source=t&a=1", "{s}/dup?b=2&a=1", "keep", "kept"),
    ("/dup?b=2&a=1#x", "{s}/dup?b=2&a=1", "drop", "duplicate-after-normalization"),
    ("/slash//two", "{s}/slash/two", "keep", "kept"),
    ("/slash/two/", "{s}/slash/two/", "drop", "duplicate-after-normalization"),
    ("/Index.html?q=a+b", "{s}/?q=a+b", "keep", "kept"),
    ("/print.css", "{s}/print.css", "drop", "ignored-static-asset"),
    ("/img/logo", "{s}/img/logo", "asset", "asset-like-url"),
    ("/blocked/{k}", "{s}/blocked/{k}", "drop", "excluded-by-pattern"),
    ("/a/./b/../{k}", "{s}/a/{k}", "keep", "kept"),
)
ASSET_LINKS = (
    ("/i/{k}.webp", "{s}/i/{k}.webp", "asset", "asset-like-url"),
    ("/v/{k}.mp4", "{s}/v/{k}.mp4", "keep", "kept"),
)
PAYLOAD_LINKS = (
    ("/pay/{k}", "{s}/pay/{k}", "keep", "kept"),
    ("/slash/two", "{s}/slash/two", "keep", "kept"),
    ("mailto:x@y", None, "drop", "mailto/tel/javascript"),
)


def _sql(text: str) -> str:
    quoted = "'" + text.replace("'", "''") + "'"
    return "concat(" + quoted.replace("{k}", "', page_id, '") + ")"


BODY = (
    "concat('<div class=\"links\">', "
    + ", ".join(_sql(f'<a href="{raw.replace("&", "&amp;")}">t</a>') for raw, *_ in BODY_LINKS)
    + ", '<span data-url=\"/data/', page_id, '\">d</span></div><img src=\"/i/', page_id, '.webp\"><video src=\"/v/', page_id, '.mp4\"></video>', "
    "'<nav aria-label=\"Main BreadCrumb\"><ul><li><a href=\"#\">Docs</a></li><li><span>S', page_id % 3, '</span></li></ul></nav>')"
)
PAYLOAD = (
    "CASE WHEN page_id % 3 = 0 THEN concat('{\"zz\":[{\"href\":\"/pay/', page_id, '\"},\"/slash/two\",5,{\"x\":1}],"
    "\"bad\":\"no\",\"aa\":[{\"href\":\"\",\"url\":\"mailto:x@y\"}]}') END"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with status, headers and payload, the html as given; one job per host."""
    return as_responses(
        pages(spark, sf_dir).selectExpr(
            f"{HOST} AS job_id", "page_id", "url", "html", f"{STATUS} AS status_code", f"{HEADERS} AS headers", f"{PAYLOAD} AS links_payload"
        )
    )


def rich_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``responses``, with metadata, JSON-LD, breadcrumbs, links and media added to every page."""
    return responses(spark, sf_dir).withColumn(
        "html",
        F.expr(f"replace(replace(html, '</head>', concat({HEAD}, '</head>')), '<body>', concat('<body id=\"b', page_id, '\">', {BODY}))"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per host: its first page as start, ``/blocked/`` excluded."""
    starts = (
        spark.read.parquet(f"{sf_dir}/pages.parquet")
        .groupBy(F.expr(HOST).alias("job_id"))
        .agg(F.min_by("url", "page_id").alias("start_url"))
    )
    return starts.selectExpr(
        "job_id",
        "start_url",
        "array(concat('www.', job_id)) AS allowed_domains",
        "cast(array() AS array<string>) AS include_patterns",
        "array('*/blocked/*') AS exclude_patterns",
        "array('PDF', '.zip') AS attachment_extensions",
        "50 AS max_pages",
        "2 AS max_depth",
        "'main' AS content_extraction",
        "true AS save_html",
        "true AS save_markdown",
        "true AS download_attachments",
    ).to(_schema(JOB_SCHEMA))


def _schema(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)


def prepared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_jobs(jobs(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(describe_pages(responses(spark, sf_dir)))


def rich_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(describe_pages(rich_responses(spark, sf_dir)))
