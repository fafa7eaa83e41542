"""Content types, page gates, titles, hashes and dates over every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import content_types as C
from pagemill.functions.dates import as_timestamp, normalize_datetime
from pagemill.operators import pages as P
from pagemill.operators.links import internal_links, page_decisions
from workload import corpus
from workload.corpus import pages, with_pages
from workload.registry import query


@query(
    "content_types",
    with_pages(
        """SELECT page_id, CASE k % 6 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'image/png'
  WHEN 3 THEN 'application/vnd.ms-excel' WHEN 4 THEN '' ELSE 'application/json' END AS media_type,
  k % 6 IN (0, 1) AS is_html, k % 6 IN (2, 3) AS is_binary FROM p"""
    ),
)
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 to P3."""
    given = F.expr(
        "CASE page_id % 6 WHEN 0 THEN concat(' Text/HTML ; charset=', page_id) WHEN 1 THEN 'application/xhtml+xml' "
        "WHEN 2 THEN 'IMAGE/png' WHEN 3 THEN 'application/vnd.ms-excel;x' WHEN 5 THEN 'application/json' END"
    )
    return pages(spark, sf_dir).select(
        "page_id", C.content_type_norm(given).alias("media_type"), C.is_html_type(given).alias("is_html"), C.is_binary_type(given).alias("is_binary")
    )


@query(
    "html_documents",
    with_pages("SELECT page_id, k % 4 IN (0, 1) AS by_look, k % 5 <> 0 AS by_path, k % 3 = 0 AS by_type FROM p"),
)
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    html = F.expr(
        "CASE page_id % 4 WHEN 0 THEN concat('  \\n', html) WHEN 1 THEN substr(html, 16) "
        "ELSE concat(repeat('x', 256), html) END"
    )
    url = F.expr("CASE WHEN page_id % 5 = 0 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '.PDF?x=.html') ELSE url END")
    kind = F.expr("CASE WHEN page_id % 3 = 0 THEN 'text/html' END")
    return pages(spark, sf_dir).select(
        "page_id",
        C.is_html_document(F.lit("image/png"), "url", html).alias("by_look"),
        C.is_html_document(F.lit(None), url, "html").alias("by_path"),
        C.is_html_document(kind, F.lit("http://h/a.js"), "html").alias("by_type"),
    )


@query(
    "page_identity",
    with_pages(
        """SELECT page_id, host AS job_id, normalized_url, raw_title, sha256(html) AS content_hash, length(html)::BIGINT AS html_length,
  status_code >= 400 AS is_error, k % 13 <> 0 OR true AS is_html, length(trim(html)) < 256 AS html_small,
  regexp_replace(trim(path, '/'), '\\.html$', '') || '.md' AS markdown_path FROM n"""
    ),
)
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P8, P9, U4, U5 in one pass without a Python worker."""
    described = P.describe_pages(corpus.responses(spark, sf_dir))
    return described.select(
        "page_id", "job_id", "normalized_url", "raw_title", "content_hash", F.col("html_length").cast("bigint"),
        "is_error", "is_html", "html_small", "markdown_path",
    )


@query(
    "error_pages",
    with_pages(
        """SELECT host AS job_id, status_code::BIGINT AS status_code, count(*)::BIGINT AS n_pages FROM n WHERE status_code >= 400 GROUP BY 1, 2"""
    ),
)
def error_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    return (
        corpus.responses(spark, sf_dir)
        .filter(C.is_error("status_code"))
        .groupBy("job_id", F.col("status_code").cast("bigint").alias("status_code"))
        .agg(F.count("*").alias("n_pages"))
    )


@query(
    "raw_titles",
    with_pages(
        """SELECT page_id, raw_title AS plain, 'A &amp; ' || page_id AS upper_case, NULL::VARCHAR AS missing FROM n"""
    ),
)
def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    upper = F.expr("concat('<TITLE lang=x>\\n A &amp; ', page_id, ' </TITLE>', html)")
    return pages(spark, sf_dir).select(
        "page_id",
        C.raw_title("html").alias("plain"),
        C.raw_title(upper).alias("upper_case"),
        C.raw_title(F.replace("html", F.lit("</title>"), F.lit("</titel>"))).alias("missing"),
    )


@query(
    "content_hashes",
    """SELECT sha256(html) AS content_hash, count(*)::BIGINT AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1""",
)
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by content."""
    return pages(spark, sf_dir).groupBy(C.content_hash("html").alias("content_hash")).agg(
        F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")
    )


@query(
    "markdown_gate",
    with_pages(
        """SELECT page_id, CASE WHEN status_code >= 400 THEN 'skip_markdown_error_status_' || status_code WHEN page_id % 7 = 3 THEN NULL
  WHEN k % 13 = 0 AND k % 2 = 0 THEN 'skip_markdown_non_html'
  WHEN k % 5 = 0 THEN 'skip_markdown_empty_content' END AS markdown_skip_reason,
  NOT (status_code >= 400 OR page_id % 7 = 3 OR (k % 13 = 0 AND k % 2 = 0) OR k % 5 = 0) AS writes_markdown FROM n"""
    ),
)
def markdown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 with a text that is blank on some pages, no html on others, and none wanted on a seventh."""
    described = P.describe_pages(
        corpus.responses(spark, sf_dir).withColumn(
            "html", F.expr("CASE WHEN page_id % 13 = 0 AND page_id % 2 = 0 THEN concat('%PDF', page_id) ELSE html END")
        )
    )
    marked = described.withColumn("markdown", F.expr("CASE WHEN page_id % 5 = 0 THEN ' \\n\\u00a0' ELSE raw_title END"))
    marked = marked.withColumn("markdown", F.coalesce("markdown", F.lit("x")))
    marked = marked.withColumn("save_markdown", F.expr("page_id % 7 <> 3"))
    return P.markdown_gate(marked).select("page_id", "markdown_skip_reason", "writes_markdown")


@query(
    "page_flags",
    with_pages(
        """SELECT page_id, len(hrefs) = 0 AS zero_links, length(trim(html)) < 256 AS html_small,
  length(html)::BIGINT AS html_length FROM n"""
    ),
)
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    decided = page_decisions(corpus.parsed(spark, sf_dir), corpus.prepared_jobs(spark, sf_dir))
    flags = P.page_flags(decided.withColumn("internal_links", internal_links()))
    return flags.select("page_id", "zero_links", "html_small", F.col("html_length").cast("bigint"))


_DAY = "(1 + page_id % 28)"
DATE_TEXTS = (
    ("date", f"concat('2026-02-', lpad({_DAY}, 2, '0'))"),
    ("offset", f"concat('2026-02-', lpad({_DAY}, 2, '0'), 'T00:30:00+01:00')"),
    ("space", f"concat(' 2026-02-', lpad({_DAY}, 2, '0'), ' 10:05 ')"),
    ("zulu", f"concat('2026-02-', lpad({_DAY}, 2, '0'), 'T10:05:06.25Z')"),
    ("basic", f"concat('202602', lpad({_DAY}, 2, '0'))"),
    ("mail", f"concat('Mon, ', {_DAY}, ' Feb 2026 23:45:00 -0130')"),
    ("named", f"concat({_DAY}, ' February 26 11:45 EST')"),
    ("unknown_zone", f"concat({_DAY}, ' Feb 2026 11:45:01 -0000')"),
    ("wrong", f"concat('2026-02-', lpad({_DAY} + 30, 2, '0'), 'T10:00')"),
    ("text", "concat('page ', page_id)"),
)


@query(
    "normalize_datetime",
    with_pages(
        """, d AS (SELECT page_id, DATE '2026-02-01' + (k % 28)::INTEGER AS d FROM p)
SELECT page_id, 'date' AS name, strftime(d, '%Y-%m-%d') AS normalized FROM d
UNION ALL SELECT page_id, 'offset', strftime(d - 1, '%Y-%m-%d') || 'T23:30:00Z' FROM d
UNION ALL SELECT page_id, 'space', strftime(d, '%Y-%m-%d') || 'T10:05:00' FROM d
UNION ALL SELECT page_id, 'zulu', strftime(d, '%Y-%m-%d') || 'T10:05:06.250000Z' FROM d
UNION ALL SELECT page_id, 'basic', strftime(d, '%Y-%m-%d') || 'T00:00:00' FROM d
UNION ALL SELECT page_id, 'mail', strftime(d + 1, '%Y-%m-%d') || 'T01:15:00Z' FROM d
UNION ALL SELECT page_id, 'named', strftime(d, '%Y-%m-%d') || 'T16:45:00Z' FROM d
UNION ALL SELECT page_id, 'unknown_zone', strftime(d, '%Y-%m-%d') || 'T11:45:01' FROM d
UNION ALL SELECT page_id, 'wrong', NULL FROM d
UNION ALL SELECT page_id, 'text', NULL FROM d"""
    ).replace(")\n\n,", "),"),
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18."""
    cases = ", ".join(f"struct('{name}' AS name, {text} AS text)" for name, text in DATE_TEXTS)
    return pages(spark, sf_dir).selectExpr("page_id", f"inline(array({cases}))").select(
        "page_id", "name", normalize_datetime("text").alias("normalized")
    )


@query(
    "typed_dates",
    """SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS iso, count(*)::BIGINT AS n_orders
FROM orders GROUP BY 1""",
)
def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18 over real dates: written the mail way, read back, typed and written again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mail = F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    typed = as_timestamp(normalize_datetime(F.concat(mail, F.lit(" GMT"))))
    return orders.groupBy(F.date_format(typed, "yyyy-MM-dd'T'HH:mm:ss").alias("iso")).agg(F.count("*").alias("n_orders"))
