"""Scans and sinks over every page."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.pages import describe_pages
from pagemill.session import ensure_checkpoint_dir
from pagemill.sources import documents as D
from pagemill.sources import manifest as M
from pagemill.sources.responses import read_responses
from workload import corpus, increments
from workload.corpus import with_pages
from workload.registry import query


def _folder(spark: SparkSession) -> str:
    """A new folder all executors see, next to the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query(
    "response_scan",
    with_pages(
        """SELECT 'default' AS job_id, page_id, url, url AS requested_url, 200::BIGINT AS status_code, 0::BIGINT AS n_headers,
  length(html)::BIGINT AS html_length, 'stored' AS fetch_mode FROM p"""
    ),
)
def response_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare table of pages as responses."""
    scanned = read_responses(spark, f"{sf_dir}/pages.parquet")
    return scanned.select(
        "job_id", "page_id", "url", "requested_url", F.col("status_code").cast("bigint"), F.size("headers").cast("bigint").alias("n_headers"),
        F.length("html").cast("bigint").alias("html_length"), "fetch_mode",
    )


@query(
    "response_headers",
    with_pages(
        """SELECT page_id, '"e' || k || '"' AS etag, ' ' || length(html) || ' ' AS content_length,
  (3 + (k % 13 = 0 OR k % 7 <> 0)::INT + (k % 10 = 3)::INT)::BIGINT AS n_headers FROM p"""
    ),
)
def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names in lower case, empty ones dropped."""
    return corpus.responses(spark, sf_dir).select(
        "page_id",
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["content-length"].alias("content_length"),
        F.size("headers").cast("bigint").alias("n_headers"),
    )


@query(
    "manifest_round_trip",
    with_pages(
        """SELECT host AS job_id, site || '/p/' || k || '?a=' || k % 3 || '&b=2' AS normalized_url, sha256(html) AS content_hash, k AS pos FROM n"""
    ),
)
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table form of a manifest, written and read as the previous run."""
    pages = increments.own_urls(spark, sf_dir).select(
        "job_id", "normalized_url", "content_hash", F.col("page_id").alias("visit_order"), "url", "status_code"
    )
    folder = _folder(spark)
    M.write_manifest({"pages": pages}, folder, "first")
    return M.previous_pages(M.read_manifest_tables(spark, folder, "first")["pages"])


@query(
    "document_table",
    with_pages(
        """SELECT host AS job_id, 'pages/' || regexp_replace(trim(path, '/'), '\\.html$', '') || '.md' AS rel_path,
  arg_max(raw_title, k) AS text, count(*)::BIGINT AS n_pages FROM n GROUP BY 1, 2"""
    ),
)
def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by path, the last of several pages winning."""
    pages = corpus.responses(spark, sf_dir)
    rows = describe_pages(pages).withColumns(
        {"writes_markdown": F.lit(True), "needs_write": F.lit(True), "document": F.col("raw_title"), "visit_order": F.col("page_id")}
    )
    folder = _folder(spark)
    D.write_document_table(D.markdown_documents(rows), folder)
    return spark.read.parquet(folder).select("job_id", "rel_path", "text", "n_pages")


@query(
    "html_sink",
    with_pages(
        """SELECT host AS job_id, 'html/p/' || k || '.html' AS rel_path, sha256(html) AS content_hash FROM n
WHERE status_code < 400 AND k % 2 = 0"""
    ),
)
def html_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Html of sound pages that are to be written."""
    rows = increments.own_urls(spark, sf_dir).withColumns(
        {"save_html": F.lit(True), "needs_write": F.expr("page_id % 2 = 0"), "visit_order": F.col("page_id")}
    )
    documents = D.resolve_paths(D.html_documents(rows))
    return documents.select("job_id", "rel_path", F.sha2("text", 256).alias("content_hash"))


@query(
    "document_files",
    with_pages(
        """, d AS (
  SELECT host AS job_id, 'html/p/' || k || '.html' AS rel_path, sha256(html) AS content_hash FROM n WHERE status_code < 400 AND k % 2 = 0
  UNION ALL SELECT host, 'pages/p/' || k // 2 * 2 || '.md', sha256(arg_max('# ' || raw_title || chr(10), k)) FROM n WHERE k % 5 <> 0 GROUP BY host, k // 2 * 2
) SELECT * FROM d"""
    ).replace(")\n\n,", "),"),
)
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Html and Markdown written as files and read back; two pages may share a Markdown path."""
    rows = increments.own_urls(spark, sf_dir).withColumns(
        {
            "save_html": F.lit(True), "needs_write": F.expr("page_id % 2 = 0"), "visit_order": F.col("page_id"), "writes_markdown": F.lit(True),
            "document": F.concat(F.lit("# "), "raw_title", F.lit("\n")),
        }
    )
    shared = rows.withColumns({"needs_write": F.expr("page_id % 5 != 0"), "markdown_path": F.expr("concat('p/', page_id div 2 * 2, '.md')")})
    folder = _folder(spark)
    D.write_document_files(D.html_documents(rows), folder)
    D.write_document_files(D.markdown_documents(shared), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    place = F.regexp_extract("path", r"/([^/]+)/((?:html|pages)/.*)$", 1), F.regexp_extract("path", r"/([^/]+)/((?:html|pages)/.*)$", 2)
    return files.select(F.url_decode(place[0]).alias("job_id"), place[1].alias("rel_path"), F.sha2("content", 256).alias("content_hash"))
