"""Change status and manifest rows over every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import incremental as I
from pagemill.operators import links as L
from pagemill.operators.metadata import page_metadata
from pagemill.operators.pages import describe_pages, markdown_gate
from pagemill.sources.html_tree import parse_pages
from workload import corpus
from workload.corpus import with_pages
from workload.registry import query

STATUS = "CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 7 = 0 THEN 'updated' ELSE 'unchanged' END"


def own_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described pages whose address names the page, so that no two share one."""
    numbered = corpus.responses(spark, sf_dir).withColumn(
        "url", F.expr("concat(substring_index(url, '/', 3), '/p/', page_id, '/?b=2&a=', page_id % 3)")
    )
    return describe_pages(numbered)


def previous(pages: DataFrame) -> DataFrame:
    """An earlier run: some pages missing, some with another hash, some listed twice."""
    known = pages.filter("page_id % 5 != 0").select("job_id", "normalized_url", "content_hash", "page_id")
    last = known.withColumn("content_hash", F.expr("CASE WHEN page_id % 7 = 0 THEN 'old' ELSE content_hash END"))
    first = known.filter("page_id % 2 = 0").withColumn("content_hash", F.lit("older"))
    return last.withColumn("pos", F.lit(2)).unionByName(first.withColumn("pos", F.lit(1))).drop("page_id")


def with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = own_urls(spark, sf_dir)
    return I.change_status(pages, previous(pages))


@query("change_status", with_pages(f"SELECT page_id, host AS job_id, {STATUS} AS change_status FROM n"))
def change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    return with_status(spark, sf_dir).select("page_id", "job_id", "change_status")


@query(
    "change_counts",
    with_pages(f"SELECT host AS job_id, {STATUS} AS change_status, count(*)::BIGINT AS n_pages FROM n GROUP BY 1, 2"),
)
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 per site: the flagship, without a Python worker."""
    return with_status(spark, sf_dir).groupBy("job_id", "change_status").agg(F.count("*").alias("n_pages"))


@query(
    "needs_write",
    with_pages(f"SELECT page_id, {STATUS} <> 'unchanged' OR k % 3 = 0 AS needs_write FROM n"),
)
def needs_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2."""
    pages = with_status(spark, sf_dir)
    existing = own_urls(spark, sf_dir).filter("page_id % 3 != 0").select("job_id", F.col("markdown_path").alias("rel_path"))
    return I.needs_write(pages, existing).select("page_id", "needs_write")


@query(
    "changed_pages",
    with_pages(f"SELECT page_id, sha256(html) AS content_hash, {STATUS} AS change_status FROM n WHERE k % 5 = 0 OR k % 7 = 0"),
)
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    return I.changed_pages(with_status(spark, sf_dir)).select("page_id", "content_hash", "change_status")


@query(
    "manifest_pages",
    with_pages(
        f"""SELECT host AS job_id, site || '/p/' || k || '/?b=2&a=' || k % 3 AS url, site || '/p/' || k || '?a=' || k % 3 || '&b=2' AS normalized_url,
  CASE WHEN status_code < 400 THEN 'html/p/' || k || '.html' END AS local_html_path,
  CASE WHEN status_code < 400 THEN 'pages/p/' || k || '.md' END AS local_markdown_path, raw_title AS title, status_code::BIGINT AS status_code,
  k AS depth, len(list_distinct(hrefs))::BIGINT AS filtered_links_count, len(hrefs)::BIGINT AS links_from_html_fallback, sha256(html) AS content_hash,
  status_code < 400 AS success, {STATUS} AS change_status, raw_title IS NOT NULL AS has_metadata FROM n"""
    ),
)
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 with every page visited."""
    pages = own_urls(spark, sf_dir).withColumn("links_payload", F.lit(None).cast("string"))
    jobs = corpus.prepared_jobs(spark, sf_dir)
    decided = L.page_decisions(parse_pages(pages), jobs).withColumns(
        {
            "internal_links": L.internal_links(),
            "asset_links": L.asset_links(),
            "links_from_result": L.source_count(L.PAYLOAD),
            "links_from_html_fallback": L.source_count(L.HTML),
        }
    )
    described = markdown_gate(page_metadata(decided).withColumn("markdown", F.col("raw_title")), "markdown").drop("nodes", "html", "decisions")
    described = described.withColumn("writes_markdown", ~F.col("is_error"))
    visits = pages.select(
        "job_id", "page_id", F.lit(True).alias("is_page"), F.col("page_id").alias("depth"), F.lit(None).cast("string").alias("discovered_from"),
        F.col("page_id").alias("visit_order"),
    )
    rows = I.manifest_pages(I.change_status(described, previous(pages)), visits, jobs)
    return rows.select(
        "job_id", "url", "normalized_url", "local_html_path", "local_markdown_path", "title", F.col("status_code").cast("bigint"), "depth",
        F.col("filtered_links_count").cast("bigint"), F.col("links_from_html_fallback").cast("bigint"), "content_hash", "success", "change_status",
        F.col("page_metadata.title").isNotNull().alias("has_metadata"),
    )
