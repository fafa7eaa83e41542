"""Sinks for Markdown documents and HTML, as a table or as one file per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.scale import durable, join_dimension
from pagemill.sources.document_sink import list_files, write_files


def resolve_paths(documents: DataFrame) -> DataFrame:
    """One row per ``(job_id, rel_path)``: pages that share a path leave the last one visited.

    ``documents(job_id, rel_path, text, visit_order)``. Paths are compared without
    the texts; only texts whose path is shared are moved.
    """
    keys = ["job_id", "rel_path"]
    shared = durable(path_collisions(documents)).drop("n_pages")
    alone = join_dimension(documents, shared, keys, ["visit_order"], "left_anti").select(*keys, "text", F.lit(1).cast("bigint").alias("n_pages"))
    several = join_dimension(documents, shared, keys, ["visit_order"], "left_semi").groupBy(*keys).agg(
        F.max_by("text", F.struct("visit_order", "text")).alias("text"), F.count("*").alias("n_pages")
    )
    return alone.unionByName(several)


def path_collisions(documents: DataFrame) -> DataFrame:
    """Paths more than one page is stored at."""
    return documents.groupBy("job_id", "rel_path").agg(F.count("*").alias("n_pages")).filter("n_pages > 1")


def markdown_documents(pages: DataFrame) -> DataFrame:
    """S5 rows: documents to write, from pages with ``document``, gate and write flags."""
    return pages.filter(F.col("writes_markdown") & F.col("needs_write")).select(
        "job_id", F.concat(F.lit("pages/"), "markdown_path").alias("rel_path"), F.col("document").alias("text"), "visit_order"
    )


def html_documents(pages: DataFrame) -> DataFrame:
    """S6 rows: raw html of sound pages that changed or whose file is missing."""
    return pages.filter(~F.col("is_error") & F.col("save_html") & F.col("needs_write")).select(
        "job_id", F.concat(F.lit("html/"), "html_path").alias("rel_path"), F.col("html").alias("text"), "visit_order"
    )


def write_document_table(documents: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Table form of the sink, for corpora where a file per page is too many; a job's documents lie together."""
    dealt = resolve_paths(documents).repartitionByRange("job_id", "rel_path")
    dealt.write.mode("overwrite").partitionBy("job_id").format(fmt).save(path)


def write_document_files(documents: DataFrame, root: str) -> None:
    """File form of the sink, on any file system that the executors reach; all documents appear or none."""
    write_files(resolve_paths(documents), root)


def existing_files(spark: SparkSession, root: str) -> DataFrame:
    """``job_id, rel_path`` of the files of earlier runs; only their names are read, by tasks."""
    place = F.regexp_extract("path", r"/([^/]+)/((?:html|pages)/.*)$", 1), F.regexp_extract("path", r"/([^/]+)/((?:html|pages)/.*)$", 2)
    return list_files(spark, root).select(F.url_decode(place[0]).alias("job_id"), place[1].alias("rel_path"))
