"""Manifests of earlier runs, as nested JSON documents or as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import let
from pagemill.functions.urls import normalize_url, url_parts
from pagemill.operators.scale import durable, join_dimension
from pagemill.sources import nested_manifest

_METADATA = (
    "struct<url:string,title:string,canonical_url:string,page_id:string,created_at:string,published_at:string,"
    "updated_at:string,last_modified:string,authors:array<string>,language:string,content_type:string,"
    "page_type:string,site_name:string,version:string,visibility:string,tags:array<string>,aliases:array<string>,"
    "entities:array<string>,labels:array<string>,breadcrumbs:array<string>,section_path:array<string>,etag:string,"
    "last_modified_header:string,status_code:int,content_length:bigint>"
)
_METADATA_RAW = (
    "struct<page_id:array<string>,content_type:string,page_type:array<string>,created_at:array<string>,"
    "published_at:array<string>,updated_at:array<string>,last_modified:array<string>,last_modified_header:string>"
)
PAGE_FIELDS = (
    "url string, normalized_url string, local_html_path string, local_markdown_path string, title string, "
    "status_code int, content_type string, depth int, discovered_from string, internal_links array<string>, "
    "asset_links array<string>, content_hash string, fetch_mode string, links_from_result int, "
    "links_from_html_fallback int, filtered_links_count int, filtered_assets_count int, html_length int, "
    f"screenshot_path string, success boolean, change_status string, page_metadata {_METADATA}, "
    f"page_metadata_raw {_METADATA_RAW}"
)
ASSET_FIELDS = "url string, local_path string, content_type string, discovered_from string, file_size bigint, success boolean"
ERROR_FIELDS = "url string, stage string, error_type string, message string"
RUN_FIELDS = (
    "source_url string, crawl_started_at string, crawl_finished_at string, tool_name string, tool_version string, "
    "config_snapshot string"
)
TABLES = {"runs": RUN_FIELDS, "pages": PAGE_FIELDS, "assets": ASSET_FIELDS, "errors": ERROR_FIELDS}


def _fields(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path))


def _empty(spark: SparkSession, table: str, extra: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(f"{extra}, {TABLES[table]}"))


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: nested ``manifest.json`` documents (a path or glob) as four tables.

    ``job_id`` is the authority of the source URL, ``pos`` the place in the
    document's list. A document may be one file of any size or a folder of parts
    as ``write_nested_manifests`` leaves it. A missing path gives empty tables.
    """
    if not _exists(spark, path):
        return {name: _empty(spark, name, "job_id string, pos int") for name in TABLES}
    lists, headers = nested_manifest.read_documents(spark, path)
    runs = headers.select("doc", F.from_json("header", RUN_FIELDS).alias("_r")).select("doc", "_r.*")
    keyed = durable(runs.withColumn("job_id", let(url_parts(normalize_url("source_url")), lambda p: p["authority"])))
    tables = {}
    for name in nested_manifest.SECTIONS:
        rows = lists.filter(F.col("key") == name).select("doc", "pos", F.from_json("record", TABLES[name]).alias("_r"))
        tables[name] = join_dimension(rows, keyed.select("doc", "job_id"), ["doc"], ["pos"]).select("job_id", "pos", "_r.*")
    tables["runs"] = keyed.select("job_id", F.lit(0).alias("pos"), *_fields("runs").names)
    return tables


def write_manifest(tables: Mapping[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> None:
    """The four tables below ``path``, one folder per run and job.

    Written per run so that a repeated attempt replaces its own run only.
    """
    for name, table in tables.items():
        # Each job's rows lie together, a large job's in several tasks: few files per folder.
        place = "visit_order" if "visit_order" in table.columns else "url" if "url" in table.columns else "job_id"
        dealt = table.repartitionByRange(*dict.fromkeys(["job_id", place]))
        dealt.write.mode("overwrite").partitionBy("job_id").format(fmt).save(f"{path}/{name}/run_id={run_id}")


def read_manifest_tables(spark: SparkSession, path: str, run_id: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The tables of one run; a missing run gives empty tables."""
    result = {}
    for name in TABLES:
        folder = f"{path}/{name}/run_id={run_id}"
        try:
            # The written schema counts: partition values of job ids stay strings.
            table = spark.read.format(fmt).load(folder) if _exists(spark, folder) else None
            result[name] = (
                table.withColumn("job_id", F.col("job_id").cast("string"))
                if table is not None and table.columns
                else _empty(spark, name, "job_id string")
            )
        except AnalysisException:
            result[name] = _empty(spark, name, "job_id string")
    return result


def previous_pages(manifest_pages: DataFrame) -> DataFrame:
    """What the change status needs of the previous run."""
    position = F.col("pos") if "pos" in manifest_pages.columns else F.col("visit_order")
    return manifest_pages.select("job_id", "normalized_url", "content_hash", position.alias("pos"))


def run_header(jobs: DataFrame, started_at: str, finished_at: str, version: str) -> DataFrame:
    """One header row per job, its settings as a JSON snapshot."""
    return jobs.select(
        "job_id",
        F.col("start_url").alias("source_url"),
        F.lit(started_at).alias("crawl_started_at"),
        F.lit(finished_at).alias("crawl_finished_at"),
        F.lit("pagemill").alias("tool_name"),
        F.lit(version).alias("tool_version"),
        F.to_json(F.struct(*[c for c in jobs.columns if c != "job_id"])).alias("config_snapshot"),
    )


def write_nested_manifests(tables: Mapping[str, DataFrame], path: str) -> None:
    """One JSON document per job below ``path``, of any size.

    Rows are sorted across tasks by job, list and place, so a document is the
    part files of its folder one after another.
    """
    nested_manifest.write_documents(tables, {name: _fields(name).names for name in TABLES}, path)
