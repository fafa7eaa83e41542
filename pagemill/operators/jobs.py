"""Crawl jobs: one row per site export, prepared once for all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.text import let
from pagemill.functions.urls import glob_to_regex, normalize_extension, normalize_url, url_parts, without_www

JOB_SCHEMA = (
    "job_id string, start_url string, allowed_domains array<string>, include_patterns array<string>, "
    "exclude_patterns array<string>, attachment_extensions array<string>, max_pages int, max_depth int, "
    "content_extraction string, save_html boolean, save_markdown boolean, download_attachments boolean"
)


def effective_domains(jobs: DataFrame) -> DataFrame:
    """No configured domain means the authority of the start URL."""
    authority = let(url_parts(normalize_url("start_url")), lambda p: p["authority"])
    listed = F.coalesce(F.col("allowed_domains"), F.array().cast("array<string>"))
    return jobs.withColumn("domains", F.when(F.size(listed) == 0, F.array(authority)).otherwise(listed))


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    """Defaults filled in, globs compiled to regexes, extensions normalised."""
    fixed = effective_domains(jobs)
    default_extensions = F.array(*[F.lit(e) for e in rules.DEFAULT_ATTACHMENT_EXTENSIONS])
    extensions = F.coalesce(F.col("attachment_extensions"), default_extensions)
    return fixed.select(
        "job_id",
        "start_url",
        "domains",
        F.transform("domains", without_www).alias("bare_domains"),
        F.transform("include_patterns", glob_to_regex).alias("include_regexes"),
        F.transform("exclude_patterns", glob_to_regex).alias("exclude_regexes"),
        F.transform(extensions, normalize_extension).alias("extensions"),
        extensions.alias("listed_extensions"),
        F.coalesce("max_pages", F.lit(rules.DEFAULT_MAX_PAGES)).alias("max_pages"),
        F.coalesce("max_depth", F.lit(rules.DEFAULT_MAX_DEPTH)).alias("max_depth"),
        F.coalesce("content_extraction", F.lit("main")).alias("content_extraction"),
        F.coalesce("save_html", F.lit(True)).alias("save_html"),
        F.coalesce("save_markdown", F.lit(True)).alias("save_markdown"),
        F.coalesce("download_attachments", F.lit(True)).alias("download_attachments"),
    )
