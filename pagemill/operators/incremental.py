"""Change status against the previous run, and the rows of the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import asset_rel_path, is_configured_attachment, normalize_url
from pagemill.operators.scale import hot_keys, join_dimension, join_hot

NEW, UPDATED, UNCHANGED = "new", "updated", "unchanged"


def latest_previous(previous: DataFrame) -> DataFrame:
    """One row per URL of the previous run, the last one if there are more.

    An aggregate, not a window: copies are combined before the shuffle.
    """
    return previous.groupBy("job_id", "normalized_url").agg(
        F.max_by(F.struct(F.col("content_hash").alias("hash")), "pos").alias("_previous")
    )


def change_status(pages: DataFrame, previous: DataFrame) -> DataFrame:
    """K1: adds ``change_status``; ``previous(job_id, normalized_url, content_hash, pos)``."""
    keys = ["job_id", "normalized_url"]
    # Only the key columns are read to look for hot URLs, never the page text.
    hot = hot_keys(pages.select(*keys), keys)
    joined = join_hot(pages, latest_previous(previous), keys, ["page_id"], hot=hot)
    status = (
        F.when(F.col("_previous").isNull(), NEW)
        .when(F.col("_previous.hash") == F.col("content_hash"), UNCHANGED)
        .otherwise(UPDATED)
    )
    return joined.withColumn("change_status", status).drop("_previous")


def changed_pages(pages: DataFrame) -> DataFrame:
    """K3: what later steps have to look at again."""
    return pages.filter(F.col("change_status") != UNCHANGED)


def needs_write(pages: DataFrame, existing: DataFrame, path: str = "markdown_path") -> DataFrame:
    """K2: adds ``needs_write``: changed, or its file is missing in ``existing(job_id, rel_path)``."""
    present = existing.select("job_id", F.col("rel_path").alias(path)).distinct().withColumn("_present", F.lit(True))
    joined = join_hot(pages, present, ["job_id", path], ["page_id"])
    return joined.withColumn(
        "needs_write", (F.col("change_status") != UNCHANGED) | F.col("_present").isNull()
    ).drop("_present")


def manifest_pages(pages: DataFrame, visits: DataFrame, jobs: DataFrame) -> DataFrame:
    """K4: the 23 page fields, for the visited pages of each job.

    ``pages`` needs the columns of ``describe_pages``, the link lists and counts,
    ``change_status``, ``writes_markdown`` and the metadata structs.
    """
    visited = visits.filter("is_page").select("job_id", "page_id", "depth", "discovered_from", "visit_order")
    options = jobs.select("job_id", "save_html", "save_markdown")
    rows = join_dimension(visited.join(pages, ["job_id", "page_id"]), options, ["job_id"], ["page_id"])
    sound = ~F.col("is_error")
    return rows.select(
        "job_id",
        "visit_order",
        "url",
        "normalized_url",
        F.when(F.col("save_html") & sound, F.concat(F.lit("html/"), "html_path")).alias("local_html_path"),
        F.when(
            F.col("save_markdown") & sound & F.col("writes_markdown"), F.concat(F.lit("pages/"), "markdown_path")
        ).alias("local_markdown_path"),
        F.col("raw_title").alias("title"),
        "status_code",
        "content_type",
        "depth",
        "discovered_from",
        "internal_links",
        "asset_links",
        "content_hash",
        "fetch_mode",
        "links_from_result",
        "links_from_html_fallback",
        F.size("internal_links").alias("filtered_links_count"),
        F.size("asset_links").alias("filtered_assets_count"),
        "html_length",
        F.lit(None).cast("string").alias("screenshot_path"),
        sound.alias("success"),
        "change_status",
        "page_metadata",
        "page_metadata_raw",
    )


def asset_candidates(pages: DataFrame, visits: DataFrame, jobs: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Asset links of visited pages with a configured extension, each once per job.

    ``discovered_from`` is the first page, in visit order, that links it. A logo
    linked by every page is combined before the shuffle.
    """
    visited = visits.filter("is_page").select("job_id", "page_id", "visit_order")
    links = visited.join(pages.select("job_id", "page_id", "normalized_url", "asset_links"), ["job_id", "page_id"]).select(
        "job_id", "visit_order", F.col("normalized_url").alias("from_url"), F.explode("asset_links").alias("url")
    )
    if fallback is not None:
        roots = visits.filter("is_page AND depth = 0").select("job_id", "visit_order")
        extra = join_dimension(fallback.filter("kind = 'asset'"), roots, ["job_id"], ["url"])
        links = links.unionByName(extra.select("job_id", "visit_order", "from_url", "url"))
    wanted = jobs.filter("download_attachments").select("job_id", "extensions")
    return (
        join_dimension(links, wanted, ["job_id"], ["url"])
        .filter(is_configured_attachment("url", "extensions"))
        .groupBy("job_id", "url")
        .agg(F.min_by("from_url", "visit_order").alias("discovered_from"))
    )


def _asset_failed() -> Column:
    return F.col("_answer").isNull() | F.col("_answer.error_type").isNotNull() | (F.col("_answer.status_code") >= 400)


def _answered_assets(candidates: DataFrame, asset_responses: DataFrame) -> DataFrame:
    answers = asset_responses.groupBy("job_id", "url").agg(
        F.min(F.struct("status_code", "content_type", "body_size", "error_type", "error_message")).alias("_answer")
    )
    return candidates.join(answers, ["job_id", "url"], "left")


def manifest_assets(candidates: DataFrame, asset_responses: DataFrame) -> DataFrame:
    """K6: fetched assets with path, type and size.

    ``asset_responses(job_id, url, status_code, content_type, body_size, error_type, error_message)``.
    """
    return _answered_assets(candidates, asset_responses).filter(~_asset_failed()).select(
        "job_id",
        "url",
        F.concat(F.lit("assets/"), asset_rel_path("url")).alias("local_path"),
        F.col("_answer.content_type").alias("content_type"),
        "discovered_from",
        F.col("_answer.body_size").alias("file_size"),
        F.lit(True).alias("success"),
    )


def manifest_errors(
    pages: DataFrame, visits: DataFrame, candidates: DataFrame | None = None, asset_responses: DataFrame | None = None
) -> DataFrame:
    """K5: error pages, failed fetches and failed assets as ``(job_id, url, stage, error_type, message)``."""
    visited = visits.filter("is_page").select("job_id", "page_id")
    bad_status = pages.filter("is_error").join(visited, ["job_id", "page_id"], "left_semi").select(
        "job_id",
        "url",
        F.lit("page_response").alias("stage"),
        F.lit("HttpStatusError").alias("error_type"),
        F.concat(F.lit("HTTP status "), F.col("status_code").cast("string")).alias("message"),
    )
    failures = pages.filter(F.col("error_type").isNotNull()).groupBy(
        "job_id", normalize_url("requested_url").alias("url")
    ).agg(F.min(F.struct("page_id", "error_type", "error_message")).alias("_e"))
    failed = (
        visits.filter("admission = 'ok' AND NOT is_page")
        .select("job_id", "url")
        .join(failures, ["job_id", "url"], "left")
        .select(
            "job_id",
            "url",
            F.lit("page_crawl").alias("stage"),
            F.coalesce("_e.error_type", F.lit("NotFetched")).alias("error_type"),
            F.coalesce("_e.error_message", F.lit("no stored response")).alias("message"),
        )
    )
    errors = bad_status.unionByName(failed)
    if candidates is None or asset_responses is None:
        return errors
    assets = _answered_assets(candidates, asset_responses).filter(_asset_failed()).select(
        "job_id",
        "url",
        F.lit("asset_download").alias("stage"),
        F.when(F.col("_answer").isNull(), "NotFetched")
        .otherwise(F.coalesce("_answer.error_type", F.lit("HTTPStatusError")))
        .alias("error_type"),
        F.when(F.col("_answer").isNull(), "no stored response")
        .otherwise(
            F.coalesce(
                "_answer.error_message", F.concat(F.lit("HTTP status "), F.col("_answer.status_code").cast("string"))
            )
        )
        .alias("message"),
    )
    return errors.unionByName(assets)


def run_summary(counts: DataFrame, assets: DataFrame, errors: DataFrame, jobs: DataFrame) -> DataFrame:
    """K7: one row per job; ``counts`` from ``skip_counts``."""

    def per_job(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("job_id").agg(F.count("*").alias(name))

    joined = (
        jobs.select("job_id", "max_pages")
        .join(counts, "job_id", "left")
        .join(per_job(assets, "assets"), "job_id", "left")
        .join(per_job(errors, "errors"), "job_id", "left")
    )
    names = (
        "pages", "assets", "errors", "queue_remaining", "skipped_visited", "skipped_depth", "skipped_domain", "skipped_pattern",
    )
    filled = joined.select("job_id", "max_pages", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names])
    return filled.select(
        "job_id",
        *names,
        (F.col("skipped_visited") + F.col("skipped_depth") + F.col("skipped_domain") + F.col("skipped_pattern")).alias("skipped_total"),
        F.when(F.col("pages") >= F.col("max_pages"), "max_pages_reached")
        .when(F.col("queue_remaining") == 0, "queue_exhausted")
        .otherwise("stopped_early")
        .alias("stop_reason"),
    )
