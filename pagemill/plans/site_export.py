"""Whole flows: stored responses of many jobs to documents, links and a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import __version__
from pagemill.functions.frontmatter import frontmatter, render_document
from pagemill.operators import content, incremental, links, metadata, sitemaps
from pagemill.operators.frontier import crawl_frontier, fetched_pages, link_edges, queue_entries, skip_counts
from pagemill.operators.jobs import prepare_jobs
from pagemill.operators.markdown import to_markdown
from pagemill.operators.pages import describe_pages, markdown_gate
from pagemill.operators.scale import Buckets, durable, join_dimension
from pagemill.sources.document_sink import write_files
from pagemill.sources.html_tree import parse_pages
from pagemill.sources.manifest import run_header, write_manifest, write_nested_manifests


def enrich_pages(responses: DataFrame, jobs: DataFrame) -> DataFrame:
    """All per-page work in one pass without a shuffle: one row per response.

    Links, metadata and the rendered document come from one parse; the node array
    never leaves the stage. ``html`` is kept for the html sink only and is pruned
    when nobody selects it.
    """
    parsed = parse_pages(describe_pages(responses))
    decided = links.page_decisions(parsed, jobs)
    with_lists = decided.withColumns(
        {
            "internal_links": links.internal_links(),
            "asset_links": links.asset_links(),
            "links_from_result": links.source_count(links.PAYLOAD),
            "links_from_html_fallback": links.source_count(links.HTML),
        }
    )
    described = metadata.page_metadata(with_lists)
    rendered = markdown_gate(to_markdown(content.extract_job_content(described, jobs, ("save_markdown",))))
    front = frontmatter(F.col("page_metadata"), rendered.schema["page_metadata"].dataType)
    return rendered.withColumn("document", render_document(front, F.col("markdown"))).drop(
        "nodes", "content", "container_id", "headers"
    )


@dataclass
class Export:
    """Result tables of one run.

    ``pages`` lies in buckets by ``(job_id, page_id)``. ``writes(job_id, page_id,
    kind, rel_path)`` names the files this run has to write, one page for each.
    """

    pages: DataFrame
    visits: DataFrame
    manifest: dict[str, DataFrame]
    summary: DataFrame
    writes: DataFrame

    def documents(self, kind: str) -> DataFrame:
        """``job_id, rel_path, text`` of the files to write; the names go to the texts, which stay where they are."""
        text = "document" if kind == "markdown" else "html"
        wanted = self.writes.filter(F.col("kind") == kind)
        return self.pages.select("job_id", "page_id", F.col(text).alias("text")).join(wanted, ["job_id", "page_id"]).select("job_id", "rel_path", "text")


def files_to_write(pages: DataFrame, visits: DataFrame, jobs: DataFrame, existing: DataFrame | None) -> DataFrame:
    """K2, S5, S6 on narrow rows: ``job_id, page_id, kind, rel_path``.

    A visited page's file is written if the page changed or the file is missing
    in ``existing(job_id, rel_path)``. Of pages that share a path the last one
    visited counts.
    """
    narrow = pages.select("job_id", "page_id", "is_error", "change_status", "writes_markdown", "html_path", "markdown_path")
    visited = visits.filter("is_page").select("job_id", "page_id", "visit_order").join(narrow, ["job_id", "page_id"])
    rows = join_dimension(visited, jobs.select("job_id", "save_html"), ["job_id"], ["page_id"])
    files = F.array(
        F.struct(F.lit("markdown").alias("kind"), F.concat(F.lit("pages/"), "markdown_path").alias("rel_path"), F.col("writes_markdown").alias("wanted")),
        F.struct(F.lit("html").alias("kind"), F.concat(F.lit("html/"), "html_path").alias("rel_path"), (F.col("save_html") & ~F.col("is_error")).alias("wanted")),
    )
    each = rows.select("job_id", "page_id", "visit_order", "change_status", F.inline(files)).filter("wanted")
    if existing is None:
        needed = each
    else:
        needed = incremental.needs_write(each, existing, "rel_path").filter("needs_write")
    return needed.groupBy("job_id", "kind", "rel_path").agg(F.max_by("page_id", "visit_order").alias("page_id")).select("job_id", "page_id", "kind", "rel_path")


def export_sites(
    responses: DataFrame,
    jobs: DataFrame,
    previous: DataFrame,
    asset_responses: DataFrame,
    sitemap_responses: DataFrame | None = None,
    started_at: str = "",
    finished_at: str = "",
    existing: DataFrame | None = None,
) -> Export:
    """Entry A: crawl order, change status, documents and manifest of every job.

    Enriched pages are written once, as columns in buckets by page. What follows
    works on the few columns it needs; neither html nor a document is moved
    again. ``existing(job_id, rel_path)`` lists the files that are already there.
    """
    prepared = prepare_jobs(jobs)
    store = Buckets(responses.sparkSession, ["job_id", "page_id"]).append(enrich_pages(responses, prepared))
    narrow = store.read().select("job_id", "page_id", "normalized_url", "content_hash")
    status = Buckets(responses.sparkSession, ["job_id", "page_id"]).append(
        incremental.change_status(narrow, previous).select("job_id", "page_id", "change_status")
    )
    pages = store.read().join(status.read(), ["job_id", "page_id"])
    edges = link_edges(pages)
    fallback = None
    if sitemap_responses is not None:
        seeds = sitemaps.robots_sitemaps(sitemap_responses, prepared, fetched_pages(pages))
        expanded = sitemaps.expand_sitemaps(seeds, sitemap_responses, prepared)
        fallback = sitemaps.sitemap_fallback(pages, expanded, prepared)
        edges = edges.unionByName(sitemaps.fallback_edges(fallback))
    edges = durable(edges)
    visits = crawl_frontier(edges, prepared, fetched_pages(pages))
    candidates = durable(incremental.asset_candidates(pages, visits, prepared, fallback))
    manifest = {
        "runs": run_header(jobs, started_at, finished_at, __version__),
        "pages": incremental.manifest_pages(pages, visits, prepared),
        "assets": incremental.manifest_assets(candidates, asset_responses),
        "errors": incremental.manifest_errors(pages, visits, candidates, asset_responses),
    }
    counts = skip_counts(visits, queue_entries(visits, edges, prepared))
    summary = incremental.run_summary(counts, manifest["assets"], manifest["errors"], prepared)
    return Export(pages, visits, manifest, summary, durable(files_to_write(pages, visits, prepared, existing)))


def write_run(run: Export, root: str, run_id: str) -> None:
    """Files below ``root/files``, the manifest as tables and as one nested document per job."""
    for kind in ("markdown", "html"):
        write_files(run.documents(kind), f"{root}/files")
    write_manifest(run.manifest, f"{root}/manifest", run_id)
    write_nested_manifests(run.manifest, f"{root}/documents/run_id={run_id}")
