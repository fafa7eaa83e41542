"""Sitemaps as a second source of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import strip
from pagemill.operators.scale import Buckets, join_dimension, row_numbers
from pagemill.sources.sitemaps import listed_locations

_LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def robots_sitemaps(responses: DataFrame, jobs: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """M1: ``(job_id, sitemap_url)``: ``/sitemap.xml`` and what robots.txt names.

    ``responses(job_id, url, status_code, body)`` holds stored robots and sitemap
    files. They belong to the address the start page ended at, as
    ``fetched(job_id, url, normalized_url)`` has it; a start page that is not
    there stands for itself.
    """
    page_url = urls.normalize_url("start_url")
    seeds = jobs.select("job_id", page_url.alias("page_url"))
    if fetched is not None:
        ended = fetched.select("job_id", F.col("url").alias("page_url"), F.col("normalized_url").alias("final_url"))
        seeds = seeds.join(ended, ["job_id", "page_url"], "left").select("job_id", F.coalesce("final_url", "page_url").alias("page_url"))
    starts = seeds.withColumns(
        {
            "robots_url": urls.url_resolve("page_url", F.lit("/robots.txt")),
            "default_url": urls.normalize_link(F.lit("/sitemap.xml"), "page_url"),
        }
    )
    robots = responses.filter((F.col("status_code") < 400) & F.col("url").endswith("/robots.txt"))
    lines = robots.select("job_id", "url", F.explode(F.split("body", _LINE_BREAKS)).alias("line")).filter(
        F.lower("line").startswith("sitemap:")
    )
    named = lines.join(starts, (lines["job_id"] == starts["job_id"]) & (lines["url"] == starts["robots_url"])).select(
        starts["job_id"],
        urls.normalize_link(strip(F.regexp_extract("line", r"(?s)\A[^:]*:(.*)\z", 1)), "page_url").alias("sitemap_url"),
    )
    return (
        starts.select("job_id", F.col("default_url").alias("sitemap_url"))
        .unionByName(named)
        .filter(F.col("sitemap_url").isNotNull())
        .distinct()
    )


def listed(responses: DataFrame) -> DataFrame:
    """M4: the locations of all stored sitemaps, and their errors, as ``listed_locations`` has them.

    ``responses(job_id, url, status_code)`` with the text as ``body`` or the file as ``content``.
    """
    content = F.col("content") if "content" in responses.columns else F.col("body").cast("binary")
    stored = responses.filter((F.col("status_code") < 400) & ~F.col("url").endswith("/robots.txt"))
    return listed_locations(stored.select("job_id", "url", content.alias("content")))


def sitemap_errors(locations: DataFrame) -> DataFrame:
    """Sitemaps that cannot be read, as rows of K5."""
    bad = locations.filter(F.col("error_type").isNotNull())
    return bad.select("job_id", F.col("sitemap_url").alias("url"), F.lit("sitemap").alias("stage"), "error_type", "message")


def sitemap_entries(locations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every listed location with its route: sitemap, asset or page; others are dropped."""
    dimension = jobs.select(
        "job_id", F.struct("domains", "include_regexes", "exclude_regexes", "listed_extensions").alias("_job")
    )
    normal = locations.filter(F.col("loc").isNotNull()).withColumn("url", urls.normalize_link("loc", "sitemap_url")).filter(F.col("url").isNotNull())
    job = F.col("_job")
    # The extensions count as configured here: no dot or lower case is added.
    attachment = F.exists(job["listed_extensions"], lambda e: F.lower("url").endswith(e))
    kind = (
        F.when(~urls.is_same_domain("url", job["domains"]), F.lit(None).cast("string"))
        .when(F.col("url").endswith(".xml") | F.col("url").endswith(".xml.gz"), "sitemap")
        .when(attachment | urls.looks_like_asset("url"), "asset")
        .when(urls.matches_regexes(F.col("url"), job["include_regexes"], job["exclude_regexes"]), "page")
    )
    return (
        join_dimension(normal, dimension, ["job_id"], ["sitemap_url", "url"])
        .select("job_id", "sitemap_url", "url", kind.alias("kind"))
        .filter(F.col("kind").isNotNull())
    )


def reachable_sitemaps(seeds: DataFrame, entries: DataFrame) -> DataFrame:
    """All sitemaps found from the seeds, each once; ends when a round finds no new one.

    ``entries`` in buckets by ``(job_id, sitemap_url)``, as are the sitemaps seen:
    a round moves the sitemaps it finds and nothing else.
    """
    keys = ["job_id", "sitemap_url"]
    nested = entries.filter("kind = 'sitemap'").select(*keys, F.col("url").alias("next_url"))
    seen, number = Buckets(entries.sparkSession, keys), 0
    seen.append(seeds.select(*keys).distinct().withColumn("round", F.lit(0)))
    while not (latest := seen.read().filter(F.col("round") == number)).isEmpty():
        found = latest.join(nested, keys).select("job_id", F.col("next_url").alias("sitemap_url")).distinct()
        number += 1
        seen.append(found.join(seen.read(), keys, "left_anti").withColumn("round", F.lit(number)))
    return seen.read().select(*keys)


def expand_sitemaps(seeds: DataFrame, responses: DataFrame, jobs: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """M3: distinct ``(job_id, url, kind)`` of pages and assets under the seeds.

    Every stored sitemap is read once (``locations``, as ``listed`` gives them,
    passes on an earlier reading); the walk over the tree has narrow rows in buckets.
    """
    entries = sitemap_entries(listed(responses) if locations is None else locations, jobs)
    store = Buckets(entries.sparkSession, ["job_id", "sitemap_url"]).append(entries)
    reached = reachable_sitemaps(seeds, store.read())
    return (
        store.read()
        .filter("kind != 'sitemap'")
        .join(reached, ["job_id", "sitemap_url"], "left_semi")
        .select("job_id", "url", "kind")
        .distinct()
    )


def fallback_roots(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """M5: start pages that are sound HTML and have no internal link."""
    starts = jobs.select("job_id", urls.normalize_url("start_url").alias("src"))
    empty = pages.filter(F.col("is_html") & ~F.col("is_error") & (F.size("internal_links") == 0))
    return (
        empty.select("job_id", urls.normalize_url("requested_url").alias("src"), F.col("normalized_url").alias("from_url"))
        .join(starts, ["job_id", "src"])
        .distinct()
    )


def sitemap_fallback(pages: DataFrame, expanded: DataFrame, jobs: DataFrame) -> DataFrame:
    """M5: ``(job_id, src, from_url, url, kind)`` from link-less start pages to sitemap URLs."""
    roots = fallback_roots(pages, jobs)
    return join_dimension(expanded, roots, ["job_id"], ["url"]).select("job_id", "src", "from_url", "url", "kind")


def fallback_edges(fallback: DataFrame) -> DataFrame:
    """The page part of M5 as graph edges, in sorted order."""
    pages = fallback.filter("kind = 'page'")
    numbered = row_numbers(pages, ["job_id"], ["url"], "n")
    return numbered.select(
        "job_id", "src", "from_url", urls.normalize_url("url").alias("dst"), (F.col("n") - 1).cast("int").alias("pos")
    )
