"""Crawl frontier: bounded breadth-first search over the link graph of many jobs.

Per-page work is done for the whole corpus beforehand; only narrow edge rows
take part here. Edges, answers and visits lie in buckets by address, so a level
moves its own frontier and nothing else. Visit order is a distributed running
total, so a job with most of the pages is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import is_same_domain, matches_regexes, normalize_url
from pagemill.operators.scale import Buckets, durable, is_small, join_dimension, join_hot, running_totals

LINKS_PER_PART = 4096

OK, BAD_DOMAIN, BAD_PATTERN = "ok", "domain", "pattern"


def link_edges(pages: DataFrame) -> DataFrame:
    """G1: edges of pages with ``internal_links``; only sound HTML pages are followed."""
    return (
        pages.filter(F.col("is_html") & ~F.col("is_error"))
        .select(
            "job_id",
            normalize_url("requested_url").alias("src"),
            F.col("normalized_url").alias("from_url"),
            "internal_links",
        )
        .select("job_id", "src", "from_url", F.posexplode("internal_links").alias("pos", "link"))
        .select("job_id", "src", "from_url", normalize_url("link").alias("dst"), "pos")
    )


def fetched_pages(pages: DataFrame) -> DataFrame:
    """One response per requested URL, with the URL it ended at.

    Failed fetches (``error_type`` set) are no pages.
    """
    answered = pages.filter(F.col("error_type").isNull())
    return answered.groupBy("job_id", normalize_url("requested_url").alias("url")).agg(
        F.min(F.struct("page_id", "normalized_url")).alias("_p")
    ).select("job_id", "url", "_p.page_id", "_p.normalized_url")


def _admission() -> Column:
    """Domain first, then patterns."""
    return (
        F.when(~is_same_domain("url", "domains"), BAD_DOMAIN)
        .when(~matches_regexes(F.col("url"), F.col("include_regexes"), F.col("exclude_regexes")), BAD_PATTERN)
        .otherwise(OK)
    )


def edge_buckets(edges: DataFrame) -> Buckets:
    """The edges, dealt once by source and part.

    ``part`` numbers the links of a source in slices of ``LINKS_PER_PART`` by
    their position: a page with a million links is many sources that each any
    task may take.
    """
    parted = edges.withColumn("part", F.floor(F.col("pos") / LINKS_PER_PART).cast("int"))
    return Buckets(edges.sparkSession, ["job_id", "src", "part"]).append(parted)


def answer_buckets(fetched: DataFrame, edges: DataFrame) -> Buckets:
    """The responses, dealt once by address, each with the number of its parts in ``edge_buckets``."""
    parts = edges.groupBy("job_id", F.col("src").alias("url")).agg((F.max("part") + 1).alias("parts"))
    return Buckets(fetched.sparkSession, ["job_id", "url"]).append(fetched.join(parts, ["job_id", "url"], "left").na.fill(0, ["parts"]))


def linked_from(level: DataFrame, graph: DataFrame) -> DataFrame:
    """``job_id, url, entry``: the targets of a level's pages, each with its first place in the queue.

    The pages go to the edges, one row for each part; no edge is moved before it
    is known to be needed.
    """
    sources = level.filter("is_page AND parts > 0").select(
        "job_id", F.col("url").alias("src"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("visit_order").alias("src_order")
    )
    return (
        graph.join(sources, ["job_id", "src", "part"])
        .groupBy("job_id", F.col("dst").alias("url"))
        .agg(F.min(F.struct("src_order", "pos", "from_url")).alias("entry"))
    )


def fresh_answers(queue: DataFrame, visited: DataFrame | None, answers: DataFrame) -> DataFrame:
    """The queue without visited addresses, with the responses; only the queue is moved."""
    if visited is not None:
        queue = queue.join(visited.select("job_id", "url"), ["job_id", "url"], "left_anti")
    return queue.join(answers, ["job_id", "url"], "left")


def crawl_frontier(edges: DataFrame, jobs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every visited URL with depth, parent, visit order and page rank.

    ``edges(job_id, src, from_url, dst, pos)``, ``fetched(job_id, url, page_id,
    normalized_url)``; jobs as from ``prepare_jobs``. A visit is a page if it was
    admitted and has a response; visits end with the page that fills ``max_pages``.
    """
    spark = edges.sparkSession
    limits = durable(jobs.select("job_id", "domains", "include_regexes", "exclude_regexes", "max_pages", "max_depth"))
    small = is_small(limits)

    def with_limits(rows: DataFrame) -> DataFrame:
        return join_dimension(rows, limits, ["job_id"], ["url"], small=small)

    graph = edge_buckets(edges)
    answers = answer_buckets(fetched, graph.read())
    visits = Buckets(spark, ["job_id", "url"])
    deepest = limits.agg(F.max("max_depth")).first()[0]
    if deepest is None:
        deepest = -1
    queue = jobs.select(
        "job_id",
        normalize_url("start_url").alias("url"),
        F.struct(
            F.lit(0).cast("bigint").alias("src_order"),
            F.lit(0).alias("pos"),
            F.lit(None).cast("string").alias("from_url"),
        ).alias("entry"),
    )
    admission, level = _admission(), None
    for depth in range(max(0, deepest) + 1):
        fresh = fresh_answers(queue, None if level is None else visits.read(), answers.read())
        judged = (
            with_limits(fresh)
            .filter(F.col("max_depth") >= depth)
            .withColumn("admission", admission)
            .withColumn("is_page", (F.col("admission") == OK) & F.col("page_id").isNotNull())
            .select(
                "job_id", "url", "entry.*", "admission", "is_page", "max_pages", "parts",
                F.when(F.col("is_page"), F.col("page_id")).alias("page_id"),
                F.when(F.col("is_page"), F.col("normalized_url")).alias("normalized_url"),
            )
        )
        ranked = running_totals(
            judged,
            ["job_id"],
            ["src_order", "pos", "url"],
            {"visit_order": F.lit(1).cast("bigint"), "page_rank": F.col("is_page").cast("bigint")},
        )
        if level is not None:
            # A job that goes on had visits at the level before.
            so_far = level.groupBy("job_id").agg(F.max("visit_order").alias("_visits"), F.max("page_rank").alias("_pages"))
            totals = ("visit_order", "_visits"), ("page_rank", "_pages")
            ranked = join_dimension(ranked, so_far, ["job_id"], ["url"], small=small)
            ranked = ranked.withColumns({name: F.col(name) + F.col(base) for name, base in totals})
        visits.append(
            ranked.filter(F.col("page_rank") - F.col("is_page").cast("bigint") < F.col("max_pages")).select(
                "job_id", "url", F.lit(depth).alias("depth"), F.col("from_url").alias("discovered_from"),
                "src_order", "pos", "visit_order", "admission", "is_page", "page_rank", "page_id", "normalized_url", "parts",
            )
        )
        level = visits.read().filter(F.col("depth") == depth)
        if level.isEmpty():
            break
        queue = linked_from(level, graph.read())
    graph.closed()
    answers.closed()
    return visits.closed().drop("parts")


def queue_entries(visits: DataFrame, edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """Everything that was ever queued and what became of it.

    A link is queued unless its target was visited before its source was done.
    ``outcome``: visit, skipped_visited, skipped_depth, or queued (never taken out).
    """
    sources = visits.filter("is_page").select(
        "job_id", F.col("url").alias("src"), F.col("visit_order").alias("src_order"), (F.col("depth") + 1).alias("depth")
    )
    pushed = edges.select("job_id", "src", "dst", "pos").join(sources, ["job_id", "src"])
    targets = visits.select(
        "job_id", F.col("url").alias("dst"), F.col("visit_order").alias("dst_order"),
        F.struct(F.col("src_order").alias("o"), F.col("pos").alias("p")).alias("first_at"), "admission", "is_page",
    )
    # A home page is the target of a large share of all links.
    found = join_hot(pushed, targets, ["job_id", "dst"], ["src_order", "pos"])
    stops = visits.join(
        jobs.select("job_id", F.col("max_pages").alias("page_rank")), ["job_id", "page_rank"]
    ).filter("is_page").select("job_id", F.struct("depth", "src_order", "pos").alias("stop_at"))
    entries = join_dimension(
        found.filter(F.col("dst_order").isNull() | (F.col("dst_order") > F.col("src_order"))),
        jobs.select("job_id", "max_depth").join(stops, "job_id", "left"),
        ["job_id"],
        ["dst", "src_order", "pos"],
    )
    here = F.struct("depth", "src_order", "pos")
    first = F.col("first_at") == F.struct(F.col("src_order").alias("o"), F.col("pos").alias("p"))
    outcome = (
        F.when(F.col("stop_at").isNotNull() & (here > F.col("stop_at")), "queued")
        .when(F.col("dst_order").isNull(), "skipped_depth")
        .when(first, "visit")
        .otherwise("skipped_visited")
    )
    return entries.select(
        "job_id", F.col("dst").alias("url"), "depth", "src_order", "pos", outcome.alias("outcome"),
        F.when(outcome == "visit", F.col("admission")).alias("admission"),
        F.when(outcome == "visit", F.col("is_page")).otherwise(False).alias("is_page"),
        F.when(outcome == "visit", F.col("dst_order")).alias("visit_order"),
    )


def skip_counts(visits: DataFrame, entries: DataFrame) -> DataFrame:
    """Skip counters and what is left in the queue, per job."""

    def times(condition: Column) -> Column:
        return F.sum(condition.cast("bigint"))

    refused = visits.groupBy("job_id").agg(
        F.count("*").alias("visited"),
        times(F.col("is_page")).alias("pages"),
        times(F.col("admission") == BAD_DOMAIN).alias("skipped_domain"),
        times(F.col("admission") == BAD_PATTERN).alias("skipped_pattern"),
    )
    queued = entries.groupBy("job_id").agg(
        times(F.col("outcome") == "skipped_visited").alias("skipped_visited"),
        times(F.col("outcome") == "skipped_depth").alias("skipped_depth"),
        times(F.col("outcome") == "queued").alias("queue_remaining"),
    )
    return refused.join(queued, "job_id", "left").na.fill(0, ["skipped_visited", "skipped_depth", "queue_remaining"])


def crawl_progress(visits: DataFrame, entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """K8: per crawled page the counters at that moment, and percent of ``max_pages``."""
    pushes = entries.groupBy("job_id", F.col("src_order").alias("visit_order")).agg(F.count("*").alias("_pushed"))
    # The start URL's own entry precedes all others.
    start = visits.filter("src_order = 0").select(
        "job_id", "url", "depth", "src_order", "pos", F.lit("visit").alias("outcome"), "admission", "is_page", "visit_order"
    )
    taken = (
        entries.filter("outcome != 'queued'")
        .unionByName(start)
        .join(pushes, ["job_id", "visit_order"], "left")
        .withColumn("_pushed", F.coalesce("_pushed", F.lit(0).cast("bigint")))
    )
    skipped = (F.col("outcome") != "visit") | (F.col("admission") != OK)
    totals = running_totals(
        taken,
        ["job_id"],
        ["depth", "src_order", "pos", "url"],
        {
            "_taken": F.lit(1).cast("bigint"),
            "crawled": F.col("is_page").cast("bigint"),
            "skipped": skipped.cast("bigint"),
            "_all_pushed": F.col("_pushed"),
            "_visited": (F.col("outcome") == "visit").cast("bigint"),
        },
    )
    queue_size = F.lit(1) + F.col("_all_pushed") - F.col("_taken")
    counted = totals.filter("is_page").select(
        "job_id", "url", "crawled", queue_size.alias("queue_size"),
        (F.col("_visited") + queue_size).alias("discovered"), "skipped",
    )
    return join_dimension(counted, jobs.select("job_id", "max_pages"), ["job_id"], ["url"]).select(
        "job_id", "url", "crawled", "queue_size", "discovered", "skipped",
        F.when(F.col("max_pages") > 0, F.rint(F.col("crawled") / F.col("max_pages") * 100).cast("bigint")).alias("percent"),
    )
