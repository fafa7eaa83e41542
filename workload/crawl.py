"""Crawl frontier and sitemaps over sites built from the pages.

Page ``k`` is node ``i = k div 4`` of site ``k mod 4``. The ``n`` nodes of a site
form a tree (children b*i+1 to b*i+b), so breadth-first order is the order of
``i`` and every expected number has a closed form. The fan-out ``b`` grows with the
site: it is the least with which five levels below the start hold all nodes, so
every page of sites 0 and 3 is visited at any size; on site 2 it is one less, so
that the depth limit cuts the last nodes off, and site 1 stops at half its
pages. Each page also links to its home page, to itself, to a foreign host and
to a blocked path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.urls import normalize_url
from pagemill.operators import frontier as G
from pagemill.operators import incremental as I
from pagemill.operators import sitemaps as S
from pagemill.operators.jobs import JOB_SCHEMA, effective_domains, prepare_jobs
from pagemill.operators.links import internal_links, page_decisions
from pagemill.operators.scale import durable
from pagemill.sources.document_sink import write_files
from pagemill.sources.sitemaps import read_sitemaps
from pagemill.sources.sitemaps import sitemap_locs as listed_locs
from workload import corpus
from workload.corpus import with_pages
from workload.registry import query
from workload.sources import _folder

MAX_DEPTH, MANY_PAGES = 5, 2_000_000_000
_HELD = "1 + {0} + {0} * {0} + {0} * {0} * {0} + {0} * {0} * {0} * {0} + {0} * {0} * {0} * {0} * {0} >= n"  # within MAX_DEPTH
_SITE = "concat('https://site', page_id % 4, '.example')"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described pages of the four sites with their link lists."""
    base = corpus.pages(spark, sf_dir).selectExpr(
        "page_id", "concat('site', page_id % 4) AS job_id", f"{_SITE} AS site", "page_id div 4 AS i", "html"
    )
    rows = base.join(F.broadcast(site_sizes(spark, sf_dir)), "job_id")  # four rows
    leaf = "b * i + 1 >= n"
    return rows.selectExpr(
        "job_id",
        "page_id",
        "concat(site, '/p/', i, '/') AS requested_url",
        "concat(site, '/p/', i) AS url",
        "concat(site, '/p/', i) AS normalized_url",
        f"CASE WHEN {leaf} AND page_id % 17 = 0 THEN 404 ELSE 200 END AS status_code",
        f"{leaf} AND page_id % 17 = 0 AS is_error",
        "true AS is_html",
        f"CASE WHEN {leaf} AND page_id % 19 = 0 THEN 'TimeoutException' END AS error_type",
        f"CASE WHEN {leaf} AND page_id % 19 = 0 THEN 'timed out' END AS error_message",
        "concat(transform(filter(transform(sequence(1, b), c -> b * i + c), c -> c < n), c -> concat(site, '/p/', c)),"
        " array(concat(site, '/p/0'), concat(site, '/p/', i), 'https://out.example/x', concat(site, '/blocked/', i))) AS internal_links",
        "array(concat(site, '/logo.pdf'), concat(site, '/f/', i, '.PDF'), concat(site, '/i/', i, '.gif')) AS asset_links",
    )


def site_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, j, n, b``: pages and fan-out of the four sites."""
    sizes = corpus.pages(spark, sf_dir).groupBy(F.expr("page_id % 4 AS j")).agg(F.count("*").alias("n"))
    least = f"array_min(filter(sequence(2L, 2L + cast(ceil(pow(n, 0.2)) AS bigint)), b -> {_HELD.format('b')}))"
    return sizes.selectExpr("concat('site', j) AS job_id", "j", "n", f"greatest(2L, {least} - if(j = 2, 1, 0)) AS b")


def raw_site_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site_sizes(spark, sf_dir)
    return (
        rows.selectExpr(
            "concat('site', j) AS job_id", "concat('https://SITE', j, '.example/p/0/') AS start_url",
            "cast(array() AS array<string>) AS allowed_domains", "cast(array() AS array<string>) AS include_patterns",
            "array('*/blocked/*') AS exclude_patterns", "array('pdf') AS attachment_extensions",
            f"CASE WHEN j = 1 THEN n div 2 ELSE {MANY_PAGES} END AS max_pages", f"{MAX_DEPTH} AS max_depth",
            "'main' AS content_extraction", "true AS save_html", "true AS save_markdown", "true AS download_attachments",
        ).to(T.StructType.fromDDL(JOB_SCHEMA))
    )


def site_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_jobs(raw_site_jobs(spark, sf_dir))


# failed: no response, so no page; prank: pages of the site up to this node.
TREE = f"""
sizes AS (SELECT k % 4 AS j, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT j, n, greatest(2, (SELECT min(x) FROM range(2, 1000) t(x) WHERE {_HELD.format('x')}) - (j = 2)::INT) AS b FROM sizes),
e AS (SELECT p.k, p.k % 4 AS j, p.k // 4 AS i, n, b, CASE WHEN p.k % 4 = 1 THEN n // 2 ELSE {MANY_PAGES} END AS max_pages,
  'site' || p.k % 4 AS job_id, 'https://site' || p.k % 4 || '.example' AS site,
  (i >= 1)::BIGINT + (i > b)::INT + (i > b + b^2)::INT + (i > b + b^2 + b^3)::INT + (i > b + b^2 + b^3 + b^4)::INT + (i > b + b^2 + b^3 + b^4 + b^5)::INT AS depth,
  CASE WHEN i > 0 THEN (i - 1) // b ELSE 0 END AS parent, b * i + 1 >= n AS leaf FROM p JOIN s ON p.k % 4 = s.j),
f AS (SELECT *, leaf AND k % 19 = 0 AS failed, leaf AND k % 17 = 0 AS bad FROM e),
r AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY j ORDER BY i) AS prank FROM f),
v AS (SELECT *, NOT failed AS is_page, 1 + i + parent + (parent >= 1)::INT AS visit_order FROM r
  WHERE depth <= {MAX_DEPTH} AND prank - (NOT failed)::INT < max_pages)"""


def sql(body: str) -> str:
    return with_pages("," + TREE + "\n" + body).replace(")\n\n,", "),")


def crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, edges, jobs and visits of one crawl."""
    pages = site_pages(spark, sf_dir)
    jobs = site_jobs(spark, sf_dir)
    edges = G.link_edges(pages)
    return pages, edges, jobs, G.crawl_frontier(edges, jobs, G.fetched_pages(pages))


@query(
    "link_edges",
    with_pages(
        """SELECT host AS job_id, i - 1 AS pos, normalized_url AS src, site || h AS dst
FROM (SELECT *, unnest(list_sort(list_distinct(hrefs))) AS h, generate_subscripts(list_sort(list_distinct(hrefs)), 1) AS i FROM n)
WHERE status_code < 400"""
    ),
)
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 from the given pages' own links."""
    decided = page_decisions(corpus.parsed(spark, sf_dir).withColumn("links_payload", F.lit(None).cast("string")), corpus.prepared_jobs(spark, sf_dir))
    pages = decided.withColumn("internal_links", internal_links())
    return G.link_edges(pages).select("job_id", F.col("pos").cast("bigint"), "src", "dst")


@query("crawl_frontier", sql("""
SELECT job_id, site || '/p/' || i AS url, depth, CASE WHEN i > 0 THEN site || '/p/' || parent END AS discovered_from,
  visit_order::BIGINT AS visit_order, is_page, prank::BIGINT AS page_rank FROM v"""))
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, depth, parent and page limit."""
    *_, visits = crawled(spark, sf_dir)
    return visits.filter("admission = 'ok'").select(
        "job_id", "url", F.col("depth").cast("bigint"), "discovered_from", "visit_order", "is_page", "page_rank"
    )


@query("admission_filters", sql("""
, l AS (SELECT j, max(parent) AS last_parent, bool_or(is_page AND prank = max_pages) AS stopped FROM v GROUP BY 1)
SELECT v.job_id, site || '/blocked/' || i AS url, 'pattern' AS admission, depth + 1 AS depth FROM v JOIN l ON v.j = l.j
  WHERE is_page AND NOT bad AND depth < 5 AND (NOT stopped OR i < last_parent)
UNION ALL SELECT DISTINCT v.job_id, 'https://out.example/x', 'domain', 1::BIGINT FROM v"""))
def admission_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused addresses and why."""
    *_, visits = crawled(spark, sf_dir)
    return visits.filter("admission != 'ok'").select("job_id", "url", "admission", F.col("depth").cast("bigint"))


@query("page_limits", sql("""
SELECT job_id, count(*)::BIGINT AS n_pages, max(i)::BIGINT AS last_node, max(depth)::BIGINT AS deepest FROM v WHERE is_page GROUP BY 1"""))
def page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 per site."""
    *_, visits = crawled(spark, sf_dir)
    return visits.filter("is_page").groupBy("job_id").agg(
        F.count("*").alias("n_pages"),
        F.max(F.expr("page_id div 4")).alias("last_node"),
        F.max("depth").cast("bigint").alias("deepest"),
    )


@query(
    "effective_domains",
    with_pages("SELECT page_id, CASE WHEN k % 2 = 0 THEN host || ':81' ELSE 'a.example|b.example' END AS domains FROM p"),
)
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 for one job per page."""
    rows = corpus.pages(spark, sf_dir).selectExpr(
        "page_id",
        "concat(substring_index(url, '/', 3), ':81/', page_id) AS start_url",
        "CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 2 = 0 THEN cast(array() AS array<string>) ELSE array('a.example', 'b.example') END AS allowed_domains",
    )
    return effective_domains(rows).select("page_id", F.array_join("domains", "|").alias("domains"))


# Per site: outs are the queued links to the foreign host, two of them repeats.
_COUNTS = """
, t AS (SELECT j, any_value(job_id) AS job_id, any_value(n) AS n, any_value(b) AS b, any_value(max_pages) AS max_pages, max(i) AS last, sum(is_page::INT) AS pages,
    count(*) AS nodes, bool_or(is_page AND prank = max_pages) AS stopped, max(parent) AS last_parent FROM v GROUP BY 1)
, q AS (SELECT v.j, sum(greatest(0, least(v.b, v.n - 1 - v.b * v.i))) AS kids, count(*) AS srcs,
    sum(CASE WHEN depth = 5 THEN 1 + greatest(0, least(v.b, v.n - 1 - v.b * v.i)) ELSE 0 END) AS deep,
    sum((depth < 5)::INT) AS shallow FROM v WHERE is_page AND NOT bad GROUP BY 1)
, z AS (SELECT t.*, q.*, 1 + kids + srcs + least(srcs, b + 1) AS pushed, CASE WHEN stopped THEN greatest(0, least(b, last_parent - 1)) ELSE b END AS repeats,
    (SELECT count(*) FROM v b WHERE b.j = t.j AND b.is_page AND NOT b.bad AND b.i < t.last_parent) AS blocked_before FROM t JOIN q ON t.j = q.j)
, c AS (SELECT job_id, pages, n, max_pages,
    CASE WHEN stopped THEN pushed - (nodes + blocked_before + 1 + repeats) ELSE 0 END AS queue_remaining,
    repeats AS skipped_visited, CASE WHEN stopped THEN 0 ELSE deep END AS skipped_depth, 1 AS skipped_domain,
    CASE WHEN stopped THEN blocked_before ELSE shallow END AS skipped_pattern FROM z)"""


@query("skip_counts", sql(_COUNTS + """
SELECT job_id, pages::BIGINT AS pages, queue_remaining::BIGINT AS queue_remaining, skipped_visited::BIGINT AS skipped_visited,
  skipped_depth::BIGINT AS skipped_depth, skipped_domain::BIGINT AS skipped_domain, skipped_pattern::BIGINT AS skipped_pattern FROM c"""))
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    _, edges, jobs, visits = crawled(spark, sf_dir)
    return G.skip_counts(visits, G.queue_entries(visits, edges, jobs)).drop("visited")


@query("redirects", sql("""
SELECT job_id, site || '/p/' || i AS url, site || '/final/' || i // 2 AS normalized_url, CASE WHEN i > 0 THEN site || '/final/' || parent // 2 END AS discovered_from
FROM v WHERE is_page"""))
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests may end at one address; both are pages."""
    pages = site_pages(spark, sf_dir).withColumn("normalized_url", F.expr("concat(substring_index(url, '/', 3), '/final/', page_id div 8)"))
    visits = G.crawl_frontier(G.link_edges(pages), site_jobs(spark, sf_dir), G.fetched_pages(pages))
    return visits.filter("is_page").select("job_id", "url", "normalized_url", "discovered_from")


@query("crawl_progress", sql("""
, w AS (SELECT v.*, (SELECT count(*) FROM v b WHERE b.j = v.j AND b.is_page AND NOT b.bad AND b.i < v.parent) AS blocked,
    (parent >= 1)::INT AS outs, greatest(0, least(b, parent - 1)) AS repeats,
    (SELECT sum(greatest(0, least(a.b, a.n - 1 - a.b * a.i)) + 1) FROM v a WHERE a.j = v.j AND a.i <= v.i AND a.is_page AND NOT a.bad) AS pushed FROM v)
, x AS (SELECT *, pushed + least(i + 1, b + 1) + 1 - (1 + i + blocked + outs + repeats) AS queue_size FROM w)
SELECT job_id, site || '/p/' || i AS url, prank::BIGINT AS crawled, queue_size::BIGINT AS queue_size,
  (1 + i + blocked + outs + queue_size)::BIGINT AS discovered, (blocked + outs + repeats)::BIGINT AS skipped,
  round_even(prank / max_pages * 100, 0)::BIGINT AS percent FROM x WHERE is_page"""))
def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8."""
    _, edges, jobs, visits = crawled(spark, sf_dir)
    return G.crawl_progress(visits, G.queue_entries(visits, edges, jobs), jobs)


def asset_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored attachments: missing for some nodes, failed for others."""
    files = site_pages(spark, sf_dir).selectExpr(
        "job_id", "page_id", "concat(substring_index(url, '/', 3), '/f/', page_id div 4, '.PDF') AS url"
    )
    logos = site_jobs(spark, sf_dir).selectExpr("job_id", "cast(2 as bigint) AS page_id", "concat('https://', job_id, '.example/logo.pdf') AS url")
    return files.filter("page_id % 5 != 0").unionByName(logos).selectExpr(
        "job_id", "url", "CASE WHEN page_id % 7 = 0 THEN 403 ELSE 200 END AS status_code", "'application/pdf' AS content_type",
        "cast(1000 + page_id AS bigint) AS body_size", "cast(NULL AS string) AS error_type", "cast(NULL AS string) AS error_message",
    )


def _outcome(spark: SparkSession, sf_dir: str):
    pages, edges, jobs, visits = crawled(spark, sf_dir)
    return pages, edges, jobs, visits, I.asset_candidates(pages, visits, jobs), asset_responses(spark, sf_dir)


@query("manifest_assets", sql("""
SELECT job_id, site || '/f/' || i || '.PDF' AS url, 'assets/f/' || i || '.pdf' AS local_path, 'application/pdf' AS content_type,
  site || '/p/' || i AS discovered_from, 1000 + k AS file_size, true AS success FROM v WHERE is_page AND k % 5 <> 0 AND k % 7 <> 0
UNION ALL SELECT job_id, site || '/logo.pdf', 'assets/logo.pdf', 'application/pdf', site || '/p/0', 1002, true FROM v WHERE i = 0"""))
def manifest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: every page links the logo; it is stored once."""
    *_, candidates, answers = _outcome(spark, sf_dir)
    return I.manifest_assets(candidates, answers)


_ERRORS = """
, x AS (
  SELECT job_id, site || '/p/' || i AS url, 'page_response' AS stage, 'HttpStatusError' AS error_type, 'HTTP status 404' AS message FROM v WHERE is_page AND bad
  UNION ALL SELECT job_id, site || '/p/' || i, 'page_crawl', 'TimeoutException', 'timed out' FROM v WHERE failed
  UNION ALL SELECT job_id, site || '/f/' || i || '.PDF', 'asset_download', CASE WHEN k % 5 = 0 THEN 'NotFetched' ELSE 'HTTPStatusError' END,
    CASE WHEN k % 5 = 0 THEN 'no stored response' ELSE 'HTTP status 403' END FROM v WHERE is_page AND (k % 5 = 0 OR k % 7 = 0))"""


@query("manifest_errors", sql(_ERRORS + "\nSELECT * FROM x"))
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5."""
    pages, _, _, visits, candidates, answers = _outcome(spark, sf_dir)
    return I.manifest_errors(pages, visits, candidates, answers)


@query("run_summary", sql(_COUNTS + _ERRORS + """
, a AS (SELECT job_id, sum((is_page AND k % 5 <> 0 AND k % 7 <> 0)::INT) + 1 AS assets FROM v GROUP BY 1)
, y AS (SELECT job_id, count(*) AS errors FROM x GROUP BY 1)
SELECT c.job_id, pages::BIGINT AS pages, assets::BIGINT AS assets, coalesce(errors, 0)::BIGINT AS errors, queue_remaining::BIGINT AS queue_remaining,
  (skipped_visited + skipped_depth + skipped_domain + skipped_pattern)::BIGINT AS skipped_total,
  CASE WHEN pages >= max_pages THEN 'max_pages_reached' WHEN queue_remaining = 0 THEN 'queue_exhausted' ELSE 'stopped_early' END AS stop_reason
FROM c JOIN a ON c.job_id = a.job_id LEFT JOIN y ON c.job_id = y.job_id"""))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7."""
    pages, edges, jobs, visits, candidates, answers = _outcome(spark, sf_dir)
    counts = G.skip_counts(visits, G.queue_entries(visits, edges, jobs))
    summary = I.run_summary(
        counts, I.manifest_assets(candidates, answers), I.manifest_errors(pages, visits, candidates, answers), jobs
    )
    return summary.drop("skipped_visited", "skipped_depth", "skipped_domain", "skipped_pattern")


# --- sitemaps -------------------------------------------------------------------


def page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per page, the page being its start."""
    return prepare_jobs(
        corpus.pages(spark, sf_dir).selectExpr(
            "concat('p', page_id) AS job_id", "url AS start_url", "cast(array() AS array<string>) AS allowed_domains",
            "cast(array() AS array<string>) AS include_patterns", "cast(array() AS array<string>) AS exclude_patterns",
            "array('.pdf') AS attachment_extensions", "10 AS max_pages", "2 AS max_depth", "'main' AS content_extraction",
            "true AS save_html", "true AS save_markdown", "true AS download_attachments",
        ).to(T.StructType.fromDDL(JOB_SCHEMA))
    )


@query(
    "robots_sitemaps",
    with_pages(
        """SELECT 'p' || k AS job_id, site || '/sitemap.xml' AS sitemap_url FROM n
UNION ALL SELECT 'p' || k, site || '/sm/' || k || '.xml' FROM n WHERE k % 5 <> 0
UNION ALL SELECT 'p' || k, 'https://cdn.example/S.xml?k=' || k FROM n WHERE k % 5 <> 0"""
    ),
)
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1."""
    robots = corpus.pages(spark, sf_dir).selectExpr(
        "concat('p', page_id) AS job_id", "concat(substring_index(url, '/', 3), '/robots.txt') AS url",
        "CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status_code",
        "concat('User-agent: *\\r\\nSitemap: /sm/', page_id, '.xml \\n sitemap: /indented.xml\\nSITEMAP:HTTPS://CDN.example/S.xml?k=', page_id) AS body",
    )
    return S.robots_sitemaps(robots, page_jobs(spark, sf_dir))


@query(
    "sitemap_locs",
    with_pages(
        """SELECT page_id, CASE WHEN k % 7 = 0 THEN '' ELSE 'https://h.example/a?x=1&y=' || k || '|/b/' || k || '|i.png|T' END AS locs FROM p"""
    ),
)
def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    body = F.expr(
        "concat('<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\" xmlns:image=\"urn:i\"><url><loc> https://h.example/a?x=1&amp;y=', page_id,"
        " ' </loc></url><url><loc>/b/', page_id, '</loc><image:loc>i.png</image:loc><thumbLoc>T</thumbLoc><loc> </loc><lock>no</lock></url>',"
        " CASE WHEN page_id % 7 = 0 THEN '' ELSE '</urlset>' END)"
    )
    return corpus.pages(spark, sf_dir).select("page_id", F.array_join(listed_locs(body), "|").alias("locs"))


def site_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of sitemaps per site, one per page, with loops back to the top."""
    rows = site_pages(spark, sf_dir).selectExpr("job_id", "page_id", "page_id div 4 AS i", "substring_index(url, '/', 3) AS site")
    maps = rows.selectExpr(
        "job_id",
        "page_id",
        "CASE WHEN i = 0 THEN concat(site, '/sitemap.xml') ELSE concat(site, '/sm/', i, '.xml') END AS url",
        "CASE WHEN page_id % 23 = 22 THEN 500 ELSE 200 END AS status_code",
        "concat('<x><loc>/sm/', 2 * i + 1, '.xml</loc><loc>', site, '/sm/', 2 * i + 2, '.xml</loc><loc>/sitemap.xml</loc><loc>', site, '/p/', i,"
        " '?utm_source=s</loc><loc>/f/', i, '.pdf</loc><loc>/blocked/', i, '</loc><loc>https://out.example/</loc><loc>/common</loc></x>') AS body",
    )
    return maps


@query("expand_sitemaps", with_pages(""", up AS (
  SELECT k, k AS a FROM p UNION ALL SELECT up.k, ((up.a // 4 - 1) // 2) * 4 + up.a % 4 FROM up WHERE up.a // 4 > 0),
ok AS (SELECT k FROM up GROUP BY 1 HAVING NOT bool_or(a % 23 = 22))
SELECT 'site' || k % 4 AS job_id, 'https://site' || k % 4 || '.example/p/' || k // 4 AS url, 'page' AS kind FROM ok
UNION ALL SELECT 'site' || k % 4, 'https://site' || k % 4 || '.example/f/' || k // 4 || '.pdf', 'asset' FROM ok
UNION ALL SELECT DISTINCT 'site' || k % 4, 'https://site' || k % 4 || '.example/common', 'page' FROM ok""").replace(")\n\n,", "),").replace("WITH ", "WITH RECURSIVE "))
def expand_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: what lies below a sitemap that cannot be read is not found."""
    jobs = site_jobs(spark, sf_dir).withColumn("listed_extensions", F.array(F.lit(".pdf")))
    seeds = jobs.select("job_id", F.expr("concat('https://', job_id, '.example/sitemap.xml') AS sitemap_url"))
    return S.expand_sitemaps(seeds, site_maps(spark, sf_dir), jobs)


_TREE_OF_MAPS = """, up AS (
  SELECT k, k AS a FROM p UNION ALL SELECT up.k, ((up.a // 4 - 1) // 2) * 4 + up.a % 4 FROM up WHERE up.a // 4 > 0),
ok AS (SELECT k FROM up GROUP BY 1 HAVING NOT bool_or(a % 23 = 22))"""


def _as_files(files: DataFrame) -> DataFrame:
    """A file per page, its rows as lines, dealt over one folder for each task that writes; the sink packs what is named so.

    A folder per page is listed by a task of its own, and Spark merges the tasks
    of a small shuffle into one that writes all files, unless their number is given.
    """
    spark = files.sparkSession
    folders = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = files.filter("packed IS NOT NULL").groupBy("page_id", "packed").agg(F.concat(F.array_join(F.collect_list("value"), "\n"), F.lit("\n")).alias("text"))
    dealt = lines.withColumn("job_id", F.pmod(F.xxhash64("page_id"), F.lit(folders)).cast("string")).repartition(folders, "job_id")
    name = F.concat(F.lit("page_id="), "page_id", F.when(F.col("packed"), ".xml.gz").otherwise(".xml"))
    return dealt.select("job_id", name.alias("rel_path"), "text")


@query("sitemap_files", with_pages(_TREE_OF_MAPS + """
SELECT 'site' || k % 4 AS job_id, 'https://site' || k % 4 || '.example/p/' || k // 4 AS url, 'page' AS kind FROM ok
UNION ALL SELECT 'site' || k % 4, 'https://site' || k % 4 || '.example/f/' || k // 4 || '.pdf', 'asset' FROM ok
UNION ALL SELECT DISTINCT 'site' || k % 4, 'https://site' || k % 4 || '.example/common', 'page' FROM ok
UNION ALL SELECT 'site' || k % 4, 'https://site' || k % 4 || '.example' || CASE WHEN k < 4 THEN '/sitemap.xml' ELSE '/sm/' || k // 4 || '.xml' || CASE WHEN k % 2 = 0 THEN '.gz' ELSE '' END END,
  'ParseError' FROM p WHERE k % 23 = 22""").replace(")\n\n,", "),").replace("WITH ", "WITH RECURSIVE "))
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4 from stored files, half of the sites' packed, some cut off: those are listed as errors."""
    maps = site_maps(spark, sf_dir).drop("status_code")
    packed = (F.col("page_id") % 2 == 0) & (F.col("page_id") >= 4)
    body = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("body", r"(/sm/\d+\.xml)", "$1.gz")).otherwise(F.col("body"))
    broken = F.when(F.col("page_id") % 23 == 22, F.expr("left(body, length(body) - 4)")).otherwise(F.col("body"))
    files = maps.withColumn("body", body).withColumn("body", broken).select("page_id", F.col("body").alias("value"), packed.alias("packed"))
    folder = _folder(spark)
    write_files(_as_files(files), folder)
    stored = read_sitemaps(spark, folder).withColumn("page_id", F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint"))
    names = maps.select("page_id", "job_id", F.when(packed, F.concat("url", F.lit(".gz"))).otherwise(F.col("url")).alias("url"))
    responses = stored.join(names, "page_id").select("job_id", "url", F.lit(200).alias("status_code"), "content")
    jobs = site_jobs(spark, sf_dir).withColumn("listed_extensions", F.array(F.lit(".pdf")))
    seeds = jobs.select("job_id", F.expr("concat('https://', job_id, '.example/sitemap.xml') AS sitemap_url"))
    read = durable(S.listed(responses))
    errors = S.sitemap_errors(read).select("job_id", "url", F.col("error_type").alias("kind"))
    return S.expand_sitemaps(seeds, responses, jobs, read).unionByName(errors)


@query(
    "robots_after_redirect",
    with_pages(
        """SELECT 'p' || k AS job_id, 'https://moved' || k % 3 || '.example/sitemap.xml' AS sitemap_url FROM n
UNION ALL SELECT 'p' || k, 'https://moved' || k % 3 || '.example/sm/' || k || '.xml' FROM n WHERE k % 5 <> 0"""
    ),
)
def robots_after_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: robots.txt and the default sitemap belong to the address a start page ended at."""
    pages = corpus.pages(spark, sf_dir)
    moved = "concat('https://moved', page_id % 3, '.example')"
    robots = pages.selectExpr(
        "concat('p', page_id) AS job_id", f"inline(array(struct(concat({moved}, '/robots.txt') AS url, 'Sitemap: /sm/' AS start), struct(concat(substring_index(url, '/', 3), '/robots.txt') AS url, 'Sitemap: /wrong/' AS start)))",
        "CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status_code", "page_id",
    ).withColumn("body", F.concat("start", "page_id", F.lit(".xml")))
    fetched = pages.select(F.expr("concat('p', page_id) AS job_id"), normalize_url("url").alias("url"), F.expr(f"concat({moved}, '/home') AS normalized_url"))
    return S.robots_sitemaps(robots, page_jobs(spark, sf_dir), fetched)


@query(
    "sitemap_fallback",
    with_pages(
        """SELECT 'p' || k AS job_id, normalized_url AS src, site || '/s/' || k AS url, 'page' AS kind FROM n WHERE k % 3 = 0 AND k % 17 <> 0
UNION ALL SELECT 'p' || k, normalized_url, site || '/s.pdf', 'asset' FROM n WHERE k % 3 = 0 AND k % 17 <> 0"""
    ),
)
def sitemap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: only start pages without any link fall back."""
    pages = corpus.pages(spark, sf_dir).select(
        F.expr("concat('p', page_id) AS job_id"), F.col("url").alias("requested_url"), normalize_url("url").alias("normalized_url"),
        F.lit(True).alias("is_html"), F.expr("page_id % 17 = 0 AS is_error"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN cast(array() AS array<string>) ELSE array(url) END AS internal_links"),
    )
    expanded = corpus.pages(spark, sf_dir).selectExpr(
        "concat('p', page_id) AS job_id",
        "inline(array(struct(concat(substring_index(url, '/', 3), '/s/', page_id) AS url, 'page' AS kind), struct(concat(substring_index(url, '/', 3), '/s.pdf') AS url, 'asset' AS kind)))",
    )
    return S.sitemap_fallback(pages, expanded, page_jobs(spark, sf_dir)).drop("from_url")


@query("fallback_crawl", sql("""
, up AS (SELECT k, k AS a FROM p UNION ALL SELECT up.k, ((up.a // 4 - 1) // 2) * 4 + up.a % 4 FROM up WHERE up.a // 4 > 0)
, ok AS (SELECT k FROM up GROUP BY 1 HAVING NOT bool_or(a % 23 = 22))
, found AS (SELECT f.job_id, site, site || '/p/' || i AS url, NOT failed AS is_page FROM f JOIN ok ON f.k = ok.k WHERE i > 0
  UNION ALL SELECT DISTINCT f.job_id, site, site || '/common', false FROM f JOIN ok ON f.k = ok.k)
, visits AS (SELECT job_id, url, 1 AS depth, site || '/p/0' AS discovered_from, 1 + row_number() OVER (PARTITION BY job_id ORDER BY url) AS visit_order, is_page FROM found
  UNION ALL SELECT job_id, site || '/p/0', 0, NULL, 1, true FROM f WHERE i = 0)
SELECT job_id, 'visit' AS kind, url, depth::BIGINT AS depth, visit_order::BIGINT AS visit_order, discovered_from, is_page FROM visits
UNION ALL SELECT f.job_id, 'asset', site || '/f/' || i || '.pdf', -1, -1, site || '/p/0', f.k % 7 <> 0 FROM f JOIN ok ON f.k = ok.k""").replace("WITH ", "WITH RECURSIVE ", 1))
def fallback_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 in the crawl: start pages without links, everything else from their sitemaps, assets included."""
    raw = raw_site_jobs(spark, sf_dir).withColumn("max_pages", F.lit(MANY_PAGES))
    jobs = prepare_jobs(raw).withColumn("listed_extensions", F.array(F.lit(".pdf")))
    links = F.when(F.expr("page_id div 4 = 0"), F.array().cast("array<string>")).otherwise(F.array("normalized_url"))
    pages = site_pages(spark, sf_dir).withColumns({"internal_links": links, "asset_links": F.array().cast("array<string>")})
    seeds = jobs.select("job_id", F.expr("concat('https://', job_id, '.example/sitemap.xml') AS sitemap_url"))
    fallback = durable(S.sitemap_fallback(pages, S.expand_sitemaps(seeds, site_maps(spark, sf_dir), jobs), jobs))
    edges = G.link_edges(pages).unionByName(S.fallback_edges(fallback))
    visits = G.crawl_frontier(edges, jobs, G.fetched_pages(pages))
    candidates = I.asset_candidates(pages, visits, jobs, fallback)
    answers = asset_responses(spark, sf_dir).withColumn("url", F.regexp_replace("url", "PDF$", "pdf")).filter("status_code = 200")
    every = corpus.pages(spark, sf_dir).selectExpr("page_id", "concat('site', page_id % 4) AS job_id", f"concat({_SITE}, '/f/', page_id div 4, '.pdf') AS url")
    answers = answers.unionByName(every.join(answers.select("job_id", "url"), ["job_id", "url"], "left_anti").filter("page_id % 7 != 0").selectExpr(
        "job_id", "url", "200 AS status_code", "'application/pdf' AS content_type", "1L AS body_size", "cast(NULL AS string) AS error_type", "cast(NULL AS string) AS error_message"
    ))
    stored = I.manifest_assets(candidates, answers).select("job_id", "url", "discovered_from", "success")
    failed = I.manifest_errors(pages, visits, candidates, answers).filter("stage = 'asset_download'").join(candidates, ["job_id", "url"]).select("job_id", "url", "discovered_from", F.lit(False).alias("success"))
    nothing = F.lit(-1).cast("bigint")
    assets = stored.unionByName(failed).select("job_id", F.lit("asset").alias("kind"), "url", nothing.alias("depth"), nothing.alias("visit_order"), "discovered_from", F.col("success").alias("is_page"))
    return visits.select("job_id", F.lit("visit").alias("kind"), "url", F.col("depth").cast("bigint"), "visit_order", "discovered_from", "is_page").unionByName(assets)
