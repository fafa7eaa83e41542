"""Link candidates, decisions and counts over every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import links as L
from workload import corpus
from workload.corpus import ASSET_LINKS, BODY_LINKS, PAYLOAD_LINKS, with_pages
from workload.registry import query


def _text(template: str | None) -> str:
    if template is None:
        return "NULL"
    quoted = "'" + template.replace("{k}", "' || page_id || '").replace("{s}", "' || site || '") + "'"
    return quoted.replace("'' || ", "").replace(" || ''", "")


def _added(rows, source: str, offset: int) -> str:
    return "\nUNION ALL ".join(
        f"SELECT page_id, host, site, '{source}' AS source, {offset + i} AS pos, {_text(raw)} AS raw_url, "
        f"{_text(normal)} AS normalized_url, '{decision}' AS decision, '{reason}' AS reason FROM n"
        + (" WHERE k % 3 = 0" if source == "result.links" else "")
        for i, (raw, normal, decision, reason) in enumerate(rows)
    )


# Candidates of the rich pages with their expected decision. The links of the given
# navigation bars come last among the anchors; they get rules of their own below.
_COUNT = len(BODY_LINKS)
CANDIDATES = f"""
added AS (
{_added(PAYLOAD_LINKS, "result.links", 0)}
UNION ALL {_added(BODY_LINKS, "html-fallback", 0)}
UNION ALL SELECT page_id, host, site, 'html-fallback', {_COUNT}, '/data/' || page_id, site || '/data/' || page_id, 'keep', 'kept' FROM n
UNION ALL SELECT page_id, host, site, 'html-fallback', {_COUNT + 1}, '#', NULL, 'drop', 'anchor-only' FROM n
UNION ALL {_added(ASSET_LINKS, "html-assets", 0)}
UNION ALL SELECT page_id, host, site, 'html-assets', 2, '/alt/' || page_id, site || '/alt/' || page_id, 'keep', 'kept' FROM n WHERE false
),
nav AS (
  SELECT page_id, host, site, 'html-fallback' AS source, i - 1 + {_COUNT + 2} AS pos, hrefs[i] AS raw_url,
    CASE WHEN lower(hrefs[i]) IN ('/index', '/index.html') THEN site || '/' ELSE site || hrefs[i] END AS normalized_url,
    row_number() OVER (PARTITION BY page_id, hrefs[i] ORDER BY i) AS use_no
  FROM n, (SELECT unnest(range(1, 200)) AS i) r WHERE i <= len(hrefs)
)"""
# In page order the head's link targets precede the body's media.
_HEAD_ASSETS = """
head AS (
  SELECT page_id, host, site, '/canon/' || page_id || '?a=1' AS raw_url, 0 AS ord FROM n WHERE k % 3 = 0
  UNION ALL SELECT page_id, host, site, '/alt/' || page_id, 1 FROM n
  UNION ALL SELECT page_id, host, site, url, 2 FROM n
)"""
DECISIONS = f"""{CANDIDATES},
anchors AS (
  SELECT page_id, host, source, pos, raw_url, normalized_url, decision, reason FROM added WHERE source <> 'html-assets'
  UNION ALL
  SELECT page_id, host, source, pos, raw_url, normalized_url,
    CASE WHEN regexp_matches(lower(raw_url), '(favicon|apple-touch-icon|android-chrome|logo|sprite)') THEN 'asset'
      WHEN use_no = 1 THEN 'keep' ELSE 'drop' END,
    CASE WHEN regexp_matches(lower(raw_url), '(favicon|apple-touch-icon|android-chrome|logo|sprite)') THEN 'asset-like-url'
      WHEN use_no = 1 THEN 'kept' ELSE 'duplicate-after-normalization' END
  FROM nav
)"""
# A payload link takes the place of the same link in the page.
ANCHOR_ROWS = """
SELECT page_id, host AS job_id, source, pos::BIGINT AS pos, raw_url, normalized_url,
  CASE WHEN page_id % 3 = 0 AND raw_url = '/slash//two' THEN 'drop' ELSE decision END AS decision,
  CASE WHEN page_id % 3 = 0 AND raw_url = '/slash//two' THEN 'duplicate-after-normalization' ELSE reason END AS reason
FROM anchors"""


def sql(body: str) -> str:
    return with_pages("," + body).replace(")\n\n,", "),")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_decisions(corpus.rich_parsed(spark, sf_dir), corpus.prepared_jobs(spark, sf_dir))


@query("html_hrefs", sql(CANDIDATES + f"""
SELECT page_id, pos::BIGINT AS pos, raw_url FROM added WHERE source = 'html-fallback'
UNION ALL SELECT page_id, pos, raw_url FROM nav"""))
def html_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1."""
    return L.html_hrefs(corpus.rich_parsed(spark, sf_dir)).select("page_id", F.col("pos").cast("bigint"), "raw_url")


@query("html_assets", sql(_HEAD_ASSETS + """
, body AS (SELECT page_id, '/i/' || page_id || '.webp' AS raw_url, 3 AS ord FROM n
  UNION ALL SELECT page_id, '/v/' || page_id || '.mp4', 4 FROM n)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1)::BIGINT AS pos, trim(raw_url) AS raw_url
FROM (SELECT page_id, raw_url, ord FROM head UNION ALL SELECT * FROM body)"""))
def html_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2."""
    return L.html_assets(corpus.rich_parsed(spark, sf_dir)).select(
        "page_id", F.col("pos").cast("bigint"), F.trim("raw_url").alias("raw_url")
    )


@query("payload_links", sql(CANDIDATES + "\nSELECT page_id, pos::BIGINT AS pos, raw_url FROM added WHERE source = 'result.links'"))
def payload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3."""
    return L.payload_links(corpus.responses(spark, sf_dir)).select("page_id", F.col("pos").cast("bigint"), "raw_url")


@query("extract_links", sql(CANDIDATES + """
, l AS (SELECT page_id, normalized_url FROM added WHERE source = 'html-fallback' UNION ALL SELECT page_id, normalized_url FROM nav)
SELECT page_id, string_agg(DISTINCT normalized_url, ' ' ORDER BY normalized_url) AS links,
  count(DISTINCT normalized_url)::BIGINT AS n_links FROM l WHERE normalized_url IS NOT NULL GROUP BY 1"""))
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4."""
    found = L.extract_links(corpus.rich_parsed(spark, sf_dir))
    return found.select("page_id", F.array_join("links", " ").alias("links"), F.size("links").cast("bigint").alias("n_links"))


@query("link_decisions", sql(DECISIONS + ANCHOR_ROWS))
def link_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5, L6 for payload links and anchors."""
    rows = L.link_decisions(decided(spark, sf_dir)).filter("source != 'html-assets'")
    return rows.select(
        "page_id", "job_id", "source", F.col("pos").cast("bigint"), "raw_url", "normalized_url", "decision", "reason"
    )


@query("media_decisions", sql(_HEAD_ASSETS + """
, own AS (SELECT page_id, scheme || '://' || host || path || CASE WHEN query = '' OR query LIKE 'utm%' THEN '' ELSE '?' || query END AS own_url FROM n)
, body AS (SELECT page_id, site || '/i/' || page_id || '.webp' AS normalized_url, 'asset' AS decision, 'asset-like-url' AS reason FROM n
  UNION ALL SELECT page_id, site || '/v/' || page_id || '.mp4', 'keep', 'kept' FROM n)
SELECT page_id, normalized_url, decision, reason FROM body
UNION ALL SELECT page_id, site || raw_url, 'keep', 'kept' FROM head WHERE ord < 2
UNION ALL SELECT page_id, own_url, 'keep', 'kept' FROM own"""))
def media_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 for media sources and link targets."""
    rows = L.link_decisions(decided(spark, sf_dir)).filter("source = 'html-assets'")
    return rows.select("page_id", "normalized_url", "decision", "reason")


@query("repeated_links", sql(DECISIONS + """
SELECT page_id, sum((reason = 'duplicate-after-normalization')::INT)::BIGINT AS n_repeats, sum((decision = 'keep')::INT)::BIGINT AS n_kept
FROM (""" + ANCHOR_ROWS + ") GROUP BY 1"))
def repeated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6."""
    rows = L.link_decisions(decided(spark, sf_dir)).filter("source != 'html-assets'")
    return rows.groupBy("page_id").agg(
        F.sum((F.col("reason") == "duplicate-after-normalization").cast("bigint")).alias("n_repeats"),
        F.sum((F.col("decision") == "keep").cast("bigint")).alias("n_kept"),
    )


_OWN = "scheme || '://' || host || path || CASE WHEN query = '' OR query LIKE 'utm%' THEN '' ELSE '?' || query END"
ALL_LINKS = DECISIONS + f""",
every AS ({ANCHOR_ROWS}
UNION ALL SELECT page_id, host, 'html-assets', 0, '', site || '/i/' || page_id || '.webp', 'asset', '' FROM n
UNION ALL SELECT page_id, host, 'html-assets', 0, '', site || '/v/' || page_id || '.mp4', 'keep', '' FROM n
UNION ALL SELECT page_id, host, 'html-assets', 0, '', site || '/alt/' || page_id, 'keep', '' FROM n
UNION ALL SELECT page_id, host, 'html-assets', 0, '', site || '/canon/' || page_id || '?a=1', 'keep', '' FROM n WHERE k % 3 = 0
UNION ALL SELECT page_id, host, 'html-assets', 0, '', {_OWN}, 'keep', '' FROM n
)"""


@query("page_links", sql(ALL_LINKS + """
SELECT page_id, string_agg(DISTINCT normalized_url, ' ' ORDER BY normalized_url) FILTER (WHERE decision = 'keep') AS internal_links,
  string_agg(DISTINCT normalized_url, ' ' ORDER BY normalized_url) FILTER (WHERE decision = 'asset') AS asset_links FROM every GROUP BY 1"""))
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7."""
    return L.page_links(decided(spark, sf_dir)).select(
        "page_id", F.array_join("internal_links", " ").alias("internal_links"), F.array_join("asset_links", " ").alias("asset_links")
    )


@query("discovery_stats", sql(ALL_LINKS + """
SELECT page_id, sum((source = 'result.links')::INT)::BIGINT AS links_from_result, sum((source = 'html-fallback')::INT)::BIGINT AS links_from_html_fallback,
  count(DISTINCT normalized_url) FILTER (WHERE decision = 'keep')::BIGINT AS filtered_links_count,
  count(DISTINCT normalized_url) FILTER (WHERE decision = 'asset')::BIGINT AS filtered_assets_count FROM every GROUP BY 1"""))
def discovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8."""
    stats = L.discovery_stats(decided(spark, sf_dir)).drop("job_id")
    return stats.select("page_id", *[F.col(c).cast("bigint") for c in stats.columns if c != "page_id"])


@query("split_links", sql(CANDIDATES + """
, l AS (SELECT page_id, host, site, normalized_url AS u FROM added WHERE source = 'html-fallback' AND normalized_url IS NOT NULL
  UNION ALL SELECT page_id, host, site, normalized_url FROM nav)
SELECT page_id,
  count(DISTINCT u) FILTER (WHERE NOT asset AND host LIKE 'www.%' AND u LIKE site || '/%' AND u NOT LIKE '%/blocked/%')::BIGINT AS n_internal,
  count(DISTINCT u) FILTER (WHERE asset)::BIGINT AS n_assets
FROM (SELECT *, lower(u) LIKE '%.pdf' OR regexp_matches(lower(u), '(favicon|apple-touch-icon|android-chrome|logo|sprite)[^/?]*$') AS asset FROM l) GROUP BY 1"""))
def split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed domains have ``www.`` here, which this split takes literally."""
    links = L.extract_links(corpus.rich_parsed(spark, sf_dir)).select("job_id", "page_id", "links")
    domains = F.array(F.concat(F.lit("www."), F.regexp_replace("job_id", r"^www\.", "")))
    jobs = corpus.prepared_jobs(spark, sf_dir).withColumn("domains", domains)
    return L.split_links(links, jobs).select(
        "page_id", F.size("internal_links").cast("bigint").alias("n_internal"), F.size("asset_links").cast("bigint").alias("n_assets")
    )


@query("drop_reasons", sql(DECISIONS + "\nSELECT reason, source, count(*)::BIGINT AS n_links FROM (" + ANCHOR_ROWS + ") WHERE decision = 'drop' GROUP BY 1, 2"))
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10."""
    return L.drop_reasons(L.link_decisions(decided(spark, sf_dir)))


@query("link_report", sql(ALL_LINKS + """
SELECT page_id, string_agg(raw_url, ' ' ORDER BY pos) FILTER (WHERE source = 'html-fallback') AS raw_html_links,
  count(DISTINCT normalized_url)::BIGINT AS n_normalized,
  string_agg(raw_url || '>' || reason, ' ' ORDER BY source DESC, pos) FILTER (WHERE decision = 'drop') AS dropped
FROM every GROUP BY 1"""))
def link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7."""
    report = L.link_report(decided(spark, sf_dir))
    dropped = F.transform("dropped_links_with_reason", lambda d: F.concat(d["raw_url"], F.lit(">"), d["reason"]))
    return report.select(
        "page_id",
        F.array_join("raw_html_links", " ").alias("raw_html_links"),
        F.size("normalized_links").cast("bigint").alias("n_normalized"),
        F.array_join(dropped, " ").alias("dropped"),
    )


@query("split_link_lists", sql(CANDIDATES + """
, l AS (SELECT page_id, host, site, normalized_url AS u FROM added WHERE source = 'html-fallback' AND normalized_url IS NOT NULL
  UNION ALL SELECT page_id, host, site, normalized_url FROM nav)
SELECT page_id,
  coalesce(string_agg(DISTINCT u, ' ' ORDER BY u) FILTER (WHERE NOT asset AND host LIKE 'www.%' AND u LIKE site || '/%' AND u NOT LIKE '%/blocked/%'), '') AS internal_links,
  coalesce(string_agg(DISTINCT u, ' ' ORDER BY u) FILTER (WHERE asset), '') AS asset_links
FROM (SELECT *, lower(u) LIKE '%.pdf' OR regexp_matches(lower(u), '(favicon|apple-touch-icon|android-chrome|logo|sprite)[^/?]*$') AS asset FROM l) GROUP BY 1"""))
def split_link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9, the addresses themselves."""
    links = L.extract_links(corpus.rich_parsed(spark, sf_dir)).select("job_id", "page_id", "links")
    domains = F.array(F.concat(F.lit("www."), F.regexp_replace("job_id", r"^www\.", "")))
    split = L.split_links(links, corpus.prepared_jobs(spark, sf_dir).withColumn("domains", domains))
    return split.select("page_id", F.array_join("internal_links", " ").alias("internal_links"), F.array_join("asset_links", " ").alias("asset_links"))


@query("link_report_lists", sql(ALL_LINKS + """
SELECT page_id, coalesce(string_agg(raw_url, ' ' ORDER BY pos) FILTER (WHERE source = 'result.links'), '') AS raw_result_links,
  string_agg(DISTINCT normalized_url, ' ' ORDER BY normalized_url) AS normalized_links,
  string_agg(DISTINCT normalized_url, ' ' ORDER BY normalized_url) FILTER (WHERE decision = 'keep') AS kept_links,
  string_agg(DISTINCT normalized_url, ' ' ORDER BY normalized_url) FILTER (WHERE decision = 'asset') AS kept_assets,
  string_agg(source || ' ' || raw_url || ' ' || coalesce(normalized_url, '-') || ' ' || reason, '|' ORDER BY source DESC, pos) FILTER (WHERE decision = 'drop') AS dropped
FROM every GROUP BY 1"""))
def link_report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, every list of the report."""
    report = L.link_report(decided(spark, sf_dir))
    dropped = F.transform("dropped_links_with_reason", lambda d: F.concat_ws(" ", d["source"], d["raw_url"], F.coalesce(d["normalized_url"], F.lit("-")), d["reason"]))
    lists = [F.array_join(name, " ").alias(name) for name in ("raw_result_links", "normalized_links", "kept_links", "kept_assets")]
    return report.select("page_id", *lists, F.array_join(dropped, "|").alias("dropped"))
