"""Page metadata over every page, with markup whose meaning follows from page_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.content_types import content_type_norm
from pagemill.functions.dates import normalize_rfc2822
from pagemill.operators import jsonld
from pagemill.operators import metadata as M
from workload import corpus
from workload.corpus import with_pages
from workload.registry import ORACLES, query


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_evidence(corpus.rich_parsed(spark, sf_dir))


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


_META_ROWS = """
m AS (
  SELECT page_id, 0 AS ord, 'property' AS attr, 'og:title' AS key, 'OG ' || k AS content FROM n WHERE k % 4 = 0
  UNION ALL SELECT page_id, 1, 'name', 'Author', 'Author ' || k % 7 FROM n
  UNION ALL SELECT page_id, 2, 'property', 'article:author', 'Author 1' FROM n
  UNION ALL SELECT page_id, 3, 'name', 'keywords', 'k' || k % 5 || '; shared,, k' || k % 3 || 'x' FROM n
  UNION ALL SELECT page_id, 4, 'property', 'article:tag', 'a,b' FROM n
  UNION ALL SELECT page_id, 5, 'name', CASE k % 5 WHEN 1 THEN 'googlebot' ELSE 'robots' END,
    CASE k % 5 WHEN 0 THEN 'Index, follow' WHEN 1 THEN 'noindex' ELSE 'private' END FROM n WHERE k % 5 < 3
  UNION ALL SELECT page_id, 6, 'name', 'Page-ID', 'P' || k FROM n WHERE k % 2 = 0
  UNION ALL SELECT page_id, 7, 'property', 'article:published_time', '2026-02-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || 'T10:00:00+01:00' FROM n
  UNION ALL SELECT page_id, 8, 'name', 'created_at', CASE WHEN k % 3 = 1 THEN 'soon' ELSE '20260105' END FROM n
  UNION ALL SELECT page_id, 9, 'name', 'date.created', '2026-01-06' FROM n
  UNION ALL SELECT page_id, 10, 'property', 'article:section', 'Section ' || k % 4 FROM n
  UNION ALL SELECT page_id, 11, 'name', 'category', 'Cat' FROM n
  UNION ALL SELECT page_id, 12, 'name', 'version', '3.' || k % 10 FROM n WHERE k % 6 = 0
  UNION ALL SELECT page_id, 13, 'property', 'og:site_name', 'Site ' || k % 3 FROM n WHERE k % 5 = 0
)"""


def sql(body: str) -> str:
    return with_pages("," + body).replace(")\n\n,", "),")


@query("meta_pairs", sql(_META_ROWS + "\nSELECT page_id, attr, key, content FROM m"))
def meta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1."""
    pairs = M.meta_pairs(evidence(spark, sf_dir))
    return pairs.select("page_id", "attr", "key", F.trim("content").alias("content"))


@query(
    "jsonld_nodes",
    with_pages(
        """SELECT page_id, 0::BIGINT AS pos, ['NewsArticle', 'FAQPage', 'WebPage', 'TechArticle'][(1 + (k // 2) % 4)::INT] AS type,
  'LD ' || k AS name FROM n WHERE k % 2 = 1
UNION ALL SELECT page_id, 1, '["BreadcrumbList"]', NULL FROM n WHERE k % 2 = 1"""
    ),
)
def jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs and lists opened, broken scripts skipped."""
    nodes = jsonld.jsonld_nodes(corpus.rich_parsed(spark, sf_dir))
    return nodes.select(
        "page_id",
        F.col("pos").cast("bigint"),
        F.try_variant_get("object", "$['@type']", "string").alias("type"),
        F.try_variant_get("object", "$.name", "string").alias("name"),
    )


@query(
    "jsonld_values",
    with_pages(
        """SELECT page_id, 0::BIGINT AS pos, '{"@type":"Person","name":"Writer ' || k % 9 || '"}' AS value FROM n WHERE k % 2 = 1
UNION ALL SELECT page_id, 1, '"Guest"' FROM n WHERE k % 2 = 1
UNION ALL SELECT page_id, 2, '7' FROM n WHERE k % 2 = 1"""
    ),
)
def jsonld_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3."""
    values = jsonld.jsonld_values(corpus.rich_parsed(spark, sf_dir), "author")
    return values.select("page_id", F.col("pos").cast("bigint"), F.to_json("value").alias("value"))


@query(
    "page_titles",
    with_pages(
        """SELECT page_id, CASE WHEN k % 4 = 0 THEN 'OG ' || k WHEN k % 2 = 1 THEN 'LD ' || k
  ELSE coalesce(nullif(trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')), ''), raw_title) END AS title FROM n"""
    ),
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    return evidence(spark, sf_dir).select("page_id", M.page_title().alias("title"))


@query(
    "canonical_urls",
    with_pages(
        """SELECT page_id, CASE WHEN k % 3 = 0 THEN site || '/canon/' || k || '?a=1' WHEN k % 2 = 1 THEN 'urn:p:' || k END AS canonical_url FROM n"""
    ),
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5."""
    return evidence(spark, sf_dir).select("page_id", M.canonical_url().alias("canonical_url"))


@query(
    "page_ids",
    with_pages(
        """SELECT page_id, CASE WHEN k % 2 = 0 THEN 'P' || k || '|b' || k ELSE 'urn:p:' || k || '|b' || k END AS ids FROM n"""
    ),
)
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    return evidence(spark, sf_dir).select("page_id", joined(M.page_id_candidates()).alias("ids"))


@query(
    "people",
    with_pages(
        """SELECT page_id, 'Author ' || k % 7 || CASE WHEN k % 7 = 1 THEN '' ELSE '|Author 1' END
    || CASE WHEN k % 2 = 1 THEN '|Writer ' || k % 9 || '|Guest' ELSE '' END AS authors,
  CASE WHEN k % 2 = 1 THEN 'Topic ' || k % 8 || '|M' || k % 2 ELSE '' END AS entities FROM n"""
    ),
)
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    return evidence(spark, sf_dir).select("page_id", joined(M.authors()).alias("authors"), joined(M.entities()).alias("entities"))


@query(
    "languages",
    """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""",
)
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8."""
    return evidence(spark, sf_dir).select("page_id", M.language().alias("language"))


@query(
    "page_tags",
    with_pages(
        """SELECT page_id, 'k' || k % 5 || '|shared|k' || k % 3 || 'x|a,b' || CASE WHEN k % 2 = 1 THEN '|ldk' ELSE '' END AS tags,
  'Section ' || k % 4 || '|Cat' || CASE WHEN k % 2 = 1 THEN '|G1' ELSE '' END AS labels FROM n"""
    ),
)
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X11."""
    return evidence(spark, sf_dir).select("page_id", joined(M.tags()).alias("tags"), joined(M.labels()).alias("labels"))


@query(
    "page_aliases",
    with_pages(
        """SELECT page_id, site || '/alt/' || k
    || CASE WHEN k % 3 = 0 THEN '|' || site || '/canon/' || k || '?a=1' WHEN k % 2 = 1 THEN '|urn:p:' || k ELSE '' END AS aliases FROM n"""
    ),
)
def page_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own address is no alias."""
    return evidence(spark, sf_dir).withColumn("_c", M.canonical_url()).select("page_id", joined(M.aliases(F.col("_c"))).alias("aliases"))


@query(
    "breadcrumbs",
    with_pages(
        """SELECT page_id, CASE WHEN k % 2 = 1 THEN 'Home|Crumb ' || k % 10 ELSE 'Docs|S' || k % 3 END AS breadcrumbs,
  CASE WHEN k % 2 = 1 THEN 'Home' ELSE 'Docs' END AS section_path FROM n"""
    ),
)
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12, X13."""
    trails = evidence(spark, sf_dir).withColumn("_b", M.breadcrumbs())
    return trails.select(
        "page_id", joined(F.col("_b")).alias("breadcrumbs"), joined(M.section_path(F.col("_b"), M.labels())).alias("section_path")
    )


@query(
    "section_paths",
    with_pages("SELECT page_id, CASE WHEN k % 2 = 1 THEN 'Section ' || k % 4 ELSE '' END AS only_label, 'A' AS one_crumb FROM n"),
)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13 for pages with fewer than two crumbs."""
    rows = corpus.pages(spark, sf_dir).select("page_id")
    label = F.expr("CASE WHEN page_id % 2 = 1 THEN array(concat('Section ', page_id % 4), 'x') ELSE cast(array() AS array<string>) END")
    empty = F.array().cast("array<string>")
    return rows.select(
        "page_id",
        joined(M.section_path(empty, label)).alias("only_label"),
        joined(M.section_path(F.array(F.lit("crumb")), F.array(F.lit("A")))).alias("one_crumb"),
    )


@query(
    "page_versions",
    with_pages(
        "SELECT page_id, CASE WHEN k % 6 = 0 THEN '3.' || k % 10 WHEN k % 2 = 0 THEN 'V1.2.' || k % 9 END AS version FROM n"
    ),
)
def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14."""
    moved = corpus.rich_parsed(spark, sf_dir).withColumn(
        "url", F.expr("CASE WHEN page_id % 2 = 0 THEN concat('https://h.example/v1x/V1.2.', page_id % 9, '/v9?x=/v8/') ELSE url END")
    )
    return M.with_evidence(moved).select("page_id", M.version().alias("version"))


@query(
    "page_visibility",
    with_pages(
        """SELECT page_id, CASE WHEN k % 10 = 3 OR k % 5 = 1 THEN 'noindex' WHEN k % 5 = 2 THEN 'private' WHEN k % 5 = 0 THEN 'index' END AS visibility FROM n"""
    ),
)
def page_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15."""
    return evidence(spark, sf_dir).select("page_id", M.visibility().alias("visibility"))


_TYPE = """CASE WHEN k % 2 = 1 THEN CASE (k // 2) % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'faq' WHEN 3 THEN 'blog' ELSE by_words END ELSE by_words END"""


@query(
    "page_types",
    with_pages(
        f"""SELECT page_id, {_TYPE} AS page_type,
  CASE WHEN k % 2 = 1 THEN ['NewsArticle', 'FAQPage', 'WebPage', 'TechArticle'][(1 + (k // 2) % 4)::INT] || '|BreadcrumbList'
    WHEN by_words = 'faq' OR by_words = 'meeting_notes' THEN 'title/breadcrumbs' ELSE 'url/title' END AS evidence
FROM (SELECT *, CASE
    WHEN k % 2 = 1 THEN CASE WHEN host LIKE 'blog.%' THEN 'blog' END
    WHEN k % 10 = 0 THEN 'release_notes' WHEN k % 10 = 2 THEN 'meeting_notes' ELSE 'documentation' END AS by_words FROM n)"""
    ),
)
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given titles are made-up words, so the words come from URL and breadcrumbs."""
    moved = corpus.rich_parsed(spark, sf_dir).withColumn(
        "url",
        F.expr(
            "concat(substring_index(url, '/', 3), CASE WHEN page_id % 2 = 1 THEN '/x' WHEN page_id % 10 = 0 THEN '/ChangeLog' "
            "WHEN page_id % 10 = 2 THEN '/Agenda' ELSE '/x' END)"
        ),
    )
    typed = M.with_evidence(moved).withColumn("_b", M.breadcrumbs()).withColumn("_s", M.schema_types())
    empty = F.array().cast("array<string>")
    kind = M.page_type(F.lit("title"), F.col("_b"), empty, F.col("_s"))
    return typed.select("page_id", kind.alias("_k")).select(
        "page_id", F.col("_k.page_type").alias("page_type"), joined(F.col("_k.evidence")).alias("evidence")
    )


@query(
    "page_dates",
    with_pages(
        """SELECT page_id, CASE WHEN k % 3 = 1 THEN '2026-01-06' ELSE '2026-01-05T00:00:00' END AS created_at,
  '2026-02-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || 'T09:00:00Z' AS published_at,
  CASE WHEN k % 2 = 1 THEN '2026-03-01T12:30:00' END AS updated_at,
  '2026-02-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || 'T10:00:00+01:00' AS published_raw,
  CASE WHEN k % 3 = 1 THEN 'soon|2026-01-06' ELSE '20260105|2026-01-06' END AS created_raw FROM n"""
    ),
)
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17."""
    dated = evidence(spark, sf_dir).select("page_id", M.page_dates().alias("d"))
    return dated.select(
        "page_id",
        F.col("d.created_at.value").alias("created_at"),
        F.col("d.published_at.value").alias("published_at"),
        F.col("d.updated_at.value").alias("updated_at"),
        joined(F.col("d.published_at.raw")).alias("published_raw"),
        joined(F.col("d.created_at.raw")).alias("created_raw"),
    )


@query(
    "header_fields",
    with_pages(
        """SELECT page_id, '"e' || k || '"' AS etag, '2026-02-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || 'T11:45:00Z' AS last_modified_header,
  length(html)::BIGINT AS content_length, CASE WHEN k % 13 = 0 THEN 'application/pdf' WHEN k % 7 = 0 THEN NULL ELSE 'text/html' END AS content_type,
  status_code::BIGINT AS status_code FROM n"""
    ),
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19, without any parse of the html."""
    return corpus.responses(spark, sf_dir).select(
        "page_id",
        M.header("etag").alias("etag"),
        normalize_rfc2822(M.header("last-modified")).alias("last_modified_header"),
        M.header_number("content-length").alias("content_length"),
        F.nullif(content_type_norm(M.header("content-type")), F.lit("")).alias("content_type"),
        F.col("status_code").cast("bigint").alias("status_code"),
    )


@query(
    "site_names",
    with_pages("SELECT page_id, CASE WHEN k % 5 = 0 THEN 'Site ' || k % 3 WHEN k % 2 = 1 THEN 'Pub ' || k % 3 END AS site_name FROM n"),
)
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20."""
    return evidence(spark, sf_dir).select("page_id", M.site_name().alias("site_name"))


@query(
    "page_metadata",
    with_pages(
        """SELECT page_id, url, CASE WHEN k % 3 = 0 THEN site || '/canon/' || k || '?a=1' WHEN k % 2 = 1 THEN 'urn:p:' || k END AS canonical_url,
  CASE WHEN k % 2 = 0 THEN 'P' || k ELSE 'urn:p:' || k END AS meta_page_id,
  '2026-02-' || lpad((1 + k % 28)::VARCHAR, 2, '0') || 'T09:00:00Z' AS published_at,
  CASE WHEN k % 5 = 0 THEN 'Site ' || k % 3 WHEN k % 2 = 1 THEN 'Pub ' || k % 3 END AS site_name,
  'k' || k % 5 || '|shared|k' || k % 3 || 'x|a,b' || CASE WHEN k % 2 = 1 THEN '|ldk' ELSE '' END AS tags,
  CASE WHEN k % 13 = 0 OR k % 7 = 0 THEN NULL ELSE 'Text/HTML; charset=utf-8' END AS raw_content_type,
  'Sun, ' || 1 + k % 28 || ' Feb 2026 11:45:00 GMT' AS raw_modified FROM n"""
    ),
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21."""
    m = M.page_metadata(corpus.rich_parsed(spark, sf_dir))
    return m.select(
        "page_id",
        "page_metadata.url",
        "page_metadata.canonical_url",
        F.col("page_metadata.page_id").alias("meta_page_id"),
        "page_metadata.published_at",
        "page_metadata.site_name",
        joined(F.col("page_metadata.tags")).alias("tags"),
        F.col("page_metadata_raw.content_type").alias("raw_content_type"),
        F.col("page_metadata_raw.last_modified_header").alias("raw_modified"),
    )


# Every field of the struct by the statement its own operator is checked with.
_FIELDS = " JOIN ".join(
    [f"({ORACLES['page_titles']}) q0"]
    + [f"({ORACLES[name]}) q{k} USING (page_id)" for k, name in enumerate(("canonical_urls", "page_ids", "people", "languages", "page_tags", "page_aliases", "breadcrumbs", "page_visibility", "page_dates", "header_fields", "site_names"), 1)]
)
_LISTS = ("authors", "tags", "aliases", "entities", "labels", "breadcrumbs", "section_path")
_RAW_DATES = ("created_at", "published_at", "updated_at", "last_modified")


@query(
    "page_metadata_fields",
    f"""SELECT p.page_id, p.url, title, canonical_url, split_part(ids, '|', 1) AS meta_page_id, created_at, published_at, updated_at, updated_at AS last_modified, language, content_type,
  CASE WHEN p.page_id % 6 = 0 THEN '3.' || p.page_id % 10 END AS version, site_name, visibility, etag, last_modified_header, status_code, content_length,
  {", ".join(f"nullif({name}, '') AS {name}" for name in _LISTS)},
  ids AS raw_page_id, created_raw AS raw_created_at, published_raw AS raw_published_at, CASE WHEN p.page_id % 2 = 1 THEN '2026-03-01 12:30:00' END AS raw_updated_at, CASE WHEN p.page_id % 2 = 1 THEN '2026-03-01 12:30:00' END AS raw_last_modified
FROM {_FIELDS} JOIN pages p USING (page_id)""",
)
def page_metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, field by field; the page type has its own query."""
    described = M.page_metadata(corpus.rich_parsed(spark, sf_dir)).select("page_id", F.col("page_metadata").alias("m"), F.col("page_metadata_raw").alias("r"))
    plain = ("url", "title", "canonical_url", "created_at", "published_at", "updated_at", "last_modified", "language", "content_type", "version", "site_name", "visibility", "etag", "last_modified_header")
    return described.select(
        "page_id",
        *[F.col(f"m.{name}").alias(name) for name in plain],
        F.col("m.page_id").alias("meta_page_id"),
        *[F.col(f"m.{name}").cast("bigint").alias(name) for name in ("status_code", "content_length")],
        *[joined(F.col(f"m.{name}")).alias(name) for name in _LISTS],
        joined(F.col("r.page_id")).alias("raw_page_id"),
        *[joined(F.col(f"r.{name}")).alias(f"raw_{name}") for name in _RAW_DATES],
    )
