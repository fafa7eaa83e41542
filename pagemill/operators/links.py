"""Link discovery: candidates, decisions with reasons, per-page lists and counts.

All candidates of a page are one array, so classification and the per-page
duplicate check run inside the page's row: no shuffle between the parse and the
decision table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import urls
from pagemill.functions.nodes import attr
from pagemill.functions.text import cached_expression, col, let, starts_with_any, strip
from pagemill.operators.scale import join_dimension

PAYLOAD, HTML, ASSETS = "result.links", "html-fallback", "html-assets"
KEEP, ASSET, DROP = "keep", "asset", "drop"


def _given(value: Column) -> Column:
    return F.when(value != "", value)


def href_candidates(nodes: Column | str) -> Column:
    """L1: a[href], then data-href and data-url of any tag, in document order."""
    per_node = F.transform(
        F.filter(
            col(nodes),
            lambda n: ((n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))
            | F.map_contains_key(n["attrs"], "data-href")
            | F.map_contains_key(n["attrs"], "data-url"),
        ),
        lambda n: F.array_compact(
            F.array(
                _given(F.when(n["tag"] == "a", attr(n, "href"))),
                _given(attr(n, "data-href")),
                _given(attr(n, "data-url")),
            )
        ),
    )
    return F.flatten(per_node)


def asset_candidates(nodes: Column | str) -> Column:
    """L2: sources of media tags and link targets that are no style sheets."""
    picked = F.transform(
        F.filter(col(nodes), lambda n: n["tag"].isin("img", "source", "video", "audio", "link")),
        lambda n: F.when(
            n["tag"] == "link",
            F.when(
                ~F.coalesce(F.lower(attr(n, "rel")), F.lit("")).contains("stylesheet"), _given(attr(n, "href"))
            ),
        ).otherwise(_given(attr(n, "src"))),
    )
    return F.array_compact(picked)


def payload_candidates(payload: Column | str) -> Column:
    """L3: links of a JSON payload ``{bucket: [string | {href} | {url}]}`` in text order."""
    buckets = F.map_values(F.from_json(col(payload), "map<string,variant>"))
    items = F.flatten(
        F.transform(
            buckets,
            lambda b: F.coalesce(
                F.when(F.schema_of_variant(b).startswith("ARRAY"), F.try_variant_get(b, "$", "array<variant>")),
                F.array().cast("array<variant>"),
            ),
        )
    )

    def text(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        href = F.try_variant_get(item, "$.href", "string")
        url = F.try_variant_get(item, "$.url", "string")
        return F.when(kind == "STRING", _given(F.try_variant_get(item, "$", "string"))).when(
            kind.startswith("OBJECT"), F.coalesce(_given(href), _given(url))
        )

    found = F.array_compact(F.transform(items, text))
    return F.coalesce(found, F.array().cast("array<string>"))


def html_hrefs(parsed: DataFrame) -> DataFrame:
    """L1 as rows."""
    return parsed.select("job_id", "page_id", F.posexplode(href_candidates("nodes")).alias("pos", "raw_url"))


def html_assets(parsed: DataFrame) -> DataFrame:
    """L2 as rows."""
    return parsed.select("job_id", "page_id", F.posexplode(asset_candidates("nodes")).alias("pos", "raw_url"))


def payload_links(responses: DataFrame) -> DataFrame:
    """L3 as rows."""
    return responses.select(
        "job_id", "page_id", F.posexplode(payload_candidates("links_payload")).alias("pos", "raw_url")
    )


def _sorted_links(candidates: Column, base_parts: Column) -> Column:
    normal = F.transform(F.transform(candidates, strip), lambda raw: urls.link_parts(raw, base_parts)["url"])
    return F.array_sort(F.array_distinct(F.array_compact(normal)))


def extract_links(parsed: DataFrame) -> DataFrame:
    """L4: sorted distinct links, assets and payload links of each page."""
    lists = let(
        urls.url_parts("url"),
        lambda base: F.struct(
            _sorted_links(href_candidates("nodes"), base).alias("links"),
            _sorted_links(asset_candidates("nodes"), base).alias("assets"),
            _sorted_links(payload_candidates("links_payload"), base).alias("payload_links"),
        ),
    )
    return parsed.select("job_id", "page_id", lists.alias("_l")).select("job_id", "page_id", "_l.*")


def _reason(c: Column, job: Column) -> Column:
    """Rules 1 to 9, first hit wins; NULL for links that are kept unless repeated."""
    raw, link = c["trimmed"], c["link"]
    lowered = F.lower(raw)
    address = F.lower(link["url"])
    return (
        F.when(raw == "", "invalid-url")
        .when(raw.startswith("#"), "anchor-only")
        .when(raw.contains(":") & starts_with_any(lowered, rules.SKIPPED_PREFIXES), "mailto/tel/javascript")
        .when(
            link.isNull(),
            F.when(raw.contains(":") & ~starts_with_any(lowered, ("http://", "https://")), "non-http").otherwise(
                "invalid-url"
            ),
        )
        .when(F.exists(job["extensions"], lambda e: address.endswith(e)), "attachment")
        .when(urls.is_static_asset(link["url"]), "ignored-static-asset")
        .when(urls.path_looks_like_asset(link["path"]), "asset-like-url")
        .when(~urls.host_is_internal(link["host"], job["bare_domains"]), "external-domain")
        .when(
            ~urls.matches_regexes(link["url"], job["include_regexes"], job["exclude_regexes"]), "excluded-by-pattern"
        )
    )


def _decide(candidates: Column, base_parts: Column, job: Column) -> Column:
    """L5 and L6 for the candidate array of one page."""
    normalized = F.transform(
        F.transform(
            candidates,
            lambda c: F.struct(c.alias("c"), strip(c["raw_url"]).alias("trimmed")),
        ),
        lambda t: F.struct(
            t["c"]["source"].alias("source"),
            t["c"]["pos"].alias("pos"),
            t["c"]["raw_url"].alias("raw_url"),
            t["trimmed"].alias("trimmed"),
            urls.link_parts(t["trimmed"], base_parts).alias("link"),
        ),
    )
    judged = F.transform(
        F.transform(
            normalized,
            lambda c, i: F.struct(
                i.alias("seq"),
                c["source"].alias("source"),
                c["pos"].alias("pos"),
                c["raw_url"].alias("raw_url"),
                c["link"]["url"].alias("normalized_url"),
                _reason(c, job).alias("reason"),
            ),
        ),
        lambda r: F.struct(
            # Only links no rule has judged compete for the first use of a key.
            F.when(r["reason"].isNull(), urls.dedup_key(r["normalized_url"])).alias("key"),
            *[r[name].alias(name) for name in ("seq", "source", "pos", "raw_url", "normalized_url", "reason")],
        ),
    )

    def mark_repeats(by_key: Column) -> Column:
        # Sorted by (key, seq), the first use of every key heads its run; a second
        # sort restores page order. n log n for a page with any number of links.
        marked = F.transform(
            by_key,
            lambda r, i: F.struct(
                r["seq"].alias("seq"),
                r["source"].alias("source"),
                r["pos"].alias("pos"),
                r["raw_url"].alias("raw_url"),
                r["normalized_url"].alias("normalized_url"),
                F.coalesce(
                    r["reason"],
                    F.when((i > 0) & (F.get(by_key, i - 1)["key"] == r["key"]), "duplicate-after-normalization"),
                    F.lit("kept"),
                ).alias("reason"),
            ),
        )
        return F.transform(
            F.sort_array(marked),
            lambda r: F.struct(
                r["source"].alias("source"),
                r["pos"].alias("pos"),
                r["raw_url"].alias("raw_url"),
                r["normalized_url"].alias("normalized_url"),
                F.when(r["reason"].isin("attachment", "asset-like-url"), ASSET)
                .when(r["reason"] == "kept", KEEP)
                .otherwise(DROP)
                .alias("decision"),
                r["reason"].alias("reason"),
            ),
        )

    return let(F.sort_array(judged), mark_repeats)


def _tagged(source: str, candidates: Column) -> Column:
    return F.transform(
        candidates,
        lambda raw, i: F.struct(F.lit(source).alias("source"), i.alias("pos"), raw.alias("raw_url")),
    )


@cached_expression
def _decisions() -> Column:
    candidates = F.concat(
        _tagged(PAYLOAD, payload_candidates("links_payload")),
        _tagged(HTML, href_candidates("nodes")),
        _tagged(ASSETS, asset_candidates("nodes")),
    )
    # Bound outside the per-link lambdas, so the page's address is parsed once.
    return let(urls.url_parts("url"), lambda base: _decide(candidates, base, F.col("_job")))


def page_decisions(parsed: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per page with its ``decisions`` array (L5, L6); other columns stay.

    Pages of a job that is not in the table take no part.
    """
    job_columns = ("bare_domains", "include_regexes", "exclude_regexes", "extensions")
    dimension = jobs.select("job_id", F.struct(*job_columns).alias("_job"))
    joined = join_dimension(parsed, dimension, ["job_id"], ["page_id"])
    return joined.withColumn("decisions", _decisions()).drop("_job")


def link_decisions(decided: DataFrame) -> DataFrame:
    """L5, L6 as rows: every candidate with decision and reason."""
    return decided.select("job_id", "page_id", F.inline("decisions"))


def _picked(decision: str) -> Column:
    kept = F.filter("decisions", lambda d: d["decision"] == decision)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda d: d["normalized_url"])))


@cached_expression
def internal_links() -> Column:
    return _picked(KEEP)


@cached_expression
def asset_links() -> Column:
    return _picked(ASSET)


def page_links(decided: DataFrame) -> DataFrame:
    """Sorted distinct internal links and assets."""
    return decided.select(
        "job_id", "page_id", internal_links().alias("internal_links"), asset_links().alias("asset_links")
    )


@cached_expression
def source_count(source: str) -> Column:
    return F.size(F.filter("decisions", lambda d: d["source"] == source))


def discovery_stats(decided: DataFrame) -> DataFrame:
    """Four counts per page."""
    return decided.select(
        "job_id",
        "page_id",
        source_count(PAYLOAD).alias("links_from_result"),
        source_count(HTML).alias("links_from_html_fallback"),
        F.size(internal_links()).alias("filtered_links_count"),
        F.size(asset_links()).alias("filtered_assets_count"),
    )


def split_links(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """Simple split of ``(job_id, page_id, links)`` into internal links and assets."""
    dimension = jobs.select("job_id", F.struct("domains", "include_regexes", "exclude_regexes", "extensions").alias("_job"))
    job = F.col("_job")

    def is_asset(link: Column) -> Column:
        return F.exists(job["extensions"], lambda e: F.lower(link).endswith(e)) | urls.looks_like_asset(link)

    assets = F.filter("links", is_asset)
    internal = F.filter(
        "links",
        lambda link: ~is_asset(link)
        & urls.is_same_domain(link, job["domains"])
        & urls.matches_regexes(link, job["include_regexes"], job["exclude_regexes"]),
    )
    return join_dimension(links, dimension, ["job_id"], ["page_id"]).select(
        "job_id",
        "page_id",
        F.array_sort(F.array_distinct(internal)).alias("internal_links"),
        F.array_sort(F.array_distinct(assets)).alias("asset_links"),
    )


def drop_reasons(decisions: DataFrame) -> DataFrame:
    """How often each reason dropped a link, per source."""
    return (
        decisions.filter(F.col("decision") == DROP)
        .groupBy("reason", "source")
        .agg(F.count("*").alias("n_links"))
    )


def link_report(decided: DataFrame) -> DataFrame:
    """What was seen, kept and dropped on each page."""

    def raw(source: str) -> Column:
        return F.transform(F.filter("decisions", lambda d: d["source"] == source), lambda d: d["raw_url"])

    normalized = F.array_compact(F.transform("decisions", lambda d: d["normalized_url"]))
    dropped = F.transform(
        F.filter("decisions", lambda d: d["decision"] == DROP),
        lambda d: F.struct(
            d["source"].alias("source"),
            d["raw_url"].alias("raw_url"),
            d["normalized_url"].alias("normalized_url"),
            d["reason"].alias("reason"),
        ),
    )
    return decided.select(
        "job_id",
        "page_id",
        raw(PAYLOAD).alias("raw_result_links"),
        raw(HTML).alias("raw_html_links"),
        F.array_sort(F.array_distinct(normalized)).alias("normalized_links"),
        internal_links().alias("kept_links"),
        asset_links().alias("kept_assets"),
        dropped.alias("dropped_links_with_reason"),
    )
