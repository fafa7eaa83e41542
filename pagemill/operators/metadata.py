"""Page metadata: 25 normalised fields and the raw evidence, one struct per page.

Works inside the page's row; the node array is reduced to a few small arrays
first (metas, links, JSON-LD objects), which all fields share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import nodes as N
from pagemill.functions.content_types import content_type_norm
from pagemill.functions.dates import normalize_datetime, normalize_rfc2822
from pagemill.functions.text import (
    cached_expression,
    first_non_empty,
    let,
    merge_values,
    no_strings,
    non_empty,
    null_if_empty,
    split_keywords,
    strip,
    unique_strings,
)
from pagemill.functions.urls import url_parts, url_resolve
from pagemill.operators import jsonld

_METADATA_TAGS = ("meta", "link", "time", "html", "h1", "title", "main", "article", "body")


def with_evidence(parsed: DataFrame) -> DataFrame:
    """X1, X2 and the other inputs of the fields: small arrays taken from ``nodes``."""
    heads = parsed.withColumn("_picked", F.filter("nodes", lambda n: n["tag"].isin(list(_METADATA_TAGS))))
    metas = F.transform(
        N.with_tag(F.col("_picked"), "meta"),
        lambda n: F.struct(
            N.attr(n, "name").alias("name"),
            N.attr(n, "property").alias("property"),
            N.attr(n, "content").alias("content"),
        ),
    )
    links = F.transform(
        N.with_tag(F.col("_picked"), "link"),
        lambda n: F.struct(
            F.transform(N.tokens(n, "rel"), F.lower).alias("rels"), N.attr(n, "href").alias("href")
        ),
    )
    return (
        heads.withColumn("metas", metas)
        .withColumn("links", links)
        .withColumn("ld", jsonld.jsonld_objects(F.col("nodes")))
    )


def meta_pairs(evidence: DataFrame) -> DataFrame:
    """X1 as rows: ``(attr, key, content, pos)``."""
    entries = F.flatten(
        F.transform(
            "metas",
            lambda m, i: F.filter(
                F.array(
                    F.struct(F.lit("name").alias("attr"), m["name"].alias("key"), m["content"].alias("content"), i.alias("pos")),
                    F.struct(F.lit("property").alias("attr"), m["property"].alias("key"), m["content"].alias("content"), i.alias("pos")),
                ),
                lambda e: e["key"].isNotNull() & e["content"].isNotNull(),
            ),
        )
    )
    return evidence.select("job_id", "page_id", F.inline(entries))


@cached_expression
def meta_first(attr: str, key: str) -> Column:
    """Content of the first meta with exactly this key; later ones are not tried."""
    return non_empty(N.first(F.filter("metas", lambda m: m[attr] == key))["content"])


def meta_all(attr: str, *keys: str) -> Column:
    """Contents of all metas with one of the keys, in any case, in page order."""
    lowered = [key.lower() for key in keys]
    found = F.filter("metas", lambda m: F.coalesce(F.lower(m[attr]).isin(lowered), F.lit(False)))
    return F.array_compact(F.transform(found, lambda m: non_empty(m["content"])))


_ld = "ld"


@cached_expression
def ld_text(path: str) -> Column:
    return jsonld.first_text(F.col(_ld), path)


@cached_expression
def ld_strings(path: str) -> Column:
    return jsonld.strings(F.col(_ld), path)


@cached_expression
def title_tag() -> Column:
    """Text of the title element if it has exactly one child."""

    def build(node: Column) -> Column:
        child = F.get(F.col("nodes"), node["node_id"] + 1)
        single = (node["end_id"] > node["node_id"]) & (child["end_id"] == node["end_id"])
        return F.when(single & child["tag"].startswith("#"), non_empty(child["text"]))

    return let(N.first(N.with_tag(F.col("_picked"), "title")), build)


@cached_expression
def page_title() -> Column:
    """X4."""
    return first_non_empty(
        meta_first("property", "og:title"),
        meta_first("name", "twitter:title"),
        ld_text("headline"),
        ld_text("name"),
        let(N.first(N.with_tag(F.col("_picked"), "h1")), lambda n: N.node_text(F.col("nodes"), n)),
        title_tag(),
        F.col("raw_title"),
    )


@cached_expression
def canonical_url() -> Column:
    """X5."""
    marked = F.filter("links", lambda l: F.array_contains(l["rels"], "canonical") & non_empty(l["href"]).isNotNull())
    link = let(N.first(marked)["href"], lambda href: F.when(href.isNotNull(), url_resolve(F.col("url"), strip(href))))
    return first_non_empty(link, meta_first("property", "og:url"), ld_text("@id"))


@cached_expression
def element_ids() -> Column:
    """Id of the first main, else article, else body element that has one."""
    firsts = F.array(*[N.first(N.with_tag(F.col("_picked"), tag)) for tag in ("main", "article", "body")])
    ids = F.array_compact(F.transform(firsts, lambda n: F.when(n.isNotNull(), non_empty(N.attr(n, "id")))))
    return F.slice(ids, 1, 1)


@cached_expression
def page_id_candidates() -> Column:
    """Everything that names the page, best first."""
    return merge_values(
        meta_all("name", *rules.PAGE_ID_NAMES),
        meta_all("property", "article:id"),
        ld_strings("identifier"),
        ld_strings("@id"),
        element_ids(),
    )


@cached_expression
def authors() -> Column:
    """X7."""
    return unique_strings(
        merge_values(
            meta_all("name", "author"),
            meta_all("property", "article:author"),
            jsonld.names(F.col(_ld), "author"),
            jsonld.names(F.col(_ld), "creator"),
        )
    )


@cached_expression
def entities() -> Column:
    """X7."""
    return unique_strings(
        merge_values(jsonld.names(F.col(_ld), "about"), jsonld.names(F.col(_ld), "mentions"))
    )


@cached_expression
def language() -> Column:
    """X8."""
    return first_non_empty(
        N.attr(N.first(N.with_tag(F.col("_picked"), "html")), "lang"),
        meta_first("name", "language"),
        ld_text("inLanguage"),
    )


@cached_expression
def tags() -> Column:
    """Keyword lists are split, article tags are not."""
    keywords = F.flatten(F.transform(meta_all("name", "keywords", "news_keywords"), split_keywords))
    ld_keywords = F.flatten(F.transform(ld_strings("keywords"), split_keywords))
    return unique_strings(merge_values(keywords, meta_all("property", "article:tag"), ld_keywords))


def aliases(canonical: Column) -> Column:
    """Other addresses of the page."""
    wanted = F.array(*[F.lit(rel) for rel in rules.ALIAS_RELS])
    found = F.filter("links", lambda l: F.arrays_overlap(l["rels"], wanted) & (l["href"] != ""))
    resolved = F.transform(found, lambda l: url_resolve(F.col("url"), l["href"]))
    own = F.when(canonical != F.col("url"), F.array(canonical))
    return F.array_remove(unique_strings(merge_values(resolved, own)), F.col("url"))


@cached_expression
def labels() -> Column:
    """X11."""
    return unique_strings(
        merge_values(
            meta_all("property", "article:section"),
            meta_all("name", "section", "category"),
            ld_strings("articleSection"),
            ld_strings("genre"),
        )
    )


@cached_expression
def breadcrumbs() -> Column:
    """JSON-LD list, else the first marked-up trail that has texts."""

    def is_label(n: Column) -> Column:
        return N.matches(n, ("label", "breadcrumb"))

    selectors = (
        lambda n: (n["tag"] == "nav") & is_label(n),
        lambda n: N.matches(n, ("role", "navigation")) & is_label(n),
        lambda n: N.matches(n, ("class", "breadcrumb")),
        lambda n: N.matches(n, ("class", "breadcrumbs")),
        lambda n: N.matches(n, ("testid", "breadcrumb")),
    )
    nodes = F.col("nodes")
    marked = F.filter(
        nodes,
        lambda n: ~n["tag"].startswith("#")
        & (is_label(n) | N.matches(n, ("class", "breadcrumb")) | N.matches(n, ("class", "breadcrumbs")) | N.matches(n, ("testid", "breadcrumb"))),
    )

    def trail(node: Column) -> Column:
        below = F.filter(
            N.subtree(nodes, node), lambda n: n["tag"].isin("a", "span", "li") & (n["node_id"] > node["node_id"])
        )
        texts = F.transform(below, lambda n: N.node_text(nodes, n))
        return F.when(node.isNotNull(), unique_strings(texts))

    def pick(found: Column) -> Column:
        trails = F.transform(F.array(*[N.first(F.filter(found, test)) for test in selectors]), trail)
        return N.first(F.filter(trails, lambda t: F.size(t) > 0))

    listed = jsonld.breadcrumbs(F.col(_ld))
    return unique_strings(F.coalesce(listed, let(marked, pick), no_strings()))


def section_path(crumbs: Column, label_list: Column) -> Column:
    """X13."""
    return F.when(F.size(crumbs) > 1, F.slice(crumbs, F.lit(1), F.size(crumbs) - 1)).otherwise(F.slice(label_list, 1, 1))


@cached_expression
def version() -> Column:
    """Stated, else the first ``v1.2``-like path segment."""
    segments = F.split(let(url_parts("url"), lambda p: p["path"]), "/")
    in_path = N.first(F.filter(segments, lambda s: s.rlike(r"(?i)\Av\d+(?:\.\d+){0,3}\z")))
    return F.coalesce(
        first_non_empty(meta_first("name", "version"), meta_first("property", "version"), ld_text("version")), in_path
    )


@cached_expression
def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


@cached_expression
def visibility() -> Column:
    """The strictest word of robots, googlebot and the X-Robots-Tag header."""
    robots = F.lower(
        F.concat_ws(
            ",",
            meta_first("name", "robots"),
            meta_first("name", "googlebot"),
            F.nullif(header("x-robots-tag"), F.lit("")),
        )
    )
    return (
        F.when(robots.contains("noindex"), "noindex")
        .when(robots.contains("private"), "private")
        .when(robots.contains("index"), "index")
    )


@cached_expression
def schema_types() -> Column:
    return unique_strings(jsonld.types(F.col(_ld)))


def page_type(title: Column, crumbs: Column, label_list: Column, types: Column) -> Column:
    """Schema types in order, then words in URL, title, breadcrumbs and labels.

    Returns ``struct(page_type, evidence)``; both NULL if there is nothing.
    """
    known = F.create_map(*[F.lit(v) for pair in rules.SCHEMA_PAGE_TYPES.items() for v in pair])
    in_news = F.lower("url").contains("/news/")

    def of_schema(kind: Column) -> Column:
        lowered = F.lower(kind)
        return F.coalesce(
            F.try_element_at(known, lowered),
            F.when(lowered.isin(list(rules.SCHEMA_ARTICLE_TYPES)) & ~in_news, F.lit("blog")),
        )

    by_schema = N.first(F.array_compact(F.transform(types, of_schema)))
    combined = F.concat_ws(
        " ", F.lower("url"), F.lower(F.nullif(title, F.lit(""))), F.transform(crumbs, F.lower), F.transform(label_list, F.lower)
    )

    def by_words(words: Column) -> Column:
        result = None
        for name, evidence, tokens in rules.TOKEN_PAGE_TYPES:
            hit = words.rlike("|".join("\\Q" + token + "\\E" for token in tokens))
            value = F.struct(F.lit(name).alias("page_type"), F.lit(evidence).alias("default"))
            result = F.when(hit, value) if result is None else result.when(hit, value)
        return result

    hit = F.when(by_schema.isNotNull(), F.struct(by_schema.alias("page_type"), F.lit(None).cast("string").alias("default"))).otherwise(
        let(combined, by_words)
    )
    return let(
        hit,
        lambda h: F.struct(
            h["page_type"].alias("page_type"),
            F.when(F.size(types) > 0, types).when(h["default"].isNotNull(), F.array(h["default"])).alias("evidence"),
        ),
    )


def _time_values(classes: tuple[str, ...]) -> Column:
    wanted = F.array(*[F.lit(c) for c in classes])

    def fits(n: Column) -> Column:
        given = F.filter(F.transform(N.tokens(n, "class"), F.lower), lambda c: c != "")
        return (F.size(given) == 0) | F.arrays_overlap(given, wanted)

    found = F.filter(N.with_tag(F.col("_picked"), "time"), fits)
    return F.array_compact(F.transform(found, lambda n: non_empty(N.attr(n, "datetime"))))


def date_candidates(field: str) -> Column:
    """Texts that may hold the date, best first."""
    properties, names, classes, key = rules.DATE_SOURCES[field]
    sources = []
    if properties:
        sources.append(meta_all("property", *properties))
    sources.append(meta_all("name", *names))
    if classes:
        sources.append(_time_values(classes))
    sources.append(ld_strings(key))
    return merge_values(*sources)


@cached_expression
def page_dates() -> Column:
    """Per field ``struct(value, raw)``: the first text that parses, and all texts if that is not the first."""

    def pick(texts: Column) -> Column:
        return let(
            N.first(F.array_compact(F.transform(texts, normalize_datetime))),
            lambda value: F.struct(
                value.alias("value"), F.when(F.get(texts, F.lit(0)) != value, texts).alias("raw")
            ),
        )

    # One array of all fields, so the parser is in the plan once.
    picked = F.transform(F.array(*[date_candidates(field) for field in rules.DATE_SOURCES]), pick)
    return let(
        picked, lambda p: F.struct(*[F.get(p, F.lit(i)).alias(field) for i, field in enumerate(rules.DATE_SOURCES)])
    )


@cached_expression
def site_name() -> Column:
    """X20."""
    return first_non_empty(
        meta_first("property", "og:site_name"),
        meta_first("name", "application-name"),
        ld_text("publisher.name"),
        ld_text("isPartOf.name"),
    )


@cached_expression
def header_number(name: str) -> Column:
    digits = F.replace(strip(header(name)), F.lit("_"), F.lit(""))
    return F.when(strip(header(name)).rlike(r"\A[+-]?\d+(?:_\d+)*\z"), digits.try_cast("bigint"))


def page_metadata(parsed: DataFrame) -> DataFrame:
    """Adds ``page_metadata`` and ``page_metadata_raw``; needs url, raw_title, headers, status, nodes."""
    dates = list(rules.DATE_SOURCES)
    base = with_evidence(parsed).withColumns(
        {
            "_title": page_title(),
            "_canonical": canonical_url(),
            "_ids": page_id_candidates(),
            "_labels": labels(),
            "_crumbs": breadcrumbs(),
            "_types": schema_types(),
            "_dates": page_dates(),
            "_modified": normalize_rfc2822(header("last-modified")),
            "_ctype": F.nullif(content_type_norm(header("content-type")), F.lit("")),
        }
    ).withColumn("_kind", page_type(F.col("_title"), F.col("_crumbs"), F.col("_labels"), F.col("_types")))
    fields = {
        "url": F.col("url"),
        "title": F.col("_title"),
        "canonical_url": F.col("_canonical"),
        "page_id": F.get("_ids", F.lit(0)),
        **{name: F.col(f"_dates.{name}.value") for name in dates},
        "authors": null_if_empty(authors()),
        "language": language(),
        "content_type": F.col("_ctype"),
        "page_type": F.col("_kind.page_type"),
        "site_name": site_name(),
        "version": version(),
        "visibility": visibility(),
        "tags": null_if_empty(tags()),
        "aliases": null_if_empty(aliases(F.col("_canonical"))),
        "entities": null_if_empty(entities()),
        "labels": null_if_empty(F.col("_labels")),
        "breadcrumbs": null_if_empty(F.col("_crumbs")),
        "section_path": null_if_empty(section_path(F.col("_crumbs"), F.col("_labels"))),
        "etag": F.nullif(header("etag"), F.lit("")),
        "last_modified_header": F.col("_modified"),
        "status_code": F.col("status_code"),
        "content_length": header_number("content-length"),
    }
    raw = {
        "page_id": null_if_empty(unique_strings(F.col("_ids"))),
        "content_type": F.when(F.col("_ctype") != header("content-type"), header("content-type")),
        "page_type": F.col("_kind.evidence"),
        **{name: F.col(f"_dates.{name}.raw") for name in dates},
        "last_modified_header": F.when(F.col("_modified") != header("last-modified"), header("last-modified")),
    }
    return base.select(
        *parsed.columns,
        F.struct(*[value.alias(name) for name, value in fields.items()]).alias("page_metadata"),
        F.struct(*[value.alias(name) for name, value in raw.items()]).alias("page_metadata_raw"),
    )
