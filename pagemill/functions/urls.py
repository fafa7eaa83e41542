"""URL algebra as column expressions (no user-defined functions).

A parsed URL is a struct ``(scheme, authority, path, params, query, fragment)``
of strings, never NULL inside. Every function accepts a column or its name and
can be used inside higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.text import cached_expression, col, contains_any, ends_with_any, let, starts_with_any, strip

# RFC 3986, appendix B, with the scheme limited to its legal alphabet. The five
# groups are joined with U+0001 so one regex pass yields all parts.
_SPLIT = r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_MARK = "\u0001"
_C0_AND_SPACE = "".join(chr(code) for code in range(0x21))


@cached_expression
def url_parts(url: Column | str) -> Column:
    """Split into scheme, authority, path, params, query, fragment.

    NULL for text whose authority has unbalanced brackets.
    """
    text = col(url)
    broken = text.contains("\n") | text.contains("\t") | text.contains("\r")
    cleaned = F.ltrim(F.when(broken, F.translate(text, "\t\r\n", "")).otherwise(text), F.lit(_C0_AND_SPACE))
    groups = F.split(
        F.regexp_replace(cleaned, _SPLIT, _MARK.join(f"${n}" for n in range(1, 6))), _MARK, 5
    )

    def build(parts: Column) -> Column:
        path = F.get(parts, F.lit(2))
        authority = F.get(parts, F.lit(1))
        params = F.when(
            path.contains(";"), F.regexp_extract(path, r"\A(?:(?s:.*)/)?[^/;]*;([^/]*)\z", 1)
        ).otherwise(F.lit(""))
        return F.when(
            authority.contains("[") == authority.contains("]"),
            F.struct(
                F.lower(F.get(parts, F.lit(0))).alias("scheme"),
                authority.alias("authority"),
                url_parts_path(path).alias("path"),
                params.alias("params"),
                F.get(parts, F.lit(3)).alias("query"),
                F.get(parts, F.lit(4)).alias("fragment"),
            ),
        )

    return let(groups, build)


def authority_host(authority: Column) -> Column:
    """Lower-case host of an authority: no user info, no port, no brackets."""
    plain = ~(authority.contains("@") | authority.contains(":") | authority.contains("["))
    host = F.regexp_replace(authority, r"\A(?:.*@)?(?:[^\[]*\[([^\]]*)\].*|([^:]*).*)\z", "$1$2")
    return F.lower(F.when(plain, authority).otherwise(host))


@cached_expression
def url_host(url: Column | str) -> Column:
    return let(url_parts(url), lambda p: authority_host(p["authority"]))


def unparse(scheme, authority, path, params, query, fragment) -> Column:
    """Join URL parts again."""
    full_path = F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")))
    rooted = F.when((full_path != "") & ~full_path.startswith("/"), F.concat(F.lit("/"), full_path)).otherwise(full_path)
    bare_authority = scheme.isin([s for s in rules.HIERARCHICAL_SCHEMES if s]) & (
        (full_path == "") | full_path.startswith("/")
    )
    hier = (
        F.when(authority != "", F.concat(F.lit("//"), authority, rooted))
        .when(full_path.startswith("//") | bare_authority, F.concat(F.lit("//"), full_path))
        .otherwise(full_path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        hier,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _remove_dot_segments(segments: Column) -> Column:
    """Resolve '.' and '..'; a trailing one leaves a directory."""
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        segments,
        empty,
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.concat(walked, F.when(ends_in_dots, F.array(F.lit(""))).otherwise(empty))


def _resolve_parts(base: Column, ref: Column) -> Column:
    """Parts of ``ref`` (parsed) seen from ``base`` (parsed), both of one scheme."""

    def out(authority, path, params, query) -> Column:
        return F.struct(
            base["scheme"].alias("scheme"),
            authority.alias("authority"),
            path.alias("path"),
            params.alias("params"),
            query.alias("query"),
            ref["fragment"].alias("fragment"),
        )

    base_dir = let(
        F.split(base["path"], "/"),
        lambda b: F.when(F.element_at(b, -1) != "", F.slice(b, F.lit(1), F.size(b) - 1)).otherwise(b),
    )
    ref_segments = F.split(ref["path"], "/")

    def squeeze(parts: Column) -> Column:
        # Empty segments vanish, but for the first and the last one.
        last = F.size(parts) - 1
        return F.filter(parts, lambda item, i: (item != "") | (i == 0) | (i == last))

    segments = F.when(ref["path"].startswith("/"), ref_segments).otherwise(
        let(F.concat(base_dir, ref_segments), squeeze)
    )
    merged = let(
        segments,
        lambda s: F.array_join(
            F.when(F.array_contains(s, ".") | F.array_contains(s, ".."), _remove_dot_segments(s)).otherwise(s), "/"
        ),
    )
    # Most links start at the root and have no dot segments: nothing to merge.
    merged = F.when(ref["path"].startswith("/") & ~ref["path"].contains("/."), ref["path"]).otherwise(
        let(merged, lambda m: F.when(m == "", F.lit("/")).otherwise(m))
    )
    same_document = (ref["path"] == "") & (ref["params"] == "")
    return (
        F.when(ref["authority"] != "", out(ref["authority"], ref["path"], ref["params"], ref["query"]))
        .when(
            same_document,
            out(
                base["authority"], base["path"], base["params"],
                F.when(ref["query"] == "", base["query"]).otherwise(ref["query"]),
            ),
        )
        .otherwise(out(base["authority"], merged, ref["params"], ref["query"]))
    )


def _relative(p: Column) -> Column:
    """Whether ``p.r`` has to be seen from ``p.b`` at all: no other scheme of its own."""
    return (
        p["b"].isNotNull()
        & p["b"]["scheme"].isin(list(rules.HIERARCHICAL_SCHEMES))
        & ((p["r"]["scheme"] == "") | (p["r"]["scheme"] == p["b"]["scheme"]))
    )


def _both(base_parts: Column, ref: Column | str) -> Column:
    return F.struct(base_parts.alias("b"), url_parts(ref).alias("r"))


def resolve_parts(base_parts: Column, ref: Column | str) -> Column:
    """Parsed form of ``ref`` resolved against a parsed base; NULL if unparseable."""
    return let(
        _both(base_parts, ref), lambda p: F.when(_relative(p), _resolve_parts(p["b"], p["r"])).otherwise(p["r"])
    )


@cached_expression
def url_resolve(base: Column | str, ref: Column | str) -> Column:
    """Relative to absolute; a link with another scheme stays as it is written."""
    base, ref = col(base), col(ref)

    def build(p: Column) -> Column:
        joined = let(
            _resolve_parts(p["b"], p["r"]),
            lambda r: unparse(r["scheme"], r["authority"], r["path"], r["params"], r["query"], r["fragment"]),
        )
        return F.when(p["r"].isNull(), F.lit(None).cast("string")).when(_relative(p), joined).otherwise(ref)

    return F.when(base == "", ref).when(ref == "", base).otherwise(let(_both(url_parts(base), ref), build))


def _decode(text: Column) -> Column:
    """Form-decode one key or value; stray '%' signs are kept as they are."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    """Form-encode; '~' stays and '*' does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """Decoded ``array<struct<k,v>>`` in order; ``c`` counts as ``c=``."""
    items = F.filter(F.split(query, "&"), lambda item: item != "")
    return F.transform(
        items,
        lambda item: F.struct(
            _decode(F.regexp_extract(item, r"(?s)\A([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(item, r"(?s)\A[^=]*=(.*)\z", 1)).alias("v"),
        ),
    )


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def requery(query: Column | str) -> Column:
    """Decode and encode a query string again."""
    query = col(query)
    return F.when(query == "", F.lit("")).otherwise(encode_pairs(query_pairs(query)))


def _clean_path(path: Column) -> Column:
    """Rooted path without repeated slashes."""
    single = F.when(path.contains("//"), F.regexp_replace(path, "/{2,}", "/")).otherwise(path)
    return let(single, lambda v: F.when(v.startswith("/"), v).otherwise(F.concat(F.lit("/"), v)))


def link_parts(raw: Column, base_parts: Column | None = None) -> Column:
    """``struct(url, host, path)`` of a trimmed link in discovery form, or NULL.

    Callers with many links per page pass the page's parsed address, so it is
    parsed once.
    """
    absolute = url_parts(raw) if base_parts is None else resolve_parts(base_parts, raw)

    def query_of(p: Column) -> Column:
        kept = F.filter(
            query_pairs(p["query"]),
            lambda kv: (kv["k"] != "") & ~starts_with_any(F.lower(kv["k"]), rules.TRACKING_KEY_PREFIXES),
        )
        return F.when(p["query"] == "", F.lit("")).otherwise(encode_pairs(kept))

    def build(p: Column) -> Column:
        path = let(
            _clean_path(p["path"]),
            lambda v: F.when(F.lower(v).isin(list(rules.INDEX_PATHS)), F.lit("/")).otherwise(v),
        )
        named = F.struct(F.lower(p["authority"]).alias("authority"), path.alias("path"), query_of(p).alias("query"))
        return F.when(
            p["scheme"].isin("http", "https") & (p["authority"] != ""),
            let(
                named,
                lambda v: F.struct(
                    F.concat(
                        p["scheme"], F.lit("://"), v["authority"], v["path"],
                        F.when(v["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), v["query"])),
                    ).alias("url"),
                    authority_host(v["authority"]).alias("host"),
                    url_parts_path(v["path"]).alias("path"),
                ),
            ),
        )

    skipped = (
        (raw == "") | raw.startswith("#") | (raw.contains(":") & starts_with_any(F.lower(raw), rules.SKIPPED_PREFIXES))
    )
    return F.when(~skipped, let(absolute, build))


@cached_expression
def normalize_link(ref: Column | str, base: Column | str | None = None) -> Column:
    """Canonical form of a discovered link, NULL when it cannot be followed."""
    base_parts = None if base is None else url_parts(base)
    return let(strip(ref), lambda raw: link_parts(raw, base_parts)["url"])


def _crawl_parts(url: Column | str) -> Column:
    """Scheme, authority, path and query of the crawl form."""

    def build(p: Column) -> Column:
        path = F.rtrim(_clean_path(p["path"]), F.lit("/"))
        query = F.when(p["query"] == "", F.lit("")).otherwise(
            encode_pairs(F.sort_array(query_pairs(p["query"])))
        )
        return F.when(
            p.isNotNull(),
            F.struct(
                F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"]).alias("scheme"),
                F.lower(p["authority"]).alias("authority"),
                let(path, lambda v: F.when(v == "", F.lit("/")).otherwise(v)).alias("path"),
                query.alias("query"),
            ),
        )

    return let(url_parts(strip(url)), build)


@cached_expression
def normalize_url(url: Column | str) -> Column:
    """U4: the key pages are visited, stored and compared by."""
    return let(
        _crawl_parts(url),
        lambda p: F.when(
            p["authority"] != "",
            F.concat(
                p["scheme"], F.lit("://"), p["authority"], p["path"],
                F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
            ),
        ).otherwise(unparse(p["scheme"], p["authority"], p["path"], F.lit(""), p["query"], F.lit(""))),
    )


def _sanitize(segment: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(segment, r"[^a-zA-Z0-9._/\-]+", "-"), F.lit("-._"))
    return let(cleaned, lambda v: F.when(v == "", F.lit("index")).otherwise(v))


def _path_segments(url: Column | str) -> Column:
    normalized = let(_crawl_parts(url), lambda p: url_parts_path(p["path"]))
    return F.filter(F.split(normalized, "/"), lambda item: item != "")


def url_parts_path(path: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.when(
        path.contains(";"), F.regexp_replace(path, r"(?s)\A((?:.*/)?[^/;]*);[^/]*\z", "$1")
    ).otherwise(path)


@cached_expression
def url_to_rel_path(url: Column | str, suffix: str) -> Column:
    """File path a page is stored at."""

    def build(raw: Column) -> Column:
        last_raw = F.element_at(raw, -1)
        dotted = last_raw.contains(".")
        stem = F.regexp_extract(last_raw, r"(?s)\A(.*)\.[^.]*\z", 1)
        plain = F.regexp_replace(last_raw, r"\.html\z", "")
        last = _sanitize(F.when(dotted, stem).otherwise(plain))
        # The suffix replaces one more extension if the name still has one.
        named = F.concat(F.regexp_replace(last, r"\A(.+)\.[^.]+\z", "$1"), F.lit(suffix))
        dirs = F.transform(
            F.slice(raw, F.lit(1), F.size(raw) - 1), lambda s: _sanitize(F.regexp_replace(s, r"\.html\z", ""))
        )
        return F.when(F.size(raw) == 0, F.lit("index" + suffix)).otherwise(
            F.array_join(F.concat(dirs, F.array(named)), "/")
        )

    return let(_path_segments(url), build)


@cached_expression
def asset_rel_path(url: Column | str) -> Column:
    """File path an asset is stored at."""

    def build(raw: Column) -> Column:
        name = F.element_at(raw, -1)
        stem = F.regexp_extract(name, r"(?s)\A(.*)\.[^.]*\z", 1)
        ext = F.regexp_extract(name, r"([^.]*)\z", 1)
        safe = F.when(
            name.contains("."), F.concat(_sanitize(stem), F.lit("."), F.lower(_sanitize(ext)))
        ).otherwise(_sanitize(name))
        dirs = F.transform(F.slice(raw, F.lit(1), F.size(raw) - 1), _sanitize)
        return F.when(F.size(raw) == 0, F.lit("file.bin")).otherwise(
            F.array_join(F.concat(dirs, F.array(safe)), "/")
        )

    return let(_path_segments(url), build)


def dedup_key(url: Column | str) -> Column:
    """U8: one trailing slash less, except for the root; the query stays."""
    url = col(url)
    ends = url.endswith("/") | url.contains("/?")
    # The first path segment must exist for a slash to be a trailing one.
    without = F.regexp_replace(url, r"\A([^:/?#]+://[^/?#]*/[^?#]*)/(\?.*)?\z", "$1$2")
    return F.when(ends, without).otherwise(url)


@cached_expression
def is_same_domain(url: Column | str, domains: Column | str) -> Column:
    """Host equals an allowed domain or is below one."""
    return let(url_host(url), lambda host: _within(host, F.transform(col(domains), F.lower)))


def _within(host: Column, lowered_domains: Column) -> Column:
    return F.exists(lowered_domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def without_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(strip(host)), r"\Awww\.", "")


def host_is_internal(host: Column, bare_domains: Column) -> Column:
    """U10 for a host and domains that went through ``without_www``."""
    bare = F.when(host.startswith("www."), F.substring(host, F.lit(5), F.length(host))).otherwise(host)
    return _within(host, bare_domains) | (host.startswith("www.") & let(bare, lambda b: _within(b, bare_domains)))


@cached_expression
def is_internal(url: Column | str, domains: Column | str) -> Column:
    """As U9, a leading ``www.`` on either side not counting."""
    return let(url_host(url), lambda host: host_is_internal(host, F.transform(col(domains), without_www)))


@cached_expression
def glob_to_regex(glob: Column | str) -> Column:
    """Anchored Java regex of a shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``)."""
    tokens = F.regexp_extract_all(
        col(glob), F.lit(r"(?s)(\[!?\]?[^\]]*\]|\*+|\?|[^*?\[]+|\[)"), F.lit(1)
    )

    def translate(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        negated = inner.startswith("!")
        body = F.when(negated, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner)
        body = F.regexp_replace(body, r"([\\\[\]&~|^])", r"\\$1")
        quoted = F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return (
            F.when(token.startswith("*"), F.lit(".*"))
            .when(token == "?", F.lit("."))
            .when(token == "[", F.lit("\\["))
            .when(
                token.startswith("[") & (F.length(token) > 2),
                F.concat(F.lit("["), F.when(negated, F.lit("^")).otherwise(F.lit("")), body, F.lit("]")),
            )
            .otherwise(quoted)
        )

    return F.concat(F.lit("(?s)\\A(?:"), F.array_join(F.transform(tokens, translate), ""), F.lit(")\\z"))


def matches_regexes(url: Column, includes: Column, excludes: Column) -> Column:
    """Some include (if there are any) and no exclude matches; NULL lists are empty."""
    includes = F.coalesce(includes, F.array().cast("array<string>"))
    excludes = F.coalesce(excludes, F.array().cast("array<string>"))
    return ((F.size(includes) == 0) | F.exists(includes, lambda p: F.rlike(url, p))) & ~F.exists(
        excludes, lambda p: F.rlike(url, p)
    )


def matches_patterns(url: Column | str, includes: Column | str, excludes: Column | str) -> Column:
    """As ``matches_regexes``, from globs."""
    return matches_regexes(
        col(url), F.transform(col(includes), glob_to_regex), F.transform(col(excludes), glob_to_regex)
    )


def path_looks_like_asset(path: Column) -> Column:
    """U12 for a path alone."""
    lowered = F.lower(path)
    return ends_with_any(lowered, rules.IMAGE_EXTENSIONS) | contains_any(
        F.substring_index(lowered, "/", -1), rules.ASSET_NAME_HINTS
    )


@cached_expression
def looks_like_asset(url: Column | str) -> Column:
    """Image extension, or a file name that hints at one."""
    return let(url_parts(F.lower(col(url))), lambda p: path_looks_like_asset(p["path"]))


def is_static_asset(url: Column | str) -> Column:
    """Style sheets, scripts, fonts."""
    return ends_with_any(F.lower(col(url)), rules.STATIC_EXTENSIONS)


def normalize_extension(ext: Column) -> Column:
    return F.lower(F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext)))


def is_attachment(url: Column | str, extensions: Column | str) -> Column:
    """The whole URL, query included, ends with a configured extension."""
    lowered = F.lower(col(url))
    return F.exists(F.transform(col(extensions), normalize_extension), lambda e: lowered.endswith(e))


@cached_expression
def is_configured_attachment(url: Column | str, extensions: Column | str) -> Column:
    """The path alone ends with a configured extension."""
    return let(
        F.lower(let(url_parts(url), lambda p: p["path"])),
        lambda path: (path != "")
        & F.exists(F.transform(col(extensions), normalize_extension), lambda e: path.endswith(e)),
    )
