"""Content type, status and title tests on single responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.text import cached_expression, col, contains_any, ends_with_any, let, lstrip, non_empty, starts_with_any, strip
from pagemill.functions.urls import url_parts


def content_type_norm(content_type: Column | str) -> Column:
    """Media type without parameters, lower case, '' for NULL."""
    return F.lower(strip(F.split_part(F.coalesce(col(content_type), F.lit("")), F.lit(";"), F.lit(1))))


def is_html_type(content_type: Column | str) -> Column:
    """P2."""
    return content_type_norm(content_type).isin(list(rules.HTML_CONTENT_TYPES))


def is_binary_type(content_type: Column | str) -> Column:
    """P3."""
    return starts_with_any(content_type_norm(content_type), rules.BINARY_CONTENT_TYPE_PREFIXES)


@cached_expression
def is_html_document(content_type: Column | str, url: Column | str, html: Column | str) -> Column:
    """By type, else by path suffix, else by the look of the first characters."""
    sample = F.lower(F.substring(lstrip(F.coalesce(col(html), F.lit(""))), 1, rules.HTML_SNIFF_LENGTH))
    path = F.coalesce(F.lower(let(url_parts(url), lambda p: p["path"])), F.lit(""))
    return (
        F.when(is_html_type(content_type), F.lit(True))
        .when(ends_with_any(path, rules.NON_HTML_PATH_SUFFIXES), F.lit(False))
        .otherwise(
            starts_with_any(sample, rules.HTML_SNIFF_PREFIXES) | contains_any(sample, rules.HTML_SNIFF_PARTS)
        )
    )


def is_error(status_code: Column | str) -> Column:
    """P5: status 400 and above; an unknown status is no error."""
    return F.coalesce(col(status_code) >= 400, F.lit(False))


@cached_expression
def raw_title(html: Column | str) -> Column:
    """Text of the first title element, entities untouched."""
    return non_empty(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def content_hash(html: Column | str) -> Column:
    """SHA-256 of the UTF-8 text, hexadecimal."""
    return F.sha2(F.encode(col(html), "UTF-8"), 256)
