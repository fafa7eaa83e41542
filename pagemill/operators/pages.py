"""Per-page classification: gates, flags, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content_types as ct
from pagemill.functions.text import strip
from pagemill.functions.urls import normalize_url, url_to_rel_path
from pagemill.sources.responses import content_type_header


def describe_pages(responses: DataFrame) -> DataFrame:
    """P1, P4, P5, P7 (length), P8, P9 and both paths in one pass over ``html``.

    Runs before anything is shuffled so that ``html`` itself can be dropped.
    """
    named = responses.withColumns({"content_type": content_type_header(), "normalized_url": normalize_url("url")})
    return named.withColumns(
        {
            "is_html": ct.is_html_document("content_type", "normalized_url", "html"),
            "is_error": ct.is_error("status_code"),
            "raw_title": ct.raw_title("html"),
            "content_hash": ct.content_hash("html"),
            "html_length": F.length("html"),
            "html_small": F.length(strip("html")) < rules.SMALL_HTML_LENGTH,
            "html_path": url_to_rel_path("url", ".html"),
            "markdown_path": url_to_rel_path("url", ".md"),
        }
    )


def markdown_skip_reason(markdown: Column | str = "markdown") -> Column:
    """Why a wanted document is not written, NULL if it is or none is wanted."""
    text = F.col(markdown) if isinstance(markdown, str) else markdown
    empty = F.coalesce(strip(text), F.lit("")) == ""
    reason = F.when(
        F.col("is_error"), F.concat(F.lit("skip_markdown_error_status_"), F.col("status_code").cast("string"))
    )
    return (
        reason.when(~F.col("save_markdown"), F.lit(None).cast("string"))
        .when(~F.col("is_html"), "skip_markdown_non_html")
        .when(empty, "skip_markdown_empty_content")
    )


def markdown_gate(pages: DataFrame, markdown: str = "markdown") -> DataFrame:
    """``markdown_skip_reason`` and ``writes_markdown``.

    ``save_markdown`` is that of the page's job and is used up here; pages without the column want a document.
    """
    wanted = F.coalesce(F.col("save_markdown"), F.lit(True)) if "save_markdown" in pages.columns else F.lit(True)
    flagged = pages.withColumn("save_markdown", wanted)
    return flagged.withColumn("markdown_skip_reason", markdown_skip_reason(markdown)).withColumn(
        "writes_markdown", F.col("save_markdown") & F.col("markdown_skip_reason").isNull()
    ).drop("save_markdown")


def page_flags(pages: DataFrame) -> DataFrame:
    """No links left, almost no html, html length."""
    return pages.select(
        "job_id",
        "page_id",
        (F.size("internal_links") == 0).alias("zero_links"),
        F.col("html_small"),
        F.col("html_length"),
    )
