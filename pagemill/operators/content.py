"""Main-content selection on node arrays: boilerplate removal and best container.

Subtrees are slices of the node array. Dropping them means cutting the array at
the outermost dropped nodes, and subtree text lengths follow from the totals the
parse left on every element, so nothing walks a subtree more than once. What
lies within what is found by running totals over the cuts and a search in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import nodes as N
from pagemill.functions.text import cached_expression, count_up_to, let, running
from pagemill.operators.scale import join_dimension


def check_mode(mode: str) -> str:
    normalized = (mode or "main").strip().lower()
    if normalized not in rules.CONTENT_MODES:
        raise ValueError(f"unknown content mode {mode!r}; known: {', '.join(rules.CONTENT_MODES)}")
    return normalized


def _selectors(mode: str) -> tuple[tuple[str, str], ...]:
    return rules.BOILERPLATE_SELECTORS + (rules.AGGRESSIVE_SELECTORS if mode == "aggressive" else ())


def boilerplate_cuts(nodes: Column, mode: str = "main") -> Column:
    """Outermost nodes to drop, in document order."""
    flagged = F.transform(
        F.filter(nodes, lambda n: N.matches_any(n, _selectors(mode))),
        lambda n: F.struct(
            n["node_id"].alias("node_id"),
            n["end_id"].alias("end_id"),
            n["chars"].alias("chars"),
            n["runs"].alias("runs"),
            (n["blocks"] + n["tag"].isin(list(rules.SUBSTANTIAL_TAGS)).cast("int")).alias("blocks"),
        ),
    )

    def outermost(found: Column) -> Column:
        # Subtrees lie within one another or apart: one is inside if any earlier one ends behind its start.
        ends = running(F.transform(found, lambda f: f["end_id"]), F.greatest)
        return let(ends, lambda last: F.filter(found, lambda f, k: (k == 0) | (F.get(last, k - 1) < f["node_id"])))

    return let(flagged, outermost)


def cut_totals(cuts: Column) -> Column:
    """Where the cuts start, and the running totals of their text and blocks: what is inside any element follows."""
    add = lambda a, b: F.struct(*[(a[name] + b[name]).alias(name) for name in ("chars", "runs", "blocks")])
    own = F.transform(cuts, lambda c: F.struct(c["chars"].alias("chars"), c["runs"].alias("runs"), c["blocks"].alias("blocks")))
    return F.struct(F.transform(cuts, lambda c: c["node_id"]).alias("starts"), running(own, add).alias("sums"))


def without(nodes: Column, cuts: Column) -> Column:
    """The nodes outside all cuts: the slices between them."""

    def slices(c: Column) -> Column:
        gaps = F.transform(
            c,
            lambda cut, i: F.slice(
                nodes,
                F.when(i == 0, F.lit(1)).otherwise(F.get(c, i - 1)["end_id"] + 2),
                cut["node_id"] - F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1)["end_id"] + 1),
            ),
        )
        start = F.element_at(c, -1)["end_id"] + 2
        tail = F.slice(nodes, start, F.greatest(F.size(nodes) - start + 1, F.lit(0)))
        return F.concat(F.flatten(gaps), tail)

    return F.when(F.size(cuts) == 0, nodes).otherwise(slices(cuts))


def strip_boilerplate(parsed: DataFrame, mode: str = "main") -> DataFrame:
    """Adds ``cuts`` and ``kept`` (nodes that are no boilerplate)."""
    return parsed.withColumn("cuts", boilerplate_cuts(F.col("nodes"), check_mode(mode))).withColumn(
        "kept", without(F.col("nodes"), F.col("cuts"))
    )


def _remaining(node: Column, totals: Column) -> Column:
    """Text length and block count of an element once the cuts inside it are gone; ``totals`` as of ``cut_totals``."""

    def up_to(limit: Column) -> Column:
        nothing = F.struct(*[F.lit(0).alias(name) for name in ("chars", "runs", "blocks")])
        return F.coalesce(F.get(totals["sums"], count_up_to(totals["starts"], limit) - 1), nothing)

    def left(before: Column, inside: Column) -> Column:
        chars, runs, blocks = (node[name] - (inside[name] - before[name]) for name in ("chars", "runs", "blocks"))
        # Runs are joined by single spaces.
        return F.struct((chars + F.greatest(runs - 1, F.lit(0))).alias("length"), blocks.alias("blocks"))

    return let(up_to(node["node_id"]), lambda before: let(up_to(node["end_id"]), lambda inside: left(before, inside)))


def substantial(node: Column, totals: Column) -> Column:
    """Enough text and a paragraph, heading or list item below."""
    # Cuts only shrink a subtree, so most elements are settled by their totals.
    possible = (node["chars"] + node["runs"] > rules.SUBSTANTIAL_LENGTH) & (node["blocks"] > 0)
    return F.when(
        possible,
        let(
            _remaining(node, totals), lambda s: (s["length"] >= rules.SUBSTANTIAL_LENGTH) & (s["blocks"] > 0)
        ),
    ).otherwise(F.lit(False))


def substantial_elements(stripped: DataFrame) -> DataFrame:
    """C3 as rows: text length and verdict of every remaining element."""
    elements = F.filter("kept", lambda n: ~n["tag"].startswith("#"))

    def rows(totals: Column) -> Column:
        return F.transform(
            elements,
            lambda n: F.struct(
                n["node_id"].alias("node_id"),
                n["tag"].alias("tag"),
                _remaining(n, totals)["length"].alias("text_length"),
                substantial(n, totals).alias("substantial"),
            ),
        )

    return stripped.select("job_id", "page_id", F.inline(let(cut_totals(F.col("cuts")), rows)))


def _container(nodes: Column, kept: Column, cuts: Column) -> Column:
    """C4: by selector priority, else the longest div or section, else body."""
    return let(cut_totals(cuts), lambda totals: _best_container(nodes, kept, totals))


def _best_container(nodes: Column, kept: Column, totals: Column) -> Column:
    marked = F.filter(kept, lambda n: N.matches_any(n, rules.CONTAINER_SELECTORS))

    def by_selector(found: Column) -> Column:
        # Only the first match of each selector is looked at.
        def first_of(selector: tuple[str, str]) -> Column:
            return N.first(F.filter(found, lambda n: N.matches(n, selector)))

        firsts = F.array(*[first_of(selector) for selector in rules.CONTAINER_SELECTORS])
        return N.first(F.filter(firsts, lambda n: n.isNotNull() & substantial(n, totals)))

    scored = F.transform(
        F.filter(kept, lambda n: n["tag"].isin("div", "section") & substantial(n, totals)),
        lambda n: F.struct(_remaining(n, totals)["length"].alias("length"), (-n["node_id"]).alias("back")),
    )
    longest = let(
        F.array_max(scored), lambda best: F.when(best.isNotNull(), F.get(nodes, -best["back"]))
    )
    body = N.first(F.filter(kept, lambda n: n["tag"] == "body"))
    return F.coalesce(let(marked, by_selector), longest, body)


@cached_expression
def _container_of_columns() -> Column:
    return _container(F.col("nodes"), F.col("kept"), F.col("cuts"))


def primary_container(stripped: DataFrame) -> DataFrame:
    """C4: adds ``container``, the chosen node; NULL stands for the whole document."""
    return stripped.withColumn("container", _container_of_columns())


def extract_content(parsed: DataFrame, mode: str = "main") -> DataFrame:
    """C5 for one mode: adds ``content`` (nodes of the chosen part) and ``container_id`` (-1: all)."""
    mode = check_mode(mode)
    if mode == "raw":
        return parsed.withColumn("container_id", F.lit(-1)).withColumn("content", F.col("nodes"))
    chosen = primary_container(strip_boilerplate(parsed, mode))
    inside = F.filter(
        "kept",
        lambda n: (n["node_id"] >= F.col("container.node_id")) & (n["node_id"] <= F.col("container.end_id")),
    )
    # Without even a body, the page passes unchanged, boilerplate included.
    return (
        chosen.withColumn("content", F.when(F.col("container").isNull(), F.col("nodes")).otherwise(inside))
        .withColumn("container_id", F.coalesce("container.node_id", F.lit(-1)))
        .drop("cuts", "kept", "container")
    )


@cached_expression
def _content_by_mode() -> Column:
    nodes = F.col("nodes")

    def chosen(mode: str) -> Column:
        def build(cuts: Column) -> Column:
            return let(
                without(nodes, cuts),
                lambda kept: let(
                    _container(nodes, kept, cuts),
                    lambda c: F.struct(
                        F.coalesce(c["node_id"], F.lit(-1)).alias("container_id"),
                        F.when(c.isNull(), nodes)
                        .otherwise(F.filter(kept, lambda n: (n["node_id"] >= c["node_id"]) & (n["node_id"] <= c["end_id"])))
                        .alias("content"),
                    ),
                ),
            )

        return let(boilerplate_cuts(nodes, mode), build)

    return (
        F.when(F.col("_mode") == "raw", F.struct(F.lit(-1).alias("container_id"), nodes.alias("content")))
        .when(F.col("_mode") == "main", chosen("main"))
        .otherwise(chosen("aggressive"))
    )


def extract_job_content(parsed: DataFrame, jobs: DataFrame, options: tuple[str, ...] = ()) -> DataFrame:
    """C5 with each job's own mode, and further columns of the job. An unknown mode fails the run.

    Pages of a job that is not in the table take no part.
    """
    dimension = jobs.select(
        "job_id", F.lower(F.trim(F.when(F.col("content_extraction") == "", "main").otherwise(F.col("content_extraction")))).alias("_mode"), *options
    )
    marked = join_dimension(parsed, dimension, ["job_id"], ["page_id"]).withColumn(
        "_mode",
        F.when(F.col("_mode").isin(list(rules.CONTENT_MODES)), F.col("_mode")).otherwise(
            F.raise_error(F.concat(F.lit("unknown content mode "), F.col("_mode")))
        ),
    )
    return (
        marked.withColumn("_picked", _content_by_mode())
        .withColumn("container_id", F.col("_picked.container_id"))
        .withColumn("content", F.col("_picked.content"))
        .drop("_picked", "_mode")
    )


def content_text(extracted: DataFrame) -> DataFrame:
    """C6 of the chosen part."""
    return extracted.select("job_id", "page_id", "container_id", N.text_of(F.col("content")).alias("text"))
