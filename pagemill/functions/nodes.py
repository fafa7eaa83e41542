"""Expressions over a node array (see ``sources.html_tree``)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import non_empty

TEXT = "#text"


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def tokens(node: Column, name: str) -> Column:
    """White-space separated tokens of an attribute such as class or rel."""
    return F.coalesce(F.split(attr(node, name), r"[\s]+"), F.array().cast("array<string>"))


def has_token(node: Column, name: str, token: str) -> Column:
    padded = F.concat(F.lit(" "), F.translate(attr(node, name), "\t\n\x0b\x0c\r", "     "), F.lit(" "))
    return F.coalesce(padded.contains(f" {token} "), F.lit(False))


def with_tag(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(list(tags)))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def subtree(nodes: Column, node: Column) -> Column:
    """Slice of the complete array that is ``node`` and everything below it."""
    return F.slice(nodes, node["node_id"] + 1, node["end_id"] - node["node_id"] + 1)


def text_of(nodes: Column) -> Column:
    """Visible text runs, trimmed, non-empty, joined by one space."""
    runs = F.transform(F.filter(nodes, lambda n: n["tag"] == TEXT), lambda n: non_empty(n["text"]))
    return F.array_join(F.filter(runs, lambda r: r.isNotNull()), " ")


def node_text(nodes: Column, node: Column) -> Column:
    """Text of one node of the complete array; NULL without node or text."""
    return F.when(node.isNotNull(), F.nullif(text_of(subtree(nodes, node)), F.lit("")))


def _matches(node: Column, kind: str, value: str) -> Column:
    if kind == "tag":
        return node["tag"] == value
    if kind == "class":
        return has_token(node, "class", value)
    if kind == "label":
        return F.coalesce(F.lower(attr(node, "aria-label")).contains(value), F.lit(False))
    if kind == "testid":
        return F.coalesce(F.lower(attr(node, "data-testid")).contains(value), F.lit(False))
    return F.coalesce(attr(node, kind) == value, F.lit(False))


def matches(node: Column, selector: tuple[str, str]) -> Column:
    """One simple selector: tag, class token, id, role, or aria-label part."""
    return _matches(node, *selector)


def matches_any(node: Column, selectors: Iterable[tuple[str, str]]) -> Column:
    """Any of many simple selectors, grouped so each attribute is read once."""
    grouped: dict[str, list[str]] = {}
    for kind, value in selectors:
        grouped.setdefault(kind, []).append(value)
    tests = []
    for kind, values in grouped.items():
        if kind == "tag":
            tests.append(node["tag"].isin(values))
        elif kind == "class":
            tests.append(
                F.coalesce(F.arrays_overlap(tokens(node, "class"), F.array(*[F.lit(v) for v in values])), F.lit(False))
            )
        elif kind == "label":
            tests.extend(_matches(node, kind, value) for value in values)
        else:
            tests.append(F.coalesce(attr(node, kind).isin(values), F.lit(False)))
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    # Text runs carry no attributes: skip the lookups for them.
    return ~node["tag"].startswith("#") & result
