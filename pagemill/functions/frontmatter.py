"""YAML frontmatter and whole documents as string expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import rules
from pagemill.functions.text import strip

_SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quote(value: Column) -> Column:
    """JSON string literal that leaves non-ASCII characters as they are."""
    basic = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = [chr(code) for code in range(0x20)]
    escaped = reduce(
        lambda text, char: F.replace(text, F.lit(char), F.lit(_SHORT_ESCAPES.get(char, f"\\u{ord(char):04x}"))),
        controls,
        basic,
    )
    body = F.when(value.rlike(r"[\x00-\x1f]"), escaped).otherwise(basic)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _render(value: Column, kind: T.DataType) -> Column:
    """Rendered text of one value; lists and maps span lines, NULL stays NULL."""
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    if isinstance(kind, T.StringType):
        return quote(value)
    if isinstance(kind, T.ArrayType):
        items = F.array_compact(F.transform(value, lambda item: _render(item, kind.elementType)))
        lines = F.transform(items, lambda item: F.concat(F.lit("- "), F.regexp_replace(item, "\n", "\n  ")))
        return F.when(F.size(value) == 0, F.lit("[]")).otherwise(F.array_join(lines, "\n"))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        lines = F.transform(
            F.filter(entries, lambda e: e["value"].isNotNull()),
            lambda e: F.concat(e["key"], F.lit(": "), _render(e["value"], kind.valueType)),
        )
        return F.when(F.size(value) == 0, F.lit("{}")).otherwise(F.array_join(lines, "\n"))
    return value.cast("string")


def ordered_fields(names: Sequence[str]) -> list[str]:
    known = [name for name in rules.FRONTMATTER_FIELDS if name in names]
    return known + sorted(name for name in names if name not in rules.FRONTMATTER_FIELDS)


def frontmatter(metadata: Column, schema: T.StructType, strict_yaml: bool = False) -> Column:
    """A YAML block of the struct's fields, the known ones first.

    A one-item list renders on its key's line, as published; ``strict_yaml``
    writes it as a proper block instead.
    """

    def line(name: str) -> Column:
        kind = schema[name].dataType
        rendered = _render(metadata[name], kind)
        block = F.concat(F.lit(f"{name}:\n  "), F.regexp_replace(rendered, "\n", "\n  "))
        inline = F.concat(F.lit(f"{name}: "), rendered)
        as_block = rendered.contains("\n")
        if strict_yaml and isinstance(kind, (T.ArrayType, T.MapType)):
            as_block = F.size(metadata[name]) > 0
        return F.when(as_block, block).otherwise(inline)

    lines = [line(name) for name in ordered_fields(schema.names)]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def render_document(front: Column, body: Column) -> Column:
    """Frontmatter, blank line, trimmed body, newline."""
    text = strip(body)
    return F.when(front == "", F.concat(text, F.lit("\n"))).otherwise(
        F.concat(front, F.lit("\n\n"), text, F.lit("\n"))
    )
