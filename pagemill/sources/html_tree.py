"""HTML text to a table of nodes.

The only step that needs Python: a streaming tokenizer from the standard library
and a stack. Everything that interprets the tree is a Spark expression.

A page's nodes stay together in one array column, in document order. ``node_id``
is the index in that array and ``end_id`` the index of the last node of the
subtree, so a subtree is a slice and "is inside" a comparison; per-page work
then needs no shuffle at all. ``html_nodes`` gives the same as rows.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagemill.functions.text import col
from pagemill.rules import HIDDEN_TEXT_TAGS, SUBSTANTIAL_TAGS, VOID_TAGS

TEXT = "#text"
HIDDEN = "#hidden"
COMMENT = "#comment"

# chars/runs/blocks describe the subtree: characters and number of its visible
# non-blank text runs, number of block tags below the node. lists/quotes/pre are
# open ul+ol, blockquote and pre ancestors; ordinal counts same-tag siblings.
_INTEGER, _STRING = T.IntegerType(), T.StringType()
_FIELDS = {
    "node_id": _INTEGER, "end_id": _INTEGER, "parent_id": _INTEGER, "depth": _INTEGER,
    "tag": _STRING, "attrs": T.MapType(_STRING, _STRING), "text": _STRING,
    "chars": _INTEGER, "runs": _INTEGER, "blocks": _INTEGER, "ordinal": _INTEGER,
    "lists": _INTEGER, "quotes": _INTEGER, "pre": _INTEGER,
}
NODES_TYPE = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _FIELDS.items()]))
_INTS = tuple(name for name, kind in _FIELDS.items() if kind == _INTEGER)


class _TreeBuilder(HTMLParser):
    """Appends the nodes of one document to shared column lists."""

    def __init__(self, columns: dict[str, list], base: int) -> None:
        super().__init__(convert_charrefs=False)
        self.columns, self.base = columns, base
        self.stack: list[int] = []  # absolute positions of open elements
        self.open_tags: dict[str, int] = {}
        self.counters: list[dict[str, int]] = [{}]  # per open element: tag -> siblings so far
        self.buffer: list[str] = []
        self.chars = self.runs = self.blocks = 0

    def _add(self, tag: str, attrs: dict[str, str], text: str | None, ordinal: int) -> int:
        c, position = self.columns, len(self.columns["tag"])
        c["node_id"].append(position - self.base)
        c["end_id"].append(position - self.base)
        c["parent_id"].append(self.stack[-1] - self.base if self.stack else -1)
        c["depth"].append(len(self.stack))
        c["tag"].append(tag)
        c["attrs"].append(list(attrs.items()))
        c["text"].append(text)
        c["ordinal"].append(ordinal)
        c["lists"].append(self.open_tags.get("ul", 0) + self.open_tags.get("ol", 0))
        c["quotes"].append(self.open_tags.get("blockquote", 0))
        c["pre"].append(self.open_tags.get("pre", 0) + self.open_tags.get("textarea", 0))
        for name in ("chars", "runs", "blocks"):
            c[name].append(getattr(self, name))
        return position

    def _flush(self) -> None:
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer.clear()
        if not text.strip("\t\n\x0b\x0c\r ") and not (self.open_tags.get("pre") or self.open_tags.get("textarea")):
            text = "\n" if "\n" in text else " "
        hidden = any(self.open_tags.get(tag) for tag in HIDDEN_TEXT_TAGS)
        position = self._add(HIDDEN if hidden else TEXT, {}, text, 0)
        visible = 0 if hidden else len(text.strip())
        self.columns["chars"][position], self.columns["runs"][position] = visible, 1 if visible else 0
        self.columns["blocks"][position] = 0
        self.chars += visible
        self.runs += 1 if visible else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._close_last()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open(tag, attrs)
        self._close_last()

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        siblings = self.counters[-1]
        siblings[tag] = siblings.get(tag, 0) + 1
        if tag in SUBSTANTIAL_TAGS:
            self.blocks += 1
        position = self._add(tag, {k: v or "" for k, v in attrs}, None, siblings[tag])
        self.stack.append(position)
        self.counters.append({})
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def _close_last(self) -> None:
        self._flush()
        position = self.stack.pop()
        self.counters.pop()
        c = self.columns
        self.open_tags[c["tag"][position]] -= 1
        c["end_id"][position] = len(c["tag"]) - 1 - self.base
        for name in ("chars", "runs", "blocks"):
            c[name][position] = getattr(self, name) - c[name][position]

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self.open_tags.get(tag):  # an end tag nothing is open for is ignored
            while self.columns["tag"][self.stack[-1]] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_charref(self, name: str) -> None:
        self.buffer.append(unescape(f"&#{name};") or "�")

    def handle_entityref(self, name: str) -> None:
        known = unescape(f"&{name};")
        self.buffer.append(f"&{name}" if known.endswith(";") and known != ";" else known)

    def handle_comment(self, data: str) -> None:
        self._flush()
        position = self._add(COMMENT, {}, None, 0)
        for name in ("chars", "runs", "blocks"):
            self.columns[name][position] = 0

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def finish(self, html: str) -> None:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # a malformed marked section: keep what was read
            pass
        self._flush()
        while self.stack:
            self._close_last()


@arrow_udf(NODES_TYPE)
def _parse_html(html: pa.Array) -> pa.Array:
    columns: dict[str, list] = {name: [] for name in (*_INTS, "tag", "attrs", "text")}
    offsets = [0]
    for value in html:
        text = value.as_py()
        if text:
            _TreeBuilder(columns, offsets[-1]).finish(text)
        offsets.append(len(columns["tag"]))
    fields = {name: pa.array(columns[name], pa.int32()) for name in _INTS}
    fields["tag"] = pa.array(columns["tag"], pa.string())
    fields["text"] = pa.array(columns["text"], pa.string())
    fields["attrs"] = pa.array(columns["attrs"], pa.map_(pa.string(), pa.string()))
    nodes = pa.StructArray.from_arrays([fields[name] for name in _FIELDS], names=list(_FIELDS))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def html_tree(html: Column | str) -> Column:
    """Node array of an HTML column."""
    return _parse_html(col(html))


def parse_pages(responses: DataFrame) -> DataFrame:
    """Responses with a ``nodes`` array column: one parse that all operators share."""
    return responses.withColumn("nodes", html_tree("html"))


def html_nodes(parsed: DataFrame) -> DataFrame:
    """S2 as rows: one per element, text run and comment."""
    return parsed.select("job_id", "page_id", F.inline("nodes")).drop(
        "chars", "runs", "blocks", "ordinal", "lists", "quotes", "pre"
    )
