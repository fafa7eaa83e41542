"""Markdown and HTML text of a node array.

Every node gives a fragment where it opens and one where its subtree ends. The
fragments of a page are put in order by one array sort and joined; what depends
on neighbours (white space at block edges, emphasis around blanks) is settled by
a few regex passes over the joined text.

Subset: headings (h1 and h2 underlined), paragraphs, links, images, strong,
emphasis, strike, code, pre, nested lists, quotes, tables, rules, line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import nodes as N
from pagemill.functions.text import cached_expression, let, strip

# Marks from the private use area, replaced before the text is returned.
_BLOCK, _LINE, _KEEP, _SPACE = "\ue000", "\ue001", "\ue002", "\ue003"
_OPEN, _CLOSE = "\ue004", "\ue005"
_PARAGRAPHS = (
    "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "ul", "ol", "dl",
    "blockquote", "pre", "figure", "form", "address", "fieldset", "h1", "h2", "h3", "h4", "h5", "h6", "title",
)
_LINES = ("li", "tr", "dt", "dd", "caption", "figcaption")
_EMPHASIS = {
    "b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`",
}
_BULLETS = ("*", "+", "-")


def _prefix(node: Column, quotes: Column, lists: Column) -> Column:
    """Line prefix of a block: quote signs and list indentation."""
    depth = F.greatest(lists, F.lit(0))
    return F.concat(
        F.repeat(F.lit(f">{_SPACE}"), F.greatest(quotes, F.lit(0))), F.repeat(F.lit(_SPACE * 2), depth)
    )


def _emphasis(node: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for pair in _EMPHASIS.items() for v in pair])
    return F.try_element_at(pairs, node["tag"])


def _text_fragment(node: Column) -> Column:
    escaped = F.regexp_replace(node["text"], r"([*_])", r"\\$1")
    collapsed = F.regexp_replace(escaped, r"[ \t\r\n\f]+", " ")
    # Preformatted text keeps its blanks through the clean-up.
    raw = F.replace(F.replace(node["text"], F.lit("\n"), F.lit(_KEEP)), F.lit(" "), F.lit(_SPACE))
    return F.when(node["pre"] > 0, raw).otherwise(collapsed)


def _markdown_fragments(nodes: Column, content: Column, base: Column) -> Column:
    """``array<struct<at,kind,back,text>>`` of all fragments."""

    def parent_tag(n: Column) -> Column:
        return F.when(n["parent_id"] >= 0, F.get(nodes, F.greatest(n["parent_id"], F.lit(0)))["tag"]).otherwise("")

    def opening(n: Column) -> Column:
        tag = n["tag"]
        lists, quotes = n["lists"] - base["lists"], n["quotes"] - base["quotes"]
        prefix = _prefix(n, quotes, lists)
        first_number = F.coalesce(
            N.attr(F.get(nodes, F.greatest(n["parent_id"], F.lit(0))), "start").try_cast("int"), F.lit(1)
        )
        bullet = F.get(F.array(*[F.lit(b) for b in _BULLETS]), F.pmod(F.greatest(lists - 1, F.lit(0)), F.lit(3)))
        marker = F.when(
            parent_tag(n) == "ol", F.concat((first_number + n["ordinal"] - 1).cast("string"), F.lit("."))
        ).otherwise(bullet)
        item_prefix = _prefix(n, quotes, lists - 1)
        title = F.when(
            F.coalesce(N.attr(n, "title"), F.lit("")) != "",
            F.concat(F.lit(' "'), F.replace(N.attr(n, "title"), F.lit('"'), F.lit('\\"')), F.lit('"')),
        ).otherwise("")
        image = F.concat(
            F.lit("!["), F.coalesce(N.attr(n, "alt"), F.lit("")), F.lit("]("),
            F.coalesce(N.attr(n, "src"), F.lit("")), title, F.lit(")"),
        )
        return (
            F.when(tag == "#text", _text_fragment(n))
            .when(tag.startswith("#"), "")
            .when(tag == "br", F.concat(F.lit(_SPACE * 2 + _LINE), prefix))
            .when(tag == "hr", F.concat(F.lit(_BLOCK), prefix, F.lit("---" + _BLOCK)))
            .when(tag == "img", image)
            .when(tag == "li", F.concat(F.lit(_LINE), item_prefix, marker, F.lit(_SPACE)))
            .when(tag == "pre", F.concat(F.lit(_BLOCK), prefix, F.lit("```" + _KEEP)))
            .when(tag.isin("ul", "ol"), F.when(lists > 0, F.lit("")).otherwise(F.lit(_BLOCK)))
            .when(tag == "blockquote", F.concat(F.lit(_BLOCK), _prefix(n, quotes + 1, lists)))
            .when(tag.rlike(r"\Ah[3-6]\z"), F.concat(F.lit(_BLOCK), prefix, F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(_SPACE)))
            # The first block of a list item or quote stays on the marker's line.
            .when(
                tag.isin(list(_PARAGRAPHS)),
                F.when(parent_tag(n).isin("li", "blockquote") & (n["node_id"] == n["parent_id"] + 1), F.lit(""))
                .otherwise(F.concat(F.lit(_BLOCK), prefix)),
            )
            .when(tag == "tr", F.concat(F.lit(_LINE), prefix, F.lit("|")))
            .when(tag.isin("td", "th"), F.lit(_SPACE))
            .when(tag.isin(list(_LINES)), F.concat(F.lit(_LINE), prefix))
            .when(_emphasis(n).isNotNull() & (n["pre"] == 0), F.concat(F.lit(_OPEN), _emphasis(n), F.lit(_CLOSE)))
            .when((tag == "a") & (F.coalesce(N.attr(n, "href"), F.lit("")) != "") & (n["pre"] == 0), "[")
            .otherwise("")
        )

    def closing(n: Column) -> Column:
        tag = n["tag"]
        lists, quotes = n["lists"] - base["lists"], n["quotes"] - base["quotes"]
        prefix = _prefix(n, quotes, lists)
        # Underline as long as the heading's text.
        width = F.length(F.regexp_replace(F.regexp_replace(N.node_text(nodes, n), r"([*_])", r"\\$1"), r"\s+", " "))
        underline = F.when(
            width > 0,
            F.concat(F.lit(_LINE), prefix, F.repeat(F.when(tag == "h1", "=").otherwise("-"), F.coalesce(width, F.lit(0))), F.lit(_BLOCK)),
        ).otherwise(F.lit(_BLOCK))
        title = F.when(
            F.coalesce(N.attr(n, "title"), F.lit("")) != "",
            F.concat(F.lit(' "'), F.replace(N.attr(n, "title"), F.lit('"'), F.lit('\\"')), F.lit('"')),
        ).otherwise("")
        # The first row of a table is its head.
        cells = F.size(F.filter(N.subtree(nodes, n), lambda c: c["tag"].isin("td", "th") & (c["parent_id"] == n["node_id"])))
        rule = F.when(
            (n["ordinal"] == 1) & (parent_tag(n) != "tbody") | ((parent_tag(n) == "tbody") & (n["ordinal"] == 1)
            & (F.get(nodes, F.greatest(n["parent_id"], F.lit(0)))["ordinal"] == 1)
            & ~F.exists(F.filter(nodes, lambda h: h["tag"] == "thead"), lambda h: h["parent_id"] == F.get(nodes, F.greatest(n["parent_id"], F.lit(0)))["parent_id"])),
            F.concat(F.lit(_LINE), prefix, F.lit("|" + _SPACE), F.array_join(F.array_repeat(F.lit("---"), cells), f"{_SPACE}|{_SPACE}"), F.lit(_SPACE + "|")),
        ).otherwise("")
        return (
            F.when(tag.startswith("#") | tag.isin(list(rules.VOID_TAGS)), "")
            .when(tag.isin("h1", "h2"), underline)
            .when(tag == "pre", F.concat(F.lit(_KEEP), prefix, F.lit("```" + _BLOCK)))
            .when(tag.isin("td", "th"), F.lit(_SPACE + "|"))
            .when(tag == "tr", rule)
            .when(tag.isin("ul", "ol"), F.when(lists > 0, F.lit("")).otherwise(F.lit(_BLOCK)))
            .when(tag.isin(list(_PARAGRAPHS)), F.lit(_BLOCK))
            .when(tag.isin(list(_LINES)), F.lit(_LINE))
            .when(_emphasis(n).isNotNull() & (n["pre"] == 0), F.concat(F.lit(_CLOSE), _emphasis(n), F.lit(_OPEN)))
            .when(
                (tag == "a") & (F.coalesce(N.attr(n, "href"), F.lit("")) != "") & (n["pre"] == 0),
                F.concat(F.lit("]("), N.attr(n, "href"), title, F.lit(")")),
            )
            .otherwise("")
        )

    return _ordered(content, opening, closing)


def _ordered(content: Column, opening, closing) -> Column:
    """Opening and closing fragments of all nodes in reading order."""
    opens = F.transform(
        content,
        lambda n: F.struct(n["node_id"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("back"), opening(n).alias("text")),
    )
    # All closings at one place come after its opening, the innermost first.
    closes = F.transform(
        F.filter(content, lambda n: ~n["tag"].startswith("#")),
        lambda n: F.struct(n["end_id"].alias("at"), F.lit(1).alias("kind"), (-n["node_id"]).alias("back"), closing(n).alias("text")),
    )
    return F.transform(F.sort_array(F.concat(opens, closes)), lambda f: f["text"])


def _tidy(text: Column) -> Column:
    passes = (
        # Blanks inside emphasis move outside, empty emphasis vanishes.
        (f"{_OPEN}([*~`]+){_CLOSE}([ {_BLOCK}{_LINE}]*){_CLOSE}\\1{_OPEN}", "$2"),
        (f"{_OPEN}([*~`]+){_CLOSE}([ {_BLOCK}{_LINE}]+)", "$2$1"),
        (f"([ {_BLOCK}{_LINE}]+){_CLOSE}([*~`]+){_OPEN}", "$2$1"),
        (f"[{_OPEN}{_CLOSE}]", ""),
        # An empty link leaves its blanks only.
        (r"(?<!!)\[( *)\]\([^)]*\)", "$1"),
        (r"(?<!!)\[( +)", "$1["),
        (r"( +)\]\(([^)]*)\)", "]($2)$1"),
        # No blanks at block edges; neighbouring breaks melt into one.
        (f" *([{_BLOCK}{_LINE}]) *", "$1"),
        (f"{_LINE}*{_BLOCK}[{_BLOCK}{_LINE}]*", "\n\n"),
        (f"{_LINE}+", "\n"),
        (" {2,}", " "),
        (_KEEP, "\n"),
        (_SPACE, " "),
        (r"(?m)^((?:> |  )*> ?)\n\n((?:> ?)+)", "$2"),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, replacement in passes:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def markdown_text(nodes: Column, content: Column, container_id: Column) -> Column:
    """Markdown of ``content``, a part of the page's ``nodes``."""
    root = F.when(container_id >= 0, F.get(nodes, F.greatest(container_id, F.lit(0))))
    base = F.struct(F.coalesce(root["lists"], F.lit(0)).alias("lists"), F.coalesce(root["quotes"], F.lit(0)).alias("quotes"))
    return let(base, lambda b: _tidy(F.array_join(_markdown_fragments(nodes, content, b), "")))


@cached_expression
def _markdown_of_columns() -> Column:
    return markdown_text(F.col("nodes"), F.col("content"), F.col("container_id"))


def to_markdown(extracted: DataFrame) -> DataFrame:
    """Adds ``markdown``."""
    return extracted.withColumn("markdown", _markdown_of_columns())


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_text(content: Column) -> Column:
    """HTML text of a node array (comments left out)."""

    def opening(n: Column) -> Column:
        attrs = F.transform(
            F.map_entries(n["attrs"]),
            lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(_escape(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"')),
        )
        return (
            F.when(n["tag"] == "#text", _escape(n["text"]))
            .when(n["tag"] == "#hidden", n["text"])
            .when(n["tag"].startswith("#"), "")
            .otherwise(
                F.concat(
                    F.lit("<"), n["tag"], F.array_join(attrs, ""),
                    F.when(n["tag"].isin(list(rules.VOID_TAGS)), "/>").otherwise(">"),
                )
            )
        )

    def closing(n: Column) -> Column:
        return F.when(n["tag"].isin(list(rules.VOID_TAGS)), "").otherwise(F.concat(F.lit("</"), n["tag"], F.lit(">")))

    return F.array_join(_ordered(content, opening, closing), "")
