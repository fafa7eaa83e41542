"""JSON-LD of a page as an array of VARIANT objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.nodes import attr
from pagemill.functions.text import let, no_strings, non_empty, strip


def _variants(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<variant>"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is_object(value: Column) -> Column:
    # Looks at the value's own fields only; its schema would walk all of it.
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _graph(value: Column) -> Column:
    return F.try_variant_get(value, "$['@graph']", "array<variant>")


def _flatten_step(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda v: F.coalesce(_list(v), _graph(v), F.array(v))))


def _foldable(values: Column) -> Column:
    return F.exists(values, lambda v: _list(v).isNotNull() | _graph(v).isNotNull())


def _brackets(written: Column) -> Column:
    return F.length(written) - F.length(F.replace(written, F.lit("["), F.lit("")))


def _repeat(values: Column, bound: Column, step: Callable[[Column], Column], unfinished: Callable[[Column], Column]) -> Column:
    """``step`` until nothing is ``unfinished``, ``bound`` times at most.

    The flag beside the values ends the work: later rounds hand the state on
    without looking at it, so the cost is that of the nesting depth.
    """

    def state(found: Column) -> Column:
        return let(found, lambda v: F.struct(v.alias("found"), unfinished(v).alias("open")))

    ended = F.aggregate(
        F.sequence(F.lit(1), bound + 1),
        state(values),
        lambda acc, _: F.when(acc["open"], state(step(acc["found"]))).otherwise(acc),
    )
    return ended["found"]


def script_texts(nodes: Column) -> Column:
    """Trimmed, non-empty texts of the JSON-LD scripts in document order."""
    scripts = F.filter(
        nodes,
        lambda n: (n["tag"] == "script")
        & F.coalesce(attr(n, "type") == "application/ld+json", F.lit(False))
        & (n["end_id"] > n["node_id"]),
    )
    return F.array_compact(F.transform(scripts, lambda n: non_empty(F.get(nodes, n["node_id"] + 1)["text"])))


def jsonld_objects(nodes: Column) -> Column:
    """Objects of all scripts, lists and ``@graph`` lists opened recursively.

    A list or graph can only open after a ``[``, so their number bounds the
    rounds; only as many as lists are nested do any work.
    """

    def flat(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        opened = let(parsed, lambda v: _repeat(F.array(v), _brackets(text), _flatten_step, _foldable))
        return F.when(parsed.isNotNull(), opened).otherwise(F.array().cast("array<variant>"))

    return F.filter(F.flatten(F.transform(script_texts(nodes), flat)), _is_object)


def _path(dotted: str) -> str:
    return "$" + "".join(f"['{part}']" for part in dotted.split("."))


def values(objects: Column, dotted: str) -> Column:
    """Values at a dotted path of every object, lists opened one level."""
    found = F.filter(
        F.transform(objects, lambda o: F.try_variant_get(o, _path(dotted), "variant")),
        lambda v: v.isNotNull() & (_kind(v) != "VOID"),
    )
    return F.flatten(F.transform(found, lambda v: F.coalesce(_list(v), F.array(v))))


def text(value: Column) -> Column:
    """The string a variant holds; NULL for numbers, objects and so on."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _name(value: Column) -> Column:
    return F.when(
        _is_object(value), text(F.try_variant_get(value, "$.name", "variant"))
    )


def strings(objects: Column, dotted: str) -> Column:
    """Only the string values at a path."""
    return F.array_compact(F.transform(values(objects, dotted), lambda v: non_empty(text(v))))


def first_text(objects: Column, dotted: str) -> Column:
    """First string, or name of an object, at a path."""
    found = F.transform(values(objects, dotted), lambda v: F.coalesce(non_empty(text(v)), non_empty(_name(v))))
    return F.get(F.array_compact(found), F.lit(0))


def names(objects: Column, dotted: str) -> Column:
    """Strings and names of objects at a path, lists opened at any depth."""

    def opened(found: Column) -> Column:
        written = F.array_join(F.transform(found, lambda v: F.coalesce(F.to_json(v), F.lit(""))), "")
        return _repeat(
            found,
            _brackets(written),
            lambda acc: F.flatten(F.transform(acc, lambda v: F.coalesce(_list(v), F.array(v)))),
            lambda acc: F.exists(acc, lambda v: _list(v).isNotNull()),
        )

    flat = let(values(objects, dotted), opened)
    return F.array_compact(F.transform(flat, lambda v: F.coalesce(non_empty(text(v)), non_empty(_name(v)))))


def types(objects: Column) -> Column:
    """``@type`` values in order, a list of types counting as its members."""
    def of(value: Column) -> Column:
        listed = F.transform(_list(value), lambda v: v.cast("string"))
        single = text(value)
        return F.coalesce(
            F.filter(listed, lambda s: s.isNotNull() & (s != "")),
            F.when(single.isNotNull(), F.array(single)),
            no_strings(),
        )

    return F.flatten(F.transform(objects, lambda o: of(F.try_variant_get(o, "$['@type']", "variant"))))


def breadcrumbs(objects: Column) -> Column:
    """Names of the first BreadcrumbList with any, ordered by position (stable)."""

    def is_list(o: Column) -> Column:
        kind = F.try_variant_get(o, "$['@type']", "variant")
        found = F.coalesce(_list(kind), F.when(kind.isNotNull(), F.array(kind)), F.array().cast("array<variant>"))
        return F.exists(found, lambda v: F.coalesce(F.lower(v.cast("string")) == "breadcrumblist", F.lit(False)))

    def name_of(item: Column) -> Column:
        inner = F.try_variant_get(item, "$.item.name", "variant")
        outer = F.try_variant_get(item, "$.name", "variant")
        empty = inner.isNull() | (_kind(inner) == "VOID") | F.coalesce(text(inner) == "", F.lit(False))
        return non_empty(F.when(empty, text(outer)).otherwise(text(inner)))

    def position_of(item: Column) -> Column:
        position = F.try_variant_get(item, "$.position", "variant")
        kind = _kind(position)
        # Whole numbers and digits count as they are, fractions lose their fraction.
        number = F.try_variant_get(position, "$", "double")
        return F.when(kind == "STRING", F.when(strip(text(position)).rlike(r"\A[+-]?\d+\z"), strip(text(position)).try_cast("bigint"))).when(
            number.isNotNull(), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        )

    def ordered(o: Column) -> Column:
        items = _variants(_list(F.try_variant_get(o, "$.itemListElement", "variant")))
        named = F.filter(
            F.transform(
                F.filter(items, _is_object),
                lambda v: F.struct(position_of(v).alias("pos"), name_of(v).alias("name")),
            ),
            lambda r: r["name"].isNotNull(),
        )
        ranked = F.transform(
            named, lambda r, i: F.struct(F.coalesce(r["pos"], (i + 1).cast("bigint")).alias("pos"), i.alias("i"), r["name"].alias("name"))
        )
        return F.transform(F.sort_array(ranked), lambda r: r["name"])

    lists = F.transform(F.filter(objects, is_list), ordered)
    return F.get(F.filter(lists, lambda names_: F.size(names_) > 0), F.lit(0))


def jsonld_nodes(parsed: DataFrame) -> DataFrame:
    """X2 as rows: one per JSON-LD object."""
    return parsed.select("job_id", "page_id", F.posexplode(jsonld_objects(F.col("nodes"))).alias("pos", "object"))


def jsonld_values(parsed: DataFrame, dotted: str) -> DataFrame:
    """X3 as rows: one per value at a path."""
    return parsed.select(
        "job_id", "page_id", F.posexplode(values(jsonld_objects(F.col("nodes")), dotted)).alias("pos", "value")
    )
