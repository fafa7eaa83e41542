"""Small string and array helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Python string counts as white space (fixed value).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def cached_expression(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build a large expression of column names once per JVM.

    Expressions are immutable and unbound, so the same one can serve any number of
    plans; building one anew costs hundreds of calls into the JVM.
    """
    built: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args, **kwargs):
        if kwargs or not all(arg is None or isinstance(arg, (str, bool)) for arg in args):
            return build(*args, **kwargs)
        key = (id(SparkContext._gateway), args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return get


SCAN_STEPS = 24
FEW = 16


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array under an associative ``combine``.

    Each step reaches twice as far back as the one before, and a step that would
    reach behind the start is left out: n log n for any length, nothing is
    appended element by element.
    """

    def step(found: Column, reach: Column) -> Column:
        further = F.transform(found, lambda x, k: F.when(k >= reach, combine(F.get(found, k - reach), x)).otherwise(x))
        return F.when(F.size(found) > reach, further).otherwise(found)

    return F.aggregate(F.array(*[F.lit(1 << power) for power in range(SCAN_STEPS)]), values, step)


def count_up_to(values: Column, limit: Column) -> Column:
    """How many elements of a sorted array are at most ``limit``; a binary search unless there are few."""
    bits = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size(values))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    found = F.aggregate(
        F.reverse(bits),
        F.lit(0),
        lambda place, bit: F.when(F.get(values, place + bit - 1) <= limit, place + bit).otherwise(place),
    )
    return F.when(F.size(values) <= FEW, F.size(F.filter(values, lambda value: value <= limit))).otherwise(found)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Without it every further use of a parsed URL would repeat the whole parse in
    the expression tree.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column | str) -> Column:
    """Trim every kind of white space on both sides, not only U+0020."""
    return F.btrim(col(value), F.lit(WHITESPACE))


def lstrip(value: Column | str) -> Column:
    return F.ltrim(col(value), F.lit(WHITESPACE))


def non_empty(value: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[non_empty(value) for value in values])


def unique_strings(values: Column) -> Column:
    """Trimmed, non-empty, distinct, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(values, non_empty), lambda item: item.isNotNull()))


def split_keywords(value: Column) -> Column:
    parts = F.transform(F.split(value, "[;,]"), non_empty)
    return F.filter(parts, lambda item: item.isNotNull())


def merge_values(*arrays: Column) -> Column:
    """Concatenate arrays, a NULL array counting as empty."""
    return F.concat(*[F.coalesce(array, no_strings()) for array in arrays])


def null_if_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def ends_with_any(value: Column, suffixes: Iterable[str]) -> Column:
    """Literal suffix test against a fixed list."""
    alternatives = "|".join("\\Q" + suffix + "\\E" for suffix in suffixes)
    return value.rlike(f"(?:{alternatives})\\z")


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    alternatives = "|".join("\\Q" + prefix + "\\E" for prefix in prefixes)
    return value.rlike(f"\\A(?:{alternatives})")


def contains_any(value: Column, parts: Iterable[str]) -> Column:
    return value.rlike("|".join("\\Q" + part + "\\E" for part in parts))
