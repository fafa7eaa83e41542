"""Repeated multi-line chunks, cut at content-defined line boundaries. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, free_name, identified, stored
from pagemill.operators.scale import Buckets, hot_keys, join_hot

DIVISOR = 3
MULTIPLIER = 1_000_003
MODULUS = 2_147_483_647
MIN_LINES = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside a function over arrays."""
    return F.transform(F.array(value), body)[0]


def line_chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of chunks, each an array of lines.

    A line's hash is the first 32 bits of its MD5. The rolling hash at a line
    takes that line and the one before; a chunk ends where it is divisible by
    ``divisor``, and with the text. Boundaries depend on two lines only, so they
    move along when lines are put in or taken out elsewhere.
    """

    def line_hash(line: Column) -> Column:
        return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")

    def cut(lines: Column) -> Column:
        return let(F.transform(lines, line_hash), lambda hashes: chunks(lines, hashes))

    def chunks(lines: Column, hashes: Column) -> Column:
        def ends_here(place: Column) -> Column:
            rolling = (F.coalesce(F.get(hashes, place - 1), F.lit(0)) * MULTIPLIER + F.get(hashes, place)) % MODULUS
            return (rolling % divisor == 0) | (place == F.size(lines) - 1)

        def slices(ends: Column) -> Column:
            def one(end: Column, number: Column) -> Column:
                start = F.coalesce(F.get(ends, number - 1), F.lit(-1)) + 1
                return F.slice(lines, start + 1, end - start + 1)

            return F.transform(ends, one)

        return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), ends_here), slices)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def _is_multi_line(chunk: Column) -> Column:
    return F.size(F.filter(chunk, lambda line: line != "")) >= MIN_LINES


def _bodies(texts: DataFrame, wanted: DataFrame, divisor: int) -> DataFrame:
    """``wanted`` chunks ``doc_id, place, ...`` with their ``body``; the places go to the texts."""
    others = [name for name in wanted.columns if name != "doc_id"]
    listed = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("wanted"))
    found = texts.join(listed, "doc_id").select("doc_id", "wanted", line_chunks(F.col("text"), divisor).alias("chunks"))
    each = F.transform("wanted", lambda w: F.struct(w.alias("w"), F.array_join(F.get(F.col("chunks"), w["place"]), "\n").alias("body")))
    return found.select("doc_id", F.inline(each)).select("doc_id", *[F.col(f"w.{name}") for name in others], "body")


def repeated_chunks(texts: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``doc_id, place``: multi-line chunks whose bytes also stand earlier (smaller doc_id, or earlier in the document).

    Hashes and lengths of all chunks meet first, without their bytes. Only the
    chunks whose hash and length repeat are read again and compared with the
    first of their kind; those that differ from it, a collision, are compared by
    their bytes alone. A chunk that very many documents hold is salted.
    """
    each = texts.select("doc_id", F.posexplode(line_chunks(F.col("text"), divisor)).alias("place", "lines")).filter(_is_multi_line(F.col("lines")))
    body = F.array_join("lines", "\n")
    kind, spread = ["key", "size"], ["doc_id", "place"]
    keyed = stored(each.select("doc_id", "place", F.xxhash64(body).alias("key"), F.octet_length(body).alias("size")))
    firsts = stored(keyed.groupBy(*kind).agg(F.min(F.struct(*spread)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    hot = stored(hot_keys(keyed, kind))
    several = join_hot(keyed, firsts, kind, spread, "inner", hot)
    bodies = stored(_bodies(texts, several, divisor).withColumn("is_first", F.struct(*spread) == F.col("first")))
    first_body = bodies.filter("is_first").select(*kind, F.col("body").alias("first_body"))
    compared = join_hot(bodies.filter("NOT is_first").select(*spread, *kind, "body"), first_body, kind, spread, "inner", hot)
    later = stored(compared.select(*spread, F.when(F.col("body") != F.col("first_body"), F.col("body")).alias("other")), release=True)
    for table in (keyed, firsts, hot, bodies):
        discard(table)
    others = later.filter("other IS NOT NULL")
    repeats = others.join(others.groupBy("other").agg(F.min(F.struct(*spread)).alias("least")), "other").filter(F.struct(*spread) != F.col("least"))
    return later.filter("other IS NULL").select(*spread).union(repeats.select(*spread))


def drop_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """All columns of the documents, ``text`` without repeated chunks, and three counts: lines, lines removed, chunks removed.

    The counts come last, as ``_n_lines, _n_removed_lines, _n_removed_chunks``
    or, where the documents have such a column, with more underscores.
    A chunk counts if at least two of its lines are not empty. The first of
    equal chunks stays; the remaining lines are joined by line feeds, nothing
    left gives an empty text. A null text stays null and has one empty line. Rows without
    doc_id are left out, rows repeating one are one document, an empty table
    gives no rows.

    The documents are dealt by doc_id once; after that only hashes, places and
    repeated chunks are moved.
    """
    table = Buckets(docs.sparkSession, ["doc_id"]).append(identified(docs))
    unique = table.read()
    places_name, built_name, key = (free_name(unique, stem) for stem in ("_places", "_built", "_doc_id"))
    removed = repeated_chunks(unique.select("doc_id", "text"), divisor).groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias(places_name)).withColumnRenamed("doc_id", key)

    def marks(places: Column) -> Column:
        """True at each removed place and false before it, so that a look-up takes one step."""
        gap = lambda place, k: place - F.coalesce(F.get(places, k - 1), F.lit(-1)) - 1
        return F.flatten(F.transform(places, lambda place, k: F.concat(F.array_repeat(F.lit(False), gap(place, k)), F.array(F.lit(True)))))

    def rebuilt(chunks: Column, places: Column) -> Column:
        def with_marks(gone: Column) -> Column:
            kept = F.filter(chunks, lambda _, k: ~F.coalesce(F.get(gone, k), F.lit(False)))
            return let(F.flatten(kept), lambda lines: F.struct(F.array_join(lines, "\n").alias("text"), F.size(lines).alias("n_kept"), F.size(F.flatten(chunks)).alias("n_lines")))

        return let(marks(places), with_marks)

    places = F.coalesce(places_name, F.array().cast("array<int>"))
    joined = unique.join(removed, F.col("doc_id") == F.col(key), "left")
    built = joined.withColumn(built_name, let(line_chunks(F.col("text"), divisor), lambda chunks: rebuilt(chunks, places)))
    text = F.when(F.col("text").isNotNull(), F.col(f"{built_name}.text")).alias("text")
    n_lines, n_kept = F.col(f"{built_name}.n_lines"), F.col(f"{built_name}.n_kept")
    counts = {"_n_lines": n_lines, "_n_removed_lines": n_lines - n_kept, "_n_removed_chunks": F.size(places)}
    return built.select(
        *[text if name == "text" else F.col(f"`{name}`") for name in docs.columns],
        *[count.cast("long").alias(free_name(unique, name)) for name, count in counts.items()],
    )
