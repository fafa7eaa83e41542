"""One JSON document per job, of any size, written and read by many tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.operators.scale import durable, join_dimension, row_numbers, running_totals

SECTIONS = ("pages", "assets", "errors")
_ALL_KEYS = {"ignoreNullFields": "false"}


def document_lines(tables: Mapping[str, DataFrame], fields: Mapping[str, list[str]]) -> DataFrame:
    """``job_id, part, n, line``: the lines of each job's document in the order of ``part, n``.

    A header, the rows of each list and what stands between them are lines of
    their own, so no value grows with a job. ``fields`` names the columns of each
    table that are written. Rows of a job without header are left out.
    """
    # A job id that cannot be null keeps its place in the sort order when the files are written.
    runs = tables["runs"].withColumn("job_id", F.coalesce("job_id", F.lit("")))
    opening = let(F.to_json(F.struct(*fields["runs"]), _ALL_KEYS), lambda head: F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"pages":[')))

    def once(part: int, line: Column) -> DataFrame:
        return runs.select("job_id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("n"), line.alias("line"))

    lines = once(0, opening)
    for number, name in enumerate(SECTIONS):
        table = tables[name].withColumn("job_id", F.coalesce("job_id", F.lit("")))
        order = "visit_order" if "visit_order" in table.columns else "url"
        rows = table.select("job_id", F.col(order).alias("o"), F.to_json(F.struct(*fields[name]), _ALL_KEYS).alias("line"))
        known = join_dimension(rows, runs.select("job_id"), ["job_id"], ["line"], "left_semi")
        numbered = row_numbers(known, ["job_id"], ["o", "line"], "n")
        comma = F.when(F.col("n") > 1, ",").otherwise("")
        lines = lines.unionByName(numbered.select("job_id", F.lit(2 * number + 1).alias("part"), "n", F.concat(comma, "line").alias("line")))
        after = f'],"{SECTIONS[number + 1]}":[' if number + 1 < len(SECTIONS) else "]}"
        lines = lines.unionByName(once(2 * number + 2, F.lit(after)))
    return lines


def write_documents(tables: Mapping[str, DataFrame], fields: Mapping[str, list[str]], path: str) -> None:
    """A folder ``job_id=...`` for each job; its part files, in the order of their names, are one JSON document."""
    lines = document_lines(tables, fields).withColumn("job_id", F.coalesce("job_id", F.lit("")))
    ordered = lines.repartitionByRange("job_id", "part", "n").sortWithinPartitions("job_id", "part", "n")
    ordered.select("job_id", "line").write.mode("overwrite").partitionBy("job_id").text(path)


# --- reading ------------------------------------------------------------------------


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """``doc, file, block, id, text``: the documents cut behind every closing brace, byte range by byte range.

    The text source finds the cuts by itself from any place in a file, so a
    large file fills many tasks. Whether the last fragment of a file ends in a brace is
    seen from the file's size.
    """
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    cut = read.select(
        F.regexp_replace("_metadata.file_path", "/part-[^/]*$", "").alias("doc"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"),
    )
    cut = durable(cut)
    files = cut.groupBy("file").agg(
        F.max(F.struct("block", "id")).alias("last"), (F.max("size") - F.sum(F.octet_length("text").cast("bigint")) < F.count("*")).alias("is_open")
    )
    joined = join_dimension(cut, files, ["file"], ["id"])
    ends = F.when(F.col("is_open") & (F.struct("block", "id") == F.col("last")), "").otherwise("}")
    return durable(joined.select("doc", "file", "block", "id", F.concat("text", ends).alias("text")))


def _quotes_and_depths(text: Column) -> tuple[Column, Column, Column]:
    """Number of string quotes, and the change of depth if the text starts outside or inside a string."""

    def depth(parts: Column, inside: int) -> Column:
        plain = F.array_join(F.filter(parts, lambda _, k: k % 2 == inside), "")
        return let(plain, lambda p: F.length(F.translate(p, "}]", "")) - F.length(F.translate(p, "{[", "")))

    # What stands behind a backslash is never structure; a cut cannot part the two.
    parts = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"', -1)
    return F.size(parts).cast("bigint") - 1, depth(parts, 0).cast("bigint"), depth(parts, 1).cast("bigint")


_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*"?', re.S)
_MARK = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)


def _opened(text: str, in_string: bool, depth: int) -> tuple[int, str | None, bool, int | None, int]:
    """What a fragment opens: containers of the document, key and kind of the last one, where a record begins.

    Last, where the part begins that lies in a record, if need be at the end.
    """
    containers, last_key, is_list, begin, key = 0, None, False, None, None
    start = 0 if depth >= 3 else len(text)
    at = _STRING_REST.match(text).end() if in_string else 0
    for mark in _MARK.finditer(text, at):
        sign = mark.group()
        if sign[0] == '"':
            key = sign
        elif sign in "{[":
            if depth == 1:
                containers, last_key, is_list = containers + 1, json.loads(key) if key and key.endswith('"') and len(key) > 1 else None, sign == "["
            elif depth == 2 and sign == "{":
                begin = start = mark.start()
            depth += 1
        else:
            depth -= 1
            if sign == "]" and depth == 2:  # a list within a list, no record
                start = len(text)
    return containers, last_key, is_list, begin, start


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        rows = []
        for text, in_string, depth in zip(*(columns[name].to_pylist() for name in ("text", "in_string", "depth")), strict=True):
            containers, key, is_list, begin, start = _opened(text, in_string, depth)
            rows.append((containers, key, is_list, int(begin is not None), text[:start], text[start:]))
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string())
        found = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        names = ["containers", "key", "is_list", "records", "outside", "inside"]
        yield pa.RecordBatch.from_arrays([*(columns[name] for name in ("doc", "file", "block", "id", "depth")), *found], ["doc", "file", "block", "id", "depth", *names])


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: ``doc, key, pos, record`` of the objects in each document's lists, and ``doc, header`` with the rest of it.

    A document is a file, or all part files of a folder. It is never held as a
    whole: quotes, then depths, then lists and records are counted by running
    totals over its fragments, and a record is put together from its own.
    """
    order = ["file", "block", "id"]
    cut = _fragments(spark, path)
    quotes, outside, inside = _quotes_and_depths(F.col("text"))
    measured = cut.select("doc", *order, quotes.alias("quotes"), quotes.alias("own"), outside.alias("d0"), inside.alias("d1"))
    strings = running_totals(measured, ["doc"], order, {"quotes": F.col("own")})
    in_string = ((F.col("quotes") - F.col("own")) % 2) == 1
    stepped = strings.select("doc", *order, in_string.alias("in_string"), F.when(in_string, F.col("d1")).otherwise(F.col("d0")).alias("own")).withColumn("depth", F.col("own"))
    depths = running_totals(stepped, ["doc"], order, {"depth": F.col("own")})
    placed = cut.join(depths.select("id", "in_string", (F.col("depth") - F.col("own")).cast("int").alias("depth")), "id")
    fields = "doc string, file string, block long, id long, depth int, containers long, key string, is_list boolean, records long, outside string, inside string"
    parts = durable(placed.select("doc", *order, "text", "in_string", "depth").mapInArrow(_split, fields))

    numbered = running_totals(parts.select("doc", *order, "containers", "records"), ["doc"], order, {"containers": F.col("containers"), "records": F.col("records")})
    opened = parts.filter("containers > 0").select("id", "key", "is_list").join(numbered.select("id", "doc", "containers"), "id").drop("id")
    known = parts.select("id", *order[:2], "depth", "outside", "inside").join(numbered.select("id", "doc", "containers", "records"), "id")
    # A document has a handful of containers, a corpus as many as that for each document.
    known = durable(join_dimension(known, opened, ["doc", "containers"], ["id"], "left"))

    in_list = F.coalesce(F.col("is_list") & F.col("key").isin(*SECTIONS), F.lit(False))
    pieces = known.filter(in_list & (F.col("inside") != ""))
    ordered = F.array_sort(F.collect_list(F.struct(*order, "inside")))
    records = pieces.groupBy("doc", "containers", "key", "records").agg(F.array_join(F.transform(ordered, lambda p: p["inside"]), "").alias("record"))
    first = records.groupBy("doc", "containers").agg(F.min("records").alias("first"))
    placed = join_dimension(records, first, ["doc", "containers"], ["records"])
    lists = placed.select("doc", "key", (F.col("records") - F.col("first")).cast("int").alias("pos"), "record")

    between = in_list & (F.col("depth") >= 2) & F.col("outside").rlike(r"\A[\s,]*\z")
    rest = F.concat(F.when(between, "").otherwise(F.col("outside")), F.when(in_list, "").otherwise(F.col("inside")))
    ordered = F.array_sort(F.collect_list(F.struct(*order, rest.alias("rest"))))
    headers = known.filter(rest != "").groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: p["rest"]), "").alias("header"))
    return lists, headers
