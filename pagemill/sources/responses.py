"""The table of fetched responses every operator starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import col

RESPONSE_COLUMNS = {
    "job_id": "string",
    "page_id": "bigint",
    "requested_url": "string",
    "url": "string",
    "status_code": "int",
    "headers": "map<string,string>",
    "html": "string",
    "links_payload": "string",
    "fetch_mode": "string",
    "error_type": "string",
    "error_message": "string",
}
RESPONSE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RESPONSE_COLUMNS.items())

_DEFAULTS = {
    "job_id": "'default'",
    "requested_url": "url",
    "status_code": "200",
    "headers": "map()",
    "fetch_mode": "'stored'",
}


def clean_headers(headers: Column | str) -> Column:
    """Lower-case header names, entries without a value dropped, last of two equal names kept."""
    entries = F.filter(
        F.map_entries(F.coalesce(col(headers), F.create_map().cast("map<string,string>"))),
        lambda e: e["value"].isNotNull(),
    )
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        lowered,
        lambda e, i: ~F.exists(F.slice(lowered, i + 2, F.size(lowered)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def as_responses(table: DataFrame) -> DataFrame:
    """Any table with ``page_id, url, html`` in the response schema."""
    present = set(table.columns)
    columns = []
    for name, kind in RESPONSE_COLUMNS.items():
        if name in present:
            column = F.col(name)
        else:
            column = F.expr(_DEFAULTS.get(name, "NULL"))
        columns.append(column.cast(kind).alias(name))
    return table.select(*columns).withColumn("headers", clean_headers("headers"))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; a scan with enough of them stays as it is.

    Per-page work is heavy next to reading, and a file of one row group is one task.
    """
    context = scan.sparkSession.sparkContext
    wanted = context.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan stored responses. Without a ``job_id`` all pages belong to one job."""
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(RESPONSE_SCHEMA)
    return as_responses(spread(reader.format(fmt).load(path)))


def content_type_header(headers: Column | str = "headers") -> Column:
    return F.try_element_at(col(headers), F.lit("content-type"))
