"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, identified, stored

SHARD_BYTES = 16 << 20
HASH_BITS = 60
EXTRA_BITS = 6


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id's text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hashed: Column, depth: Column) -> Column:
    return F.call_function("shiftright", hashed, (HASH_BITS - depth).cast("int"))


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``leaf_depth, leaf, depth, prefix, shard_docs, shard_bytes``: which shard each hash prefix points to.

    ``sizes`` has ``h, bytes`` for each document. Leaves are counted at a depth
    at which an average one holds a 64th of the limit; a bucket is a shard if it fits
    and the bucket above does not. Leaves that are still too large go on with
    more bits, their documents only, until a bucket fits or holds one document.
    The directory grows with the number of shards and stays a table.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    top, depth = 0, min(HASH_BITS, max(0, ceil(log2(max(1, total / limit)))) + EXTRA_BITS)
    found, rest = None, sizes
    while True:
        leaves = stored(rest.groupBy(_prefix(F.col("h"), F.lit(depth)).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")))
        above = leaves.select("leaf", "bytes", "docs", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"))
        above = above.withColumn("prefix", F.call_function("shiftright", F.col("leaf"), (F.lit(depth) - F.col("depth")).cast("int")))
        buckets = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
        if depth == HASH_BITS:
            fits = fits | (F.col("depth") == HASH_BITS)
        pointed = above.select("leaf", "depth", "prefix").join(buckets.filter(fits), ["depth", "prefix"])
        least = pointed.groupBy("leaf").agg(F.min(F.struct("depth", "prefix", "shard_docs", "shard_bytes")).alias("_shard"))
        part = stored(least.select(F.lit(depth).alias("leaf_depth"), "leaf", "_shard.*"))
        found = part if found is None else found.union(part)
        large = leaves.join(part, "leaf", "left_anti").select("leaf")
        if not large.limit(1).count():
            return found
        rest = rest.withColumn("leaf", _prefix(F.col("h"), F.lit(depth))).join(large, "leaf", "left_semi").drop("leaf")
        top, depth = depth + 1, min(HASH_BITS, depth + 8)


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, bytes, shard, shard_depth, shard_docs, shard_bytes`` of every document.

    ``shard`` is the hash prefix in bits (empty when everything fits into one). No shard with two or
    more documents exceeds ``limit`` bytes; a larger document is alone in its
    shard. A null text has no bytes. Rows without doc_id are left out, rows
    repeating one are one document, an empty table gives no rows.
    """
    unique = identified(docs.select("doc_id", "text"))
    sizes = stored(unique.select("doc_id", hash_bits(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    found = directory(sizes.select("h", "bytes"), limit)
    result = None
    for (depth,) in sorted(found.select("leaf_depth").distinct().collect()):  # one per round, eight bits or more apart
        leaves = found.filter(F.col("leaf_depth") == depth)
        part = sizes.withColumn("leaf", _prefix(F.col("h"), F.lit(depth))).join(leaves, "leaf")
        result = part if result is None else result.union(part)
    if result is None:
        result = sizes.withColumn("leaf", F.col("h")).join(found, "leaf")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return result.select("doc_id", "bytes", bits.alias("shard"), F.col("depth").cast("int").alias("shard_depth"), "shard_docs", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write the documents as Parquet, a folder ``_shard=b<bits>`` with one file for each shard.

    Where the documents have a column ``_shard``, the folders' name gets more underscores.
    """
    name = free_name(docs, "_shard")
    placed = identified(docs).join(assign_shards(docs, limit).select("doc_id", F.concat(F.lit("b"), "shard").alias(name)), "doc_id")
    placed.repartition(name).write.partitionBy(name).parquet(path)
