"""T1 in the order of arrival: change status per micro-batch against a table of last hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.content_types import content_hash
from pagemill.functions.urls import normalize_url
from pagemill.operators.incremental import NEW, UNCHANGED, UPDATED
from pagemill.operators.scale import Buckets

KEYS = ["job_id", "normalized_url"]
FIELDS = "job_id string, normalized_url string, content_hash string, batch_id bigint"
BUCKETS = 64


def last_hashes(log: DataFrame, batch_id: int) -> DataFrame:
    """The hash each URL had before a batch; what an earlier attempt at the batch left does not count."""
    return log.filter(F.col("batch_id") < batch_id).groupBy(*KEYS).agg(F.max_by("content_hash", "batch_id").alias("last_hash"))


def versions(batch: DataFrame, log: DataFrame, batch_id: int, arrival: list[str]) -> DataFrame:
    """Every page ``job_id, page_id, url, html`` of a batch with its status against the version that arrived before it.

    The first of a URL in the batch meets the last hash of earlier batches, the
    following ones each other. The table of hashes lies in buckets by URL: only
    the batch is moved, and hashes in place of html.
    """
    job = F.col("job_id") if "job_id" in batch.columns else F.lit("default").alias("job_id")
    narrow = batch.select(job, normalize_url("url").alias("normalized_url"), "page_id", content_hash("html").alias("content_hash"), *arrival)
    before = F.lag("content_hash").over(Window.partitionBy(*KEYS).orderBy(*dict.fromkeys([*arrival, "page_id", "content_hash"])))
    joined = narrow.join(last_hashes(log, batch_id), KEYS, "left").withColumn("last_hash", F.coalesce(before, "last_hash"))
    status = F.when(F.col("last_hash").isNull(), NEW).when(F.col("last_hash") == F.col("content_hash"), UNCHANGED).otherwise(UPDATED)
    return joined.withColumn("change_status", status).drop("last_hash")


class VersionLog:
    """The hashes of all batches so far, at a path that outlives the session; rewritten to one row per URL by ``compact``.

    A batch appends the last hash of each of its URLs that changed. Nothing is
    changed in place, so a batch may be tried again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.table = Buckets.at(spark, KEYS, path, FIELDS, buckets)

    def process(self, write: Callable[[DataFrame, int], None], arrival: list[str]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function; ``write`` gets the statuses and the batch number, to replace what an earlier attempt left.

        ``arrival`` names the columns that say in which order pages arrived; pages
        that they do not tell apart go by page_id, then hash.
        """

        def run(batch: DataFrame, batch_id: int) -> None:
            write(versions(batch, self.table.read(), batch_id, arrival), batch_id)
            found = versions(batch, self.table.read(), batch_id, arrival)
            order = F.struct(*dict.fromkeys([*arrival, "page_id", "content_hash"]))
            last = found.groupBy(*KEYS).agg(F.max_by("content_hash", order).alias("content_hash"), F.max((F.col("change_status") != UNCHANGED).cast("int")).alias("changed"))
            self.table.append(last.filter("changed = 1").select(*KEYS, "content_hash", F.lit(batch_id).cast("bigint").alias("batch_id")))

        return run

    def compact(self, path: str) -> VersionLog:
        """A log at a new path with one row per URL, for the time between two runs."""
        spark, rows = self.table.spark, self.table.read()
        fresh = VersionLog(spark, path, self.table.buckets)
        latest = rows.groupBy(*KEYS).agg(F.max(F.struct("batch_id", "content_hash")).alias("last"))
        fresh.table.append(latest.select(*KEYS, "last.content_hash", "last.batch_id"))
        return fresh
