"""K8 in streams: counters of each micro-batch, gathered while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from pagemill.functions.content_types import is_error

NAME = "page_progress"
FIELDS = "batch_id bigint, pages bigint, errors bigint, failed bigint, html_length bigint, last_page bigint"


def observed(responses: DataFrame, name: str = NAME) -> DataFrame:
    """The responses as they are; Spark counts pages, error pages, failed fetches and html on the way."""
    failed = F.col("error_type").isNotNull()

    def times(condition):
        return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0))

    return responses.observe(
        name,
        F.count(F.lit(1)).alias("pages"),
        times(~failed & is_error("status_code")).alias("errors"),
        times(failed).alias("failed"),
        F.coalesce(F.sum(F.length("html").cast("bigint")), F.lit(0)).alias("html_length"),
        F.max("page_id").alias("last_page"),
    )


class ProgressLog(StreamingQueryListener):
    """Keeps the counters of the latest batches, at most ``keep``, and hands each to ``tell``."""

    def __init__(self, name: str = NAME, keep: int = 1000, tell: Callable[[dict], None] | None = None):
        self.name, self.keep, self.tell = name, keep, tell
        self.batches: dict[tuple[str, int], dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        counters = {"batch_id": event.progress.batchId, **row.asDict()}
        self.batches[str(event.progress.id), event.progress.batchId] = counters  # a batch that is tried again counts once
        while len(self.batches) > self.keep:
            del self.batches[next(iter(self.batches))]
        if self.tell:
            self.tell(counters)

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        names = [field.split()[0] for field in FIELDS.split(", ")]
        return spark.createDataFrame([tuple(counters.get(name) for name in names) for counters in self.batches.values()], FIELDS)
