"""The incremental run as a stream of arriving responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions.content_types import content_hash
from pagemill.functions.urls import normalize_url
from pagemill.operators.links import link_decisions, page_decisions
from pagemill.operators.metadata import page_metadata
from pagemill.operators.pages import describe_pages
from pagemill.session import STATE_STORE
from pagemill.sources.html_tree import parse_pages
from pagemill.sources.responses import as_responses

STATUS_SCHEMA = "job_id string, normalized_url string, page_id bigint, content_hash string, change_status string"


class _LastHash(StatefulProcessor):
    """Keeps the hash last seen of one URL."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_hash", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for chunk in rows:
            before = chunk["content_hash"].shift(1)
            before.iloc[0] = last
            status = (before == chunk["content_hash"]).map({True: "unchanged", False: "updated"})
            if last is None:
                status.iloc[0] = "new"
            last = chunk["content_hash"].iloc[-1]
            yield pd.DataFrame(
                {
                    "job_id": key[0],
                    "normalized_url": key[1],
                    "page_id": chunk["page_id"],
                    "content_hash": chunk["content_hash"],
                    "change_status": status,
                }
            )
        self.last.update((last,))

    def close(self) -> None:
        pass


def stream_change_status(responses: DataFrame) -> DataFrame:
    """Status of every arriving page against the last one seen at its URL.

    The html is hashed before the shuffle, so only narrow rows are moved and only
    one hash per URL is kept as state.
    """
    responses.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    narrow = as_responses(responses).select(
        "job_id", normalize_url("url").alias("normalized_url"), "page_id", content_hash("html").alias("content_hash")
    )
    return narrow.groupBy("job_id", "normalized_url").transformWithStateInPandas(
        statefulProcessor=_LastHash(), outputStructType=STATUS_SCHEMA, outputMode="Append", timeMode="None"
    )


def link_batches(jobs: DataFrame, write: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function handing decisions and metadata of each batch to ``write``.

    Both are computed per page, so a batch needs no state; ``write`` gets the batch
    number to replace what an earlier attempt at it left.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_pages(describe_pages(as_responses(batch))).drop("html").persist()
        try:
            write(link_decisions(page_decisions(parsed, jobs)), page_metadata(parsed).drop("nodes"), batch_id)
        finally:
            parsed.unpersist()

    return process
