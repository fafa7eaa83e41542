"""Quality by the log-likelihood ratio of hashed n-grams between trusted texts and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import identified
from pagemill.llm.hashing import SPACE, mixed, run_hashes, word_hashes

BUCKETS = 1 << 16
THRESHOLD = -0.1
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WORDS = 8
GROUP_BYTES = 1 << 22

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        ids, texts = (column.to_pylist() for column in batch.columns)
        texts, at = [text or b"" for text in texts], 0
        while at < len(ids):
            stop, size = at, 0
            while stop < len(ids) and (stop == at or size + len(texts[stop]) <= GROUP_BYTES):
                size += len(texts[stop])
                stop += 1
            yield ids[at:stop], texts[at:stop]
            at = stop


def ngram_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all single runs and pairs of neighbouring runs, and of which text each is."""
    runs, counts = run_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[1:] == owner[:-1]
    pairs = mixed(runs[:-1] * np.uint64(3) + runs[1:])[inside]
    hashes = np.concatenate([runs, pairs])
    return (hashes & np.uint64(buckets - 1)).astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends a row per bucket, the driver gets ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, part in _groups(batches):
            total += np.bincount(ngram_buckets(part, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["b", "n"])

    table = texts.mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(buckets, np.int64)
    result[table["b"].to_numpy()] = table["n"].to_numpy()
    return result


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log probability ratio of each bucket between two multinomials with add-one counts; zero without any target."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def repeated_words(hashes: np.ndarray, counts: np.ndarray, size: int = REPEAT_WORDS) -> np.ndarray:
    """For each text, the words in ``size``-word windows that stand twice or more in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < size:
        return np.zeros(len(counts), np.int64)
    n = len(hashes) - size + 1
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    key = mixed(key[inside] + owner[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, place, many = np.unique(key, return_inverse=True, return_counts=True)
    starts = inside[many[place] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=len(counts))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def base_features(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    hashes, counts = word_hashes(texts, lower=False)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))

    def per_text(marked: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marked)))
        return np.diff(sums[ends], prepend=0)

    characters = per_text(~SPACE[data] & (data & 0xC0 != 0x80))
    lines = np.fromiter(map(duplicate_lines, texts), np.int64, len(texts))
    return [counts, characters, per_text(_SYMBOL[data]), lines, repeated_words(hashes, counts)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr``.

    Target are the documents labelled with quality 1, raw are all documents;
    both multinomials count every n-gram of every text. ``llr`` is the mean log
    ratio of a document's n-grams (0 without any). A document is kept if it
    passes the base rules and its llr is at least ``threshold``.

    A null text has no words. Rows without doc_id are left out, rows repeating
    one are one document; of repeated labels the least counts, null labels do
    not. Without trusted documents the base rules decide. An empty table gives
    no rows.
    """
    texts = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("text", F.col("text").cast("binary"))
    trusted = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality > 0")
    raw = ngram_counts(texts, buckets)
    # Trusted ids grow with the corpus, so they are never broadcast: one strategy at every size.
    target = ngram_counts(texts.hint("merge").join(trusted.hint("merge"), "doc_id", "left_semi"), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(target, raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for ids, part in _groups(batches):
            found, owner = ngram_buckets(part, buckets)
            many = np.bincount(owner, minlength=len(ids))
            llr = np.bincount(owner, ratios[found], len(ids)) / np.maximum(many, 1)
            columns = [pa.array(ids, pa.int64()), *[pa.array(x.astype(np.int64)) for x in base_features(part)], pa.array(llr)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_BASE_COLUMNS, "llr"])

    fields = ", ".join(f"{name} long" for name in ("doc_id", *_BASE_COLUMNS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rated = texts.mapInArrow(run, f"{fields}, llr double").withColumn("base_failed", failed)
    return rated.select("doc_id", *_BASE_COLUMNS, "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")
