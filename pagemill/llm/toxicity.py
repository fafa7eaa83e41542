"""Toxicity by a chain of linear classifiers over words and word beginnings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, identified, stored

CATEGORIES = ("quality", "toxic")
TRAIN_ROWS = 20_000
FEATURES = 4096
MIN_DOCUMENTS = 5
MIN_STRENGTH = 3.0
BEGINNINGS = (4, 5, 6)
FOLDS = 3
THRESHOLD = 0.5
CACHED_WORDS = 100_000

_EDGES = b".,;:!?\"'()[]|"


def word_features(word: bytes) -> list[bytes]:
    """A word without punctuation at its ends, and its beginnings marked with a star."""
    word = word.strip(_EDGES)
    return [word, *[word[:size] + b"*" for size in BEGINNINGS if len(word) >= size]] if word else []


class FeatureIds(dict):
    """Numbers of the chosen features in each word."""

    def __init__(self, chosen: list[bytes]):
        super().__init__()
        self.numbers = {feature: number for number, feature in enumerate(chosen)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = self[word] = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        return found

    def of(self, text: bytes) -> list[int]:
        """Sorted numbers of the features that occur in a text."""
        if len(self) > CACHED_WORDS:
            self.clear()
        return sorted(set().union(*map(self.__getitem__, set(text.lower().split()))))


def logistic(rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, wanted: np.ndarray, size: int, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Weights of present features, and of the dense ``extra`` columns (the last is the constant), by Adam with a little L2."""
    weights = np.zeros(size + extra.shape[1])
    if not wanted.any():  # nothing to tell apart: never
        weights[-1] = -30.0
        return weights[:size], weights[size:]
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = max(1, len(wanted))
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights[columns], len(wanted)) + extra @ weights[size:]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - wanted
        gradient = np.concatenate([np.bincount(columns, error[rows], size), error @ extra]) / n + 1e-6 * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    return weights[:size], weights[size:]


def _probability(rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = np.bincount(rows, model[0][columns], len(extra)) + extra @ model[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """Chosen features and, for each category in turn, weights of features, earlier probabilities and a constant."""

    categories: tuple[str, ...]
    features: list[bytes]
    models: list[tuple[np.ndarray, np.ndarray]]

    def score(self, texts: list[bytes], ids: FeatureIds) -> np.ndarray:
        found = [ids.of(text) for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        columns = np.fromiter((number for f in found for number in f), np.int64, len(rows))
        extra = np.ones((len(texts), 1))
        for model in self.models:
            extra = np.column_stack([extra[:, :-1], _probability(rows, columns, extra, model), extra[:, -1:]])
        return extra[:, :-1]


def _fit_chain(samples: list, categories: tuple[str, ...], features: list[bytes]) -> Chain:
    rows = np.repeat(np.arange(len(samples)), [len(s["features"]) for s in samples])
    columns = np.fromiter((number for s in samples for number in s["features"]), np.int64, len(rows))
    folds = np.array([s["fold"] for s in samples], np.int64)
    extra, models = np.ones((len(samples), 1)), []
    for category in categories:
        wanted = np.array([s[category] for s in samples], float)
        models.append(logistic(rows, columns, extra, wanted, len(features)))
        outside = np.zeros(len(samples))
        if category != categories[-1]:
            for fold in range(FOLDS):
                inside = folds != fold
                number = np.cumsum(inside) - 1
                use = inside[rows]
                part = logistic(number[rows[use]], columns[use], extra[inside], wanted[inside], len(features))
                outside = np.where(inside, outside, _probability(rows, columns, extra, part))
            extra = np.column_stack([extra[:, :-1], outside, extra[:, -1:]])
    return Chain(categories, features, models)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Chain:
    """Fit the chain on at most ``train_rows`` labelled documents, those with the least hash of the id.

    For each category the features are kept whose presence splits the sample's
    documents best (difference to the expected count over its deviation, at
    least ``MIN_STRENGTH``), in ``MIN_DOCUMENTS`` documents at least. A later model sees the earlier
    categories' out-of-fold probabilities, so it learns to trust them only as
    far as they hold on unseen documents. Rows with a null label or id do not
    train; of repeated labels of an id the least counts. Without labelled
    documents, or without positive ones, a category has probability zero.
    """
    complete = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in categories])
    sample = stored(complete.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    texts = identified(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"))
    labelled = stored(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", *categories))
    totals = labelled.agg(F.count("*").alias("n"), *[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in categories]).first()
    n = max(1, totals["n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, positive = Counter(), [Counter() for _ in categories]
            text, *marks = (column.to_pylist() for column in batch.columns)
            for value, *flags in zip(text, *marks, strict=True):
                seen = {f for word in set((value or b"").lower().split()) for f in word_features(word)}
                every.update(seen)
                for counter, flag in zip(positive, flags, strict=True):
                    if flag > 0:
                        counter.update(seen)
            keys = list(every)
            counts = [pa.array([counter[key] for key in keys], pa.int64()) for counter in (every, *positive)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *counts], ["feature", "n", *names])

    names = [f"n_{c}" for c in categories]
    counted = labelled.select("text", *categories).mapInArrow(count, f"feature binary, n long, {', '.join(f'{x} long' for x in names)}")
    table = stored(counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).filter(F.col("n") >= MIN_DOCUMENTS))
    chosen: set[bytes] = set()
    for category, name in zip(categories, names, strict=True):
        expected = F.col("n") * F.lit((totals[category] or 0) / n)
        strength = F.abs(F.col(name) - expected) / F.sqrt(expected + 1)
        chosen |= {bytes(row["feature"]) for row in table.filter(strength >= MIN_STRENGTH).orderBy(strength.desc(), "feature").limit(features // len(categories)).collect()}
    kept = sorted(chosen)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = FeatureIds(kept)
        for batch in batches:
            found = [ids.of(text or b"") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "features"])

    encoded = labelled.select("doc_id", "text").mapInArrow(encode, "doc_id long, features array<int>")
    samples = encoded.join(sample, "doc_id").select("features", *[(F.col(c) > 0).cast("int").alias(c) for c in categories], F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).alias("fold")).orderBy("doc_id").collect()
    return _fit_chain(samples, categories, kept)


def probabilities(chain: Chain, text: Column) -> Column:
    """A struct with a probability for each category, from whole texts."""
    ids: list[FeatureIds] = []

    @F.arrow_udf(", ".join(f"{c} double" for c in chain.categories))
    def score(texts: pa.Array) -> pa.Array:
        if not ids:
            ids.append(FeatureIds(chain.features))
        values = chain.score([t or b"" for t in texts.to_pylist()], ids[0])
        return pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(chain.categories))], list(chain.categories))

    return score(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, name: str = "_chain") -> DataFrame:
    """All columns of ``docs`` and, under ``name``, the probabilities, of which ``toxic`` decides.

    The documents must not have a column of that name (``free_name``).

    Every document is scored on its whole text; a null or empty text has no
    features. Rows without doc_id are left out, rows repeating one are one
    document, an empty table gives no rows.
    """
    unique = identified(docs)
    return unique.withColumn(name, probabilities(train(unique, labels), F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose probability of being toxic is below the threshold, all columns kept."""
    name = free_name(docs, "_chain")
    return classify(docs, labels, name).filter(F.col(f"{name}.toxic") < threshold).drop(name)
