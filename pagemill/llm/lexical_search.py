"""Ranked lexical search over bit-sliced Bloom signatures, exact after rescoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import identified, stored
from pagemill.llm.hashing import mixed

TOP = 10
SEEDS = 2 * TOP
LEVELS = (1, 2, 4, 8)
BITS_PER_KEY = 16
PROBES = 3
BLOCK_DOCUMENTS = 2048
BLOCK_BITS = 1 << 26
PENDING_KEYS = 1 << 23
COUNTED_TERMS = 200_000
CACHED_TERMS = 500_000
ITEM_BATCH = 512
SLICE_BYTES = 1 << 22

#: Letters, digits and everything beyond ASCII; in UTF-8 these are whole bytes.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def term_counts(text: bytes) -> Counter:
    """Every term of a whole text, lower-cased in ASCII, with its occurrences; a long text is read in slices."""
    counts, at = Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE_BYTES)
        stop = gap.start() if gap else len(text)
        counts.update(_TERM.findall(text[at:stop].lower()))
        at = stop
    return counts


class TermHashes(dict):
    """64-bit hash of each term, kept for the terms met lately."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > CACHED_TERMS:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term)
        return value


def level_probes(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The signature rows of some terms that occur ``LEVELS[level]`` times or more: ``PROBES`` for each."""
    keys = mixed(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    first, step = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    return ((first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


_INDEX = "term binary, df long, n_terms long, width int, doc_ids array<long>, lengths array<long>, slices binary"
_FIELDS = pa.schema(
    [("term", pa.binary()), ("df", pa.int64()), ("n_terms", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary())]
)


class _Blocks:
    """Open blocks of one task, one for each signature width."""

    def __init__(self):
        self.open: dict[int, list] = {}
        self.pending = 0

    def add(self, doc_id: int, counts: Counter, hashes: TermHashes) -> Iterator[dict]:
        found = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
        times = np.fromiter(counts.values(), np.int64, len(counts))
        keys = [(level, found[times >= least]) for level, least in enumerate(LEVELS)]
        n_keys = sum(len(some) for _, some in keys)
        width = max(256, 1 << int(BITS_PER_KEY * n_keys - 1).bit_length())
        rows = np.concatenate([level_probes(some, level, width).ravel() for level, some in keys])
        block = self.open.setdefault(width, [])
        block.append((doc_id, int(times.sum()), rows.astype(np.int32)))
        self.pending += len(rows)
        if len(block) >= min(BLOCK_DOCUMENTS, max(8, BLOCK_BITS // width)):
            yield self.close(width)
        while self.pending > PENDING_KEYS:
            yield self.close(max(self.open, key=lambda w: sum(len(r) for *_, r in self.open[w])))

    def close(self, width: int) -> dict:
        block = self.open.pop(width)
        slices = np.zeros((width, -(-len(block) // 8)), np.uint8)
        for place, (_, _, rows) in enumerate(block):
            slices[rows, place >> 3] |= np.uint8(128 >> (place & 7))
            self.pending -= len(rows)
        return {"width": width, "doc_ids": [d for d, *_ in block], "lengths": [n for _, n, _ in block], "slices": slices.tobytes()}


def index_documents(docs: DataFrame) -> DataFrame:
    """Blocks of signatures, and partial term statistics of each task, from one pass over the whole texts.

    A block holds documents with signatures of one width, chosen by the number
    of keys so that each has ``BITS_PER_KEY`` bits; ``slices`` is the block's bit
    matrix by signature row, a bit for each document. A term is entered once
    for every level of ``LEVELS`` that its occurrences reach. Rows with a term or
    with ``df`` alone are statistics: documents holding it; documents with terms
    and their terms. Documents without terms are in no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, blocks, df, n_docs, n_terms = TermHashes(), _Blocks(), Counter(), 0, 0

        def counted() -> pa.RecordBatch:
            rows = [{"term": term, "df": n} for term, n in df.items()]
            df.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

        for batch in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                counts = term_counts(text or b"")
                if not counts:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + counts.total()
                df.update(counts.keys())
                for block in blocks.add(doc_id, counts, hashes):
                    yield packed([block])
                if len(df) > COUNTED_TERMS:
                    yield counted()
        for width in list(blocks.open):
            yield packed([blocks.close(width)])
        yield counted()
        yield packed([{"df": n_docs, "n_terms": n_terms}])

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _INDEX))


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                counts = term_counts(text or b"")
                columns = [pa.array([item_id] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "times"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "item_id long, term binary, times long")


class Queries:
    """A batch of items: their distinct terms and, for each item, the terms' places and weights."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        terms = rows["term"].to_pylist()
        self.place = {term: k for k, term in enumerate(dict.fromkeys(terms))}
        self.hashes = np.array([xxhash.xxh64_intdigest(term) for term in self.place], np.uint64)
        self.items: dict[int, tuple[list[int], list[int]]] = {}
        for item, term, times, weight in zip(rows["item_id"].to_pylist(), terms, rows["times"].to_pylist(), rows["w"].to_pylist(), strict=True):
            places, weights = self.items.setdefault(item, ([], []))
            places.append(self.place[term])
            weights.append(times * weight)

    def length_norm(self, length):
        return 100 - 75 + (75 * length * self.n_docs) // self.n_terms

    def score(self, counts: Counter, item: int, names: list[bytes]) -> int:
        """The exact score of a document, in whole numbers."""
        norm = 8 * self.length_norm(counts.total())
        found = ((weight, counts.get(names[place], 0)) for place, weight in zip(*self.items[item], strict=True))
        return sum(weight * ((1_000_000_000 * tf) // (1000 * tf + norm)) for weight, tf in found if tf)

    def upper_bounds(self, width: int, lengths: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For each item a bound on the score of each document of a block.

        The slices of a term at a level, taken together, are set for every
        document that has the term so often. A set bit is worth what the best
        number of occurrences below the next level adds, so false bits only raise
        the sum.
        """
        matrix = np.frombuffer(slices, np.uint8).reshape(width, -1)
        norm, tops, gains = 8 * self.length_norm(lengths), [*(level - 1 for level in LEVELS[1:]), None], []
        for top in tops:
            tf = lengths if top is None else np.minimum(top, lengths)
            gains.append((1_000_000_000 * tf) // (1000 * tf + norm))
        steps = np.diff(np.array(gains, np.float64), axis=0, prepend=0.0)
        present = []
        for level in range(len(LEVELS)):
            rows = level_probes(self.hashes, level, width)
            bits = matrix[rows[:, 0]]
            for probe in range(1, PROBES):
                bits &= matrix[rows[:, probe]]
            present.append((bits, bits.any(axis=1)))
        for item, (places, weights) in self.items.items():
            at, worth, bound = np.array(places), np.array(weights, np.float64), np.zeros(len(lengths))
            for step, (bits, some) in zip(steps, present, strict=True):
                use = some[at]
                if use.any():
                    bound += step * (worth[use] @ np.unpackbits(bits[at[use]], axis=1, count=len(lengths)))
            yield item, bound


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for width, ids, lengths, slices in zip(*(batch.column(name) for name in ("width", "doc_ids", "lengths", "slices")), strict=True):
            yield width.as_py(), ids.values.to_numpy(), lengths.values.to_numpy(), slices.as_py()


_PAIR = "item_id long, doc_id long"


def _seeds(blocks: DataFrame, shared, seeds: int) -> DataFrame:
    """The documents with the highest bounds, some for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, ids, lengths, slices in _blocks_of(batches):
            for item, bound in shared.value.upper_bounds(width, lengths, slices):
                some = np.flatnonzero(bound > 0)
                if len(some) > seeds:
                    some = some[np.argpartition(-bound[some], seeds)[:seeds]]
                if item in best:
                    old_bound, old_ids = best[item]
                    merged, merged_ids = np.concatenate([old_bound, bound[some]]), np.concatenate([old_ids, ids[some]])
                else:
                    merged, merged_ids = bound[some], ids[some]
                keep = np.argsort(-merged, kind="stable")[:seeds]
                best[item] = merged[keep], merged_ids[keep]
        for item, (bound, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(bound)], ["item_id", "doc_id", "bound"])

    found = blocks.mapInArrow(run, f"{_PAIR}, bound double")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= seeds).select("item_id", "doc_id")


def _not_excluded(blocks: DataFrame, shared, least: dict[int, int]) -> DataFrame:
    """Every document whose bound reaches the score that an item's last place has for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, lengths, slices in _blocks_of(batches):
            items, found = [], []
            for item, bound in shared.value.upper_bounds(width, lengths, slices):
                some = ids[bound * (1 + 1e-9) >= least.get(item, 1)]
                items.append(np.full(len(some), item))
                found.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(np.concatenate(found))], ["item_id", "doc_id"])

    return blocks.mapInArrow(run, _PAIR)


def _rescored(docs: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """``item_id, doc_id, score`` of the pairs, from whole texts; scores of zero are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        names = list(queries.place)
        for batch in batches:
            rows = []
            for doc_id, text, items in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "text", "items")), strict=True):
                counts = term_counts(text or b"")
                rows += [(item, doc_id, queries.score(counts, item, names)) for item in items]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    wanted = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    return docs.join(wanted, "doc_id").select("doc_id", "text", "items").mapInArrow(run, f"{_PAIR}, score long").filter("score > 0")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_batch: int = ITEM_BATCH) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents for each item.

    Bounds from the signatures name a few promising documents of each item;
    their exact scores fix what the last place has at least. Every document
    whose bound reaches that is rescored on its whole text, so the ranking is
    exact. Items are taken in batches of about ``item_batch`` by a hash of their
    id; a batch, its terms and one number for each item are all that the driver
    and a broadcast hold, whatever the number of documents.

    Null and empty texts have no terms: such a document is in no result, such an
    item has none. Equal scores rank by doc_id. Rows without id are left out,
    rows repeating one are one document or item, other columns are ignored, an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    texts = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")))
    index = index_documents(texts)
    blocks = index.filter("width IS NOT NULL").select("width", "doc_ids", "lengths", "slices")
    statistics = stored(index.filter("width IS NULL").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_terms").alias("n_terms")))
    totals = statistics.filter("term IS NULL").first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_docs, n_terms = (totals["df"], totals["n_terms"]) if totals else (0, 0)
    if not n_terms:
        return empty
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    wanted = _item_terms(identified(items.select("item_id", "text"), "item_id")).join(statistics.filter("term IS NOT NULL"), "term")
    weighted = stored(wanted.select("item_id", "term", "times", weight.alias("w")))
    n_items = weighted.select("item_id").distinct().count()
    batches = -(-n_items // item_batch)
    results = []
    for number in range(batches):
        rows = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == number).orderBy("item_id", "term").toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast(Queries(rows, n_docs, n_terms))
        promising = stored(_rescored(texts, _seeds(blocks, shared, max(SEEDS, 2 * top)), shared))
        last = _ranked(promising, top).filter(F.col("rank") == top).select("item_id", "score").toArrow()
        least = dict(zip(last["item_id"].to_pylist(), last["score"].to_pylist(), strict=True))
        results.append(stored(_ranked(_rescored(texts, _not_excluded(blocks, shared, least), shared), top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
    for part in results:
        empty = empty.union(part)
    return empty
